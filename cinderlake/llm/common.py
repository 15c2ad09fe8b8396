"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlake.functions.storage import discard, materialise, shared_dir

__all__ = ["WHITE", "Filter", "crc_mod", "discard", "fresh", "materialise", "one_row", "shared_dir", "table"]

#: ASCII white space of the contracts, as a regular expression for Java and RE2.
WHITE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def one_row(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each value of keys, the least by its other columns (those with an order), so a second run keeps the same."""
    ordered = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    least = df.groupBy(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]).agg(F.min_by(whole, F.struct(*[F.col(f"`{c}`") for c in ordered])).alias("_least_row"))
    return least.select("_least_row.*")


def crc_mod(col: str, mod: int):
    """crc32 of the id as text, modulo mod; a null id counts as remainder 0 of the empty string."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(mod))


class Filter:
    """A Bloom filter of 64-bit keys, sized by the number of keys counted: BITS_PER_KEY bits each, 2^MOST_BITS (32 MB) at most.

    A key's PROBES bits lie in one bucket of 4 KB, so a row meets its bucket in one join. Beyond the bound the filter lets
    more keys pass, which costs work but never loses one.
    """

    BUCKET, BITS_PER_KEY, PROBES, MOST_BITS = 1 << 15, 12, 3, 28

    def __init__(self, keys: DataFrame, column: str):
        self.n = keys.count()
        self.buckets = 1
        while self.buckets * self.BUCKET < min(self.n * self.BITS_PER_KEY, 1 << self.MOST_BITS):
            self.buckets *= 2
        probes = keys.select(self.bucket(F.col(column)).alias("bucket"), F.explode(F.array(*self.positions(F.col(column)))).alias("at"))
        self.table = probes.groupBy("bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at") + 1)).alias("bits"))

    def bucket(self, key: Column) -> Column:
        return key.bitwiseAND(F.lit(self.buckets - 1))

    def positions(self, key: Column) -> list[Column]:
        return [F.shiftright(key, 16 * k + 4).bitwiseAND(F.lit(self.BUCKET - 1)) for k in range(1, self.PROBES + 1)]

    def passing(self, rows: DataFrame, column: str) -> DataFrame:
        """The rows whose key may be in the filter; the filter is broadcast."""
        name, bits = fresh(rows, "_bucket"), fresh(rows, "_bits")
        held = F.broadcast(self.table.select(F.col("bucket").alias(name), F.col("bits").alias(bits)))
        out = rows.withColumn(name, self.bucket(F.col(column))).join(held, name)
        for at in self.positions(F.col(column)):
            byte = F.conv(F.hex(F.substring(F.col(bits), F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            out = out.where(byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), at.bitwiseAND(F.lit(7)).cast("int") + 1)) != 0)
        return out.select(*rows.columns)

    def collected(self):
        """All bits, bucket after bucket, for look-ups in Python: 32 MB at most. An iterator runs a job for each partition, however
        few buckets there are, so they come in few."""
        import numpy as np

        out = np.zeros((self.buckets, self.BUCKET // 8), np.uint8)
        for bucket, bits in self.table.coalesce(4).toLocalIterator():
            out[bucket] = np.frombuffer(bits, np.uint8)
        return out.ravel()
