"""Counting, binning, reshaping and zonal operators: plain DataFrame in, DataFrame out, keys as parameters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def count_by(df: DataFrame, keys: Sequence[str], name: str = "npolygons") -> DataFrame:
    """A1: rows per key."""
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def sum_by(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """A2, A3: sums per key; partial sums are made before the shuffle."""
    return df.groupBy(*keys).agg(F.sum(value).alias(name))


def pivot_sum(df: DataFrame, keys: Sequence[str], column: str, values: Sequence, value: str, prefix: str = "") -> DataFrame:
    """One column per listed value, 0 where there is nothing; columns are fixed, so nothing is scanned for them."""
    cols = [F.coalesce(F.sum(F.when(F.col(column) == v, F.col(value))), F.lit(0)).alias(f"{prefix}{v}") for v in values]
    return df.groupBy(*keys).agg(*cols)


def melt(df: DataFrame, keys: Sequence[str], columns: Sequence[str], variable: str, value: str) -> DataFrame:
    """Wide to long."""
    return df.unpivot(list(keys), list(columns), variable, value)


def cell_filter(df: DataFrame, grid: DataFrame, threshold: float, include: Sequence[int] = (), exclude: Sequence[int] = ()) -> DataFrame:
    """Cells over the area threshold or included, and not excluded; grid attributes come along."""
    keep = ((F.col("pct_area") >= threshold) | F.col("id").isin(list(include))) & ~F.col("id").isin(list(exclude))
    return df.join(grid.where(keep), "id")


def top_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def mode_by(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The most frequent value other than 0; the smallest on ties."""
    counts = df.where(F.col(value) != 0).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct("n", -F.col(value))).alias("mode"))


def assign_most(pairs: DataFrame, item: str, cell: str, everyone: DataFrame) -> DataFrame:
    """The cell that holds most of an item, the smallest on ties; -99 for items in none."""
    counts = pairs.groupBy(item, cell).agg(F.count("*").alias("n"))
    best = counts.groupBy(item).agg(F.max_by(cell, F.struct("n", -F.col(cell))).alias("cell"))
    return everyone.select(item).distinct().join(best, item, "left").withColumn("cell", F.coalesce("cell", F.lit(-99)))


def mean_and_delta(df: DataFrame, keys: Sequence[str], order: str, value: str, median: bool = False) -> DataFrame:
    """Mean (or median) and last less first value in order."""
    middle = F.median(value) if median else F.avg(value)
    return df.groupBy(*keys).agg(middle.alias(value), (F.max_by(value, order) - F.min_by(value, order)).alias(f"{value}_delta"))


def weighted_mean(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """A19, A24, A30."""
    return df.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("weighted_mean"))


def roll_up(df: DataFrame, keys: Sequence[str], node: str, value: str, closure: DataFrame) -> DataFrame:
    """Sums for each ancestor of a ragged hierarchy; closure (node, ancestor, level) holds every node itself too."""
    return df.join(closure, node).groupBy(*keys, "ancestor", "level").agg(F.sum(value).alias(value))


def singletons(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """With a flag for rows whose key occurs once (a null key is a key). Counts are joined back: a hot key's rows need not meet
    in one task, as they would in a window."""
    counts = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg((F.count("*") == 1).alias("single"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return df.join(counts, same).drop(*[f"_{k}" for k in keys])


def quantiles_by(df: DataFrame, keys: Sequence[str], value: str, named: dict[str, float]) -> DataFrame:
    """Linear quantiles, named. Equal values are counted before the quantiles are taken, so a key's buffer holds its
    distinct values only. Null values count for nothing; a key with no others has null quantiles."""
    counts = df.groupBy(*keys, F.col(value).alias("_value")).agg(F.count("*").alias("_n"))
    q = counts.groupBy(*keys).agg(F.percentile("_value", F.array(*[F.lit(x) for x in named.values()]), F.col("_n")).alias("_q"))
    return q.select(*keys, *[F.get("_q", F.lit(i)).alias(name) for i, name in enumerate(named)])


def density(df: DataFrame, count: str, area: str, name: str = "density") -> DataFrame:
    """Count to the km2; null where there is no area."""
    return df.withColumn(name, F.try_divide(F.col(count).cast("double"), F.nullif(F.col(area).cast("double"), F.lit(0.0))))


def class_table(spark: SparkSession, lists: dict[str, Sequence[int]]) -> DataFrame:
    """class lists as a dimension table: list, class. A class may be in several lists."""
    return spark.createDataFrame([(name, int(c)) for name, own in lists.items() for c in own], "list string, class int")


def by_class_list(df: DataFrame, column: str, lists: DataFrame, default: str | None = None) -> DataFrame:
    """each row once for every list that holds its class, with the list; rows in none come with default, or go if that is None."""
    named = lists.select("list", F.col("class").alias("_class"))
    joined = df.join(named, F.col(column) == F.col("_class"), "inner" if default is None else "left").drop("_class")
    return joined if default is None else joined.withColumn("list", F.coalesce("list", F.lit(default)))


def harmonise_vintages(maps: dict[int, DataFrame], renames: dict[int, dict[str, str]], code: str, fixes: dict[str, str], order: Sequence[str]) -> DataFrame:
    """harmonise() of each vintage by its own renames, in one table with the vintage."""
    parts = [harmonise(df, renames.get(year, {}), code, fixes, order).withColumn("vintage", F.lit(year)) for year, df in sorted(maps.items())]
    return reduce(DataFrame.unionByName, parts)


def first_wins(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """The union, of which the part listed first wins each key."""
    out = None
    for k, part in enumerate(parts):
        own = part.withColumn("_part", F.lit(k))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    value = F.struct(*[c for c in out.columns if c not in keys])
    return out.groupBy(*keys).agg(F.min_by(value, "_part").alias("v")).select(*keys, "v.*").drop("_part")


def version_lookup(df: DataFrame, versions: dict[int, int], year: str = "year") -> DataFrame:
    """The map vintage of each year, by an explicit table (not the nearest earlier one)."""
    pairs = F.create_map(*[F.lit(x) for kv in versions.items() for x in kv])
    return df.withColumn("vintage", pairs[F.col(year)])


def snapshot(df: DataFrame, created: str, years: Sequence[int]) -> DataFrame:
    """F8: everything created up to each year; years are exploded from a literal, not joined."""
    return df.withColumn("year", F.explode(F.filter(F.array(*[F.lit(y) for y in years]), lambda y: y >= F.col(created))))


def intersecting(pixels: DataFrame, month: str, keys: Sequence[str] = ("id",), rows: int | None = None) -> DataFrame:
    """A5: fires and pixels per cell and month; a fire counts once in every cell it meets. month: of pixel or polygon.
    rows: number of pixels, if known; tasks take a million each, so what a task holds does not grow with them."""
    n = (pixels.count() if rows is None else rows) // 1_000_000 + 1
    named = pixels.select(*keys, F.col(month).alias("month"), "fire_id").repartition(n, *keys, "month", "fire_id")
    return named.groupBy(*keys, "month", "fire_id").agg(F.count("*").alias("n")).groupBy(*keys, "month").agg(F.count("fire_id").alias("npolygons"), F.sum("n").alias("npixels"))


def pixel_area(pixels: DataFrame, keys: Sequence[str], side_m: float = 30.0) -> DataFrame:
    """km2 of burned pixels (values 1 to 12)."""
    return pixels.where(F.col("value").between(1, 12)).groupBy(*keys).agg((F.count("*") * (side_m * side_m * 1e-6)).alias("area"))


def intersecting_sizes(pairs: DataFrame, sizes: DataFrame, least: float) -> DataFrame:
    """A10: each cell with each fire it meets and the fire's whole size."""
    return pairs.select("id", "fire_id").distinct().join(sizes.where(F.col("area") >= least), "fire_id")


def dissolve(parts: DataFrame, component: str) -> DataFrame:
    """One row per component: first id, first year, last month, pixels."""
    return parts.groupBy(component).agg(F.min("fire_id").alias("fire_id"), F.min("year").alias("year"), F.max("month").alias("month"), F.count("*").alias("npixels"))


def pairs_with_self(items: DataFrame, key: str) -> DataFrame:
    """Each unordered pair once, with itself; for small dimensions (an inequality join)."""
    a, b = items.select(F.col(key).alias("a")), items.select(F.col(key).alias("b"))
    return a.join(b, F.col("a") <= F.col("b"))


def convert(value: Column, kind: str, days: Column | None = None) -> Column:
    """X4: 'kelvin' to Celsius, 'metres_a_day' to mm a month, 'tenths', 'm2' to km2."""
    return {"kelvin": lambda: value - 273.15, "metres_a_day": lambda: value * 1000 * days, "tenths": lambda: value * 0.1, "m2": lambda: value * 1e-6}[kind]()


def harmonise(df: DataFrame, renames: dict[str, str], code: str, fixes: dict[str, str], order: Sequence[str]) -> DataFrame:
    """Renamed columns, six-digit codes with corrected states, duplicates dissolved, columns in order."""
    named = df.withColumnsRenamed(renames)
    six = F.substring(F.col(code).cast("string"), 1, 6)
    state = F.substring(six, 1, 2)
    fixed = F.coalesce(F.create_map(*[F.lit(x) for kv in fixes.items() for x in kv])[state], state) if fixes else state
    named = named.withColumn("s_code", fixed).withColumn("m_code", F.concat("s_code", F.substring(six, 3, 4)))
    rest = [c for c in order if c not in ("m_code", "s_code", "area")]
    return named.groupBy("m_code", "s_code").agg(F.sum("area").alias("area"), *[F.min(c).alias(c) for c in rest]).select(*order)


def sample_rows(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """N rows in the order of a seeded hash of the key, so a rerun and any partitioning give the same rows."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def existing(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns that df has, in the order wanted."""
    return df.select(*[c for c in wanted if c in df.columns])


def assemble(base: DataFrame, tables: Sequence[DataFrame], keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Tables joined on shared keys one after another."""
    for t in tables:
        base = base.join(t, list(keys), how)
    return base


def recode(df: DataFrame, column: str, names: dict, default=None) -> DataFrame:
    """Values by a literal map."""
    found = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col(column)]
    return df.withColumn(column, found if default is None else F.coalesce(found, F.lit(default)))


def flip_sign(df: DataFrame, column: str, where: Column) -> DataFrame:
    """Axes have no sign of their own; periods may be turned to point the same way."""
    return df.withColumn(column, F.when(where, -F.col(column)).otherwise(F.col(column)))
