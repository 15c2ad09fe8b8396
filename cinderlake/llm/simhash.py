"""Operator 13, SimHash near-dedup: Golay-code fuzzy hashing of fingerprint segments, then verification and components.

A text's fingerprint has bit b set where more than half of its shingles' 64-bit hashes have it. Two fingerprints link when they
differ in at most two bits (RADIUS).

1. Segments. The 64 bits are cut into segments of 22, 21 and 21. Two errors leave one segment of the three without any.
2. Codewords. The next segment (cyclically), read as a word of 23 bits, is decoded in the perfect Golay code [23, 12, 7]: its
   indices are those of all codewords at distance 4 or less, one where the nearest codeword lies within 2, else six (the blocks
   of the code's Steiner system through the three errors). Words that differ in one or two bits always share an index.
   A key is the error-free segment with one such index: 18 keys a fingerprint at most, of 33 or 34 bits.
3. Join. Distinct fingerprints meet in buckets of equal keys; candidates are verified by the bits that differ.
4. Crowded buckets (more than CROWD fingerprints) are not joined with themselves. Their fingerprints are dealt out by the 65
   words at distance 1 or less of each: those that share such a centre (65 at most) differ in two bits at most, and all that
   differ in two or fewer share one, so a star at each centre gives the same components, with work in proportion to the rows.

Defined results: null, empty and blank texts have the fingerprint zero, which links like any other. Repeated rows come out each.
Null ids never are a component's smallest id unless it has no other. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlake.functions.storage import discard, materialise
from cinderlake.llm.common import table
from cinderlake.operators.graph import components

RADIUS = 2
CROWD = 64
SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the Golay code, a fixed value: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0xC75
STEP = 1 << 16


def remainder(word: int) -> int:
    """Syndrome of a word of 23 bits."""
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GOLAY << (bit - 11)
    return word


class Golay:
    """Indices of the codewords near words of 23 bits, by tables of syndromes."""

    def __init__(self):
        one = [remainder(1 << b) for b in range(23)]
        self.low, self.high = (self._sums(one[a:z]) for a, z in ((0, 12), (12, 23)))
        self.errors = np.full((2048, 6), -1, np.int64)
        filled = np.zeros(2048, np.int64)
        for weight in range(5):  # all words up to weight 3 lead a class of their own; five of weight 4 join each class of weight 3
            for at in combinations(range(23), weight):
                s = 0
                for b in at:
                    s ^= one[b]
                self.errors[s, filled[s]] = sum(1 << b for b in at)
                filled[s] += 1

    @staticmethod
    def _sums(parts: list[int]) -> np.ndarray:
        out = np.zeros(1, np.int64)
        for p in parts:
            out = np.concatenate([out, out ^ p])
        return out

    def indices(self, words: np.ndarray) -> np.ndarray:
        """One row of six for each word; -1 where there are fewer."""
        errors = self.errors[self.low[words & 0xFFF] ^ self.high[words >> 12]]
        return np.where(errors < 0, -1, (words[:, None] ^ errors) >> 11)


def keys_of(golay: Golay, fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys, and for each the number of its fingerprint (unsigned, 64 bits)."""
    parts = [((fingerprints >> np.uint64(at)) & np.uint64((1 << size) - 1)).astype(np.int64) for at, size in SEGMENTS]
    keys, rows = [], []
    for i, exact in enumerate(parts):
        near = golay.indices(parts[(i + 1) % 3])
        row, slot = np.nonzero(near >= 0)
        keys.append((np.int64(i) << 34) | (exact[row] << 12) | near[row, slot])
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def fingerprint(text: bytes | None, k: int = 3) -> int:
    """SimHash of a text in UTF-8, over word shingles with repeats."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(k, len(words))
    first, last = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(first), STEP):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(first[at : at + STEP], last[at : at + STEP], strict=True)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(first), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id and fingerprint (64 bits as a long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = np.array([fingerprint(x, k) for x in part.column(1).cast(pa.binary()).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


def fuzzy_keys(distinct: DataFrame) -> DataFrame:
    """key, fp for each key of each fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            keys, rows = keys_of(golay, fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[rows])], names=["key", "fp"])

    return distinct.select("fp").mapInArrow(run, "key bigint, fp bigint")


def stars(crowded: DataFrame) -> DataFrame:
    """Links a, b among fingerprints, by centres: at each the smallest with the others, 64 at most."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)])
    balls = crowded.select("fp", F.explode(flips).alias("flip")).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("centre"), "fp")
    met = balls.groupBy("centre").agg(F.array_sort(F.collect_list("fp")).alias("all")).where(F.size("all") > 1)
    return met.select(F.element_at("all", 1).alias("a"), F.explode(F.expr("slice(all, 2, 64)")).alias("b")).distinct()


def links(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links a, b that have the components of all pairs of distinct fingerprints with at most RADIUS differing bits."""
    keys = fuzzy_keys(distinct)
    sizes = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    met = materialise(keys.join(sizes, "key"), "buckets")
    one = met.where(F.col("size") <= crowd)
    other = one.select("key", F.col("fp").alias("b"))
    near = one.select("key", F.col("fp").alias("a")).join(other, "key").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS))
    crowded = met.where(F.col("size") > crowd).select("fp").distinct()
    out = materialise(near.select("a", "b").distinct().unionByName(stars(crowded)), "near")
    discard(met)
    return out


def near_duplicates(docs: DataFrame, k: int = 3, crowd: int = CROWD) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links) of each row."""
    rows = materialise(fingerprints(docs, k), "fingerprints")
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = links(distinct, crowd)
    labels = components(found).withColumnRenamed("node", "fp")
    known = materialise(distinct.join(labels, "fp"), "labelled")
    least = known.groupBy("label").agg(F.min("least").alias("component"))
    linked = known.join(least, "label").select("fp", "component")
    every = materialise(distinct.join(linked, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id")), "placed")
    discard(found, known)
    out = rows.join(every, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op13_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3)
