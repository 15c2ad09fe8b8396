"""Operator 6, exact dedup: a log-structured merge index in DataFrame operations only.

* Flush: every input split is a memtable. It becomes a run, a Parquet file sorted by digest, with statistics and a Bloom
  filter on the digest.
* Compaction, tier 1: FAN runs at a time merge; of equal digests the smallest doc_id and the number of rows stay.
  Tier 2: the merged runs are cut by ranges of digests and merge into one level, sorted, range after range. A digest comes
  at most once from each run of the tier before, so a hot one is small by then.
* Lookup: rows consult a filter of the level's repeated digests (bits by their counted number, broadcast, 32 MB at most)
  before they look anything up. Only rows that pass it carry their text further.
* Verification: hits are grouped by digest *and* bytes of the normalised text, with map-side combine. Where one
  digest has several texts, its rows are told apart by the text itself.

Text is shuffled for hits only: rows with repeated digests, and the few in a hundred that the filter lets pass (all rows,
once, where more than some 100 million digests repeat and the bound on the filter is met).

Defined results: a null text counts as empty. Of equal texts the smallest doc_id stays; null ids count only where
a group has no other (its keep_id is null). Repeated rows (same id and text) are all reported, each as kept, and
drop_copies() leaves one of them. An empty table gives no rows. Extra columns are ignored, drop_copies() keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlake.llm.common import WHITE, Filter, discard, fresh, materialise, one_row, table

#: Runs that merge into one in tier 1.
FAN = 16
BLOOM = {"parquet.bloom.filter.enabled#digest": "true"}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def text_digest(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def flush(rows: DataFrame) -> DataFrame:
    """doc_id, digest, run: a sorted run of each input split."""
    return materialise(rows.select("doc_id", "digest", F.spark_partition_id().alias("run")).sortWithinPartitions("digest"), "runs", **BLOOM)


def compact(runs: DataFrame) -> DataFrame:
    """digest, keep_id, group_size: one level, each digest once, sorted by ranges of digests."""
    merged = runs.groupBy(F.floor(F.col("run") / FAN).alias("merged"), "digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    tier = materialise(merged.sortWithinPartitions("merged", "digest"), "tier", **BLOOM)
    ranges = tier.select("digest", "keep_id", "group_size").repartitionByRange("digest").sortWithinPartitions("digest")
    level = materialise(ranges.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")), "level", **BLOOM)
    discard(tier)
    return level


def exact_groups(docs: DataFrame, digest_of=text_digest) -> DataFrame:
    """doc_id, digest, keep_id, group_size and kept for every row of docs."""
    rows = docs.select("doc_id", normalised(F.col("text")).alias("norm")).select("doc_id", "norm", digest_of(F.col("norm")).alias("digest"))
    runs = flush(rows)
    level = compact(runs)
    filter_ = Filter(level.where("group_size > 1").select(F.xxhash64("digest").alias("key")), "key")
    hits = filter_.passing(rows.withColumn("key", F.xxhash64("digest")), "key")
    by_bytes = hits.groupBy("digest", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # One row per digest: with one text below it, its group is verified byte by byte.
    checked = materialise(
        by_bytes.groupBy("digest").agg(F.count("*").alias("texts"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")).where("group_size > 1"),
        "checked",
    )
    discard(level)
    plain = checked.where("texts = 1").drop("texts")
    clashing = checked.where("texts > 1").select("digest")
    out = runs.drop("run").join(plain, "digest", "left")
    if not clashing.isEmpty():
        out = out.join(clashing, "digest", "left_anti")
        told = rows.join(clashing, "digest", "left_semi")
        groups = told.groupBy("digest", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        out = out.unionByName(told.join(groups, ["digest", "norm"]).drop("norm"))
    alone = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        "digest",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs whose text has no equal with a smaller id, one for each document, with all columns."""
    groups = materialise(exact_groups(docs).select("doc_id", "digest", "kept"), "groups")
    kept = groups.where("kept").groupBy(F.col("doc_id").alias("_keep_doc_id"), F.col("digest").alias("_keep_digest")).agg(F.count("*").alias("_keep_rows"))
    repeated = not kept.where("_keep_rows > 1").isEmpty()
    own = fresh(docs, "_own_digest")
    marked = docs.withColumn(own, text_digest(normalised(F.col("text"))))
    same = marked["doc_id"].eqNullSafe(kept["_keep_doc_id"]) & (marked[own] == kept["_keep_digest"])
    out = marked.join(kept, same, "left_semi")
    return (one_row(out, ["doc_id", own]) if repeated else out).drop(own)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP6_SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM (min(doc_id) OVER g) AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
"""
