"""The corpus pipeline as a whole, on tables with nulls, repeats and clashing columns, and on an empty one."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cinderlake.llm import toxicity
from cinderlake.llm.common import Filter

EXTRA = ("node", "digest", "label", "_kept_node", "epoch")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    draw, words = random.Random(11), [f"word{k}" for k in range(400)]
    texts = [" ".join(draw.choices(words, k=draw.randrange(30, 80))) for _ in range(40)]
    benchmark = " ".join(draw.choices(words, k=12))
    rows = [(k, t, "en", f"src{k % 5}") for k, t in enumerate(texts)]
    rows += [(100, texts[0], "en", "src0"), (101, texts[1] + " more", "en", "src1"), (102, f"{texts[2]} {benchmark}", "en", "src2"), (None, texts[3], None, None), (103, None, "en", "src0"), (104, "", "fr", "src1"), (3, texts[3], "en", "src3"), (3, texts[3], "en", "src3")]
    whole = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).withColumns({c: F.lit("x") for c in EXTRA})
    folder = str(tmp_path_factory.mktemp("pipeline"))
    for name, docs in (("some", whole), ("none", whole.limit(0))):
        docs.coalesce(2).write.parquet(f"{folder}/{name}/documents.parquet")
        spark.createDataFrame([(k, 1, int(k % 9 == 0)) for k in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/{name}/labels.parquet")
        spark.createDataFrame([("b1", benchmark), ("b2", None)], "item_id string, text string").write.parquet(f"{folder}/{name}/benchmark.parquet")
    return folder, texts, whole.columns


def test_run(spark, tables):
    folder, texts, columns = tables
    out = corpus_pipeline.run(spark, f"{folder}/some")
    assert set(columns) <= set(out.columns)
    got = out.collect()
    kept = {(r["doc_id"], r["text"]) for r in got}
    assert not {100, 101, 102} & {i for i, _ in kept}  # an exact copy, a near copy, a benchmark passage
    assert (None, texts[3]) not in kept and all(r[c] == "x" for r in got for c in EXTRA)
    assert len({i for i, t in kept if t}) > 10


def test_run_of_an_empty_table(spark, tables):
    folder, _, columns = tables
    out = corpus_pipeline.run(spark, f"{folder}/none")
    assert out.count() == 0 and set(columns) <= set(out.columns)


def jobs_of(spark, action):
    """How many jobs an action begins, with 40 partitions after each shuffle."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    begun = lambda: max(spark.sparkContext.statusTracker().getJobIdsForGroup(None), default=0)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spark.range(1).count()
        before = begun()
        action()
        spark.range(1).count()
        return begun() - before
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_driver_runs_no_job_for_each_partition(spark, tables):
    folder, texts, _ = tables
    docs, labels = (spark.read.parquet(f"{folder}/some/{x}.parquet") for x in ("documents", "labels"))
    assert jobs_of(spark, lambda: toxicity.train(docs, labels)) < 40
    assert jobs_of(spark, lambda: Filter(spark.range(100).withColumnRenamed("id", "key"), "key").collected()) < 20
