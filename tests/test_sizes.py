"""Work that grows with the input is dealt over tasks."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderlake.operators import graph as G
from cinderlake.operators import multivariate as M
from cinderlake.operators import relational as R


def test_silhouettes_of_more_points_than_one_block(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(150, 2)).round(3), np.append(rng.integers(0, 3, 149), 7)
    x[1], y[1] = x[0], y[0]
    df = spark.createDataFrame([(int(k) // 2, int(c), *map(float, p)) for k, (p, c) in enumerate(zip(x, y, strict=True))], "id long, kind int, u double, v double")
    got = sorted((r["id"], r["kind"], round(r["silhouette"], 9)) for r in M.silhouette(df, "kind", ["u", "v"], size=20).collect())
    far, want = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), []
    for k in range(150):
        inn, out = far[k, y == y[k]].sum() / max((y == y[k]).sum() - 1, 1), min(far[k, y == c].mean() for c in set(y) - {y[k]})
        want.append((k // 2, int(y[k]), round((out - inn) / max(out, inn), 9) if (y == y[k]).sum() > 1 else 0.0))
    assert got == sorted(want)


def test_silhouettes_have_no_limit_of_their_own(spark):
    df = spark.range(20_050).select("id", (F.col("id") % 2).cast("int").alias("kind"), (F.col("id") % 2).cast("double").alias("u"))
    assert M.silhouette(df, "kind", ["u"]).where("silhouette = 1").count() == 20_050


def test_tasks_of_intersections_grow_in_number(spark):
    pixels = spark.createDataFrame([(1, 5, 3), (1, 5, 3), (2, 5, 3), (2, 6, 4)], "fire_id long, id long, m int")
    found = R.intersecting(pixels, "m", rows=7_000_000)
    assert sorted(map(tuple, found.collect())) == [(5, 3, 2, 3), (6, 4, 1, 1)]
    assert "hashpartitioning(id#" in (plan := found._jdf.queryExecution().toString()) and ", 8), REPARTITION_BY_NUM" in plan


@pytest.mark.parametrize("most", [200_000, 3])
def test_only_sets_of_several_tiles_go_to_components(spark, monkeypatch, most):
    seen, whole = [], G.components
    monkeypatch.setattr(G, "components", lambda links: seen.append(links.count()) or whole(links))
    rows = [(2000, 1 + (r + c) % 3, 10 * r + c, r, c) for r in range(10) for c in range(10)]
    df = spark.createDataFrame(rows, "year int, month int, px long, row int, col int")
    got = G.merge_consecutive_months(df, 1.5, (1, 2, 3), 16, most).collect()
    assert {(r["month"], r["fire_month"], r["fire"]) for r in got} == {(3, 1, 0)} and len(got) == 100
    assert sum(seen) == 0
    seen.clear()
    got = G.merge_consecutive_months(df, 1.5, (1, 2, 3), 5, most).collect()
    assert {(r["month"], r["fire_month"], r["fire"]) for r in got} == {(3, 1, 0)} and sum(seen) > 0


def test_fills_write_what_has_gaps_not_all_edges(spark, monkeypatch):
    written, whole = [], G.materialise
    monkeypatch.setattr(G, "materialise", lambda df, *a, **k: written.append((out := whole(df, *a, **k)).count()) or out)
    cells = spark.range(400).select("id", F.floor(F.col("id") / 20).alias("row"), (F.col("id") % 20).alias("col"))
    values = cells.select("id", F.when(F.col("id") != 210, F.col("id").cast("double")).alias("v"))
    got = {r["id"]: r["v"] for r in G.neighbour_fill(values, G.neighbours(cells), "v").collect()}
    assert got == {k: float(k) for k in range(400)}
    assert sum(written) < 500


def test_fills_of_several_columns_keep_keys_apart(spark):
    rows = [(0, "a", None, 1.0), (1, "a", 4.0, None), (2, "a", None, None), (0, "b", None, 7.0), (1, "b", None, None), (2, "b", None, None), (9, "b", None, 3.0)]
    values = spark.createDataFrame(rows, "id long, period string, u double, v double")
    edges = spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long")
    got = {(r["id"], r["period"]): (r["u"], r["v"]) for r in G.fill_rounds(values, edges, ["u", "v"], F.avg, ["period"]).collect()}
    assert got == {(0, "a"): (4.0, 1.0), (1, "a"): (4.0, 1.0), (2, "a"): (4.0, 1.0), **{(k, "b"): (None, 7.0) for k in range(3)}, (9, "b"): (None, 3.0)}


def test_components_send_no_large_tables_by_way_of_the_driver(spark, monkeypatch):
    links = spark.range(300).select(F.col("id").alias("a"), F.when(F.col("id") % 3 == 2, F.col("id")).otherwise(F.col("id") + 1).alias("b"))
    kept = G.label_all(spark.range(301).withColumnRenamed("id", "n"), links, "n")
    monkeypatch.setattr(G, "SENT", 10)
    found = G.label_all(spark.range(301).withColumnRenamed("id", "n"), links, "n")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, kept.collect())) == [(k, k - k % 3) for k in range(301)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
