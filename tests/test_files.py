"""Readers and writers of yearly files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cinderlake.sources import files as S


def test_scan_and_names(spark, tmp_path):
    for name in ("a_2001-03.csv", "sub/b_2002.csv", "c.txt", "sub/d.csv"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("1")
    got = {r["file"]: (r["year"], r["month"]) for r in S.scan(spark, str(tmp_path), "csv").collect()}
    assert got == {"a_2001-03.csv": (2001, 3), "b_2002.csv": (2002, None), "d.csv": (None, None)}
    assert {r["file"] for r in S.scan(spark, str(tmp_path), "csv", ["b_", "d"]).collect()} == {"b_2002.csv", "d.csv"}


def test_work_order_refuses_other_widths(spark, tmp_path):
    (tmp_path / "o.csv").write_text("x,y\nz,w\n")
    assert [tuple(r) for r in S.work_order(spark, str(tmp_path / "o.csv"), ["a", "b"]).collect()] == [("x", "y"), ("z", "w")]
    with pytest.raises(ValueError):
        S.work_order(spark, str(tmp_path / "o.csv"), ["a"])


def test_years_round_trip_and_rerun(spark, tmp_path):
    schema = "id long, area double, year int"
    df = spark.createDataFrame([(1, 0.5, 1995), (2, 0.01, 1996), (3, 2.0, 2001)], schema)
    for _ in range(2):
        S.write_years(df, str(tmp_path / "t"))
    grid = spark.createDataFrame([(1, 10.0), (3, 90.0)], "id long, pct_area double")
    out = S.read_years(spark, str(tmp_path / "t"), schema, [1995, 2001], ["id", "area"], 0.03, ((1995, 1996),), grid, 50, include=[1])
    assert sorted((r["id"], r["period"]) for r in out.collect()) == [(1, "1995-1996"), (3, None)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan or "PartitionFilters: [year" in plan
    S.write_years(df.where("year = 1995"), str(tmp_path / "t"), append=True)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4


def test_same_years(spark):
    a, b = (spark.createDataFrame([(y,) for y in ys], "year int") for ys in ((1, 2), (1, 3)))
    S.assert_same_years(a, a)
    with pytest.raises(ValueError):
        S.assert_same_years(a, b)


def test_masks_bounds_srid_and_failures(spark):
    df = spark.createDataFrame([(1, -9.0), (2, 3.0)], "id int, v double")
    assert [r["v"] for r in S.masked(df, "v", -9.0).orderBy("id").collect()] == [None, 3.0]
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), (2, 5.0, 5.0, 6.0, 6.0)], "id int, minx double, miny double, maxx double, maxy double")
    assert [r["id"] for r in S.in_bounds(boxes, 0.5, 0.5, 2, 2).collect()] == [1]
    assert [r["srid"] for r in S.union_with_srid([df, df.withColumn("srid", F.lit(1))]).orderBy("srid").collect()] == [1, 1, 4674, 4674]
    ok, bad = S.split_failures(df, F.col("v") > 0, F.lit("negative"))
    assert ok.count() == 1 and bad.first()["reason"] == "negative"


def test_alignment_and_templates(spark):
    files = lambda rows: spark.createDataFrame(rows, "path string, file string, year int, month int")
    a = files([("a1", "200101.t2m.tif", 2001, 1), ("a2", "200102.t2m.tif", 2001, 2), ("a3", "x.tif", None, None)])
    b = files([("b1", "b", 2001, 1)])
    assert sorted((r["path"], r["path_b"]) for r in S.align_months(a, b).collect() if r["year"]) == [("a1", "b1"), ("a2", None)]
    one, two = files([("p", "p", 2001, None), ("q", "q", 2002, None)]), files([("r", "r", 2002, None), ("s", "s", 2001, None)])
    assert sorted(map(tuple, S.align_years({"one": one, "two": two}).collect())) == [(2001, "p", "s"), (2002, "q", "r")]
    with pytest.raises(ValueError):
        S.align_years({"one": one, "two": b})
    got = S.by_template(a.drop("year", "month"), "{year}{month}.{variable}.tif").select("path", "year", "month", "variable").collect()
    assert sorted(map(tuple, got)) == [("a1", 2001, 1, "t2m"), ("a2", 2001, 2, "t2m")]


def test_periods_explanatory_and_mosaic(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, "p"), (2, 1.5, "q")], "id long, v double, period string")
    S.write_years(df, str(tmp_path / "t"), by="period")
    out = S.read_periods(spark, str(tmp_path / "t"), "id long, v double, period string", ["q"])
    assert [tuple(r) for r in out.collect()] == [(2, 1.5, "q")] and "PartitionFilters: [" in out._jdf.queryExecution().executedPlan().toString()
    other = spark.createDataFrame([(1, "p", 7, 8)], "id long, period string, pop int, unused int")
    classes = spark.createDataFrame([(1, "p", "natural", 3), (1, "p", "anthropic", 4)], "id long, period string, class_val string, v int")
    topo = spark.createDataFrame([(1, 9), (2, 9)], "id long, slope int")
    got = S.explanatory([df, other], classes, topo, "p", ["v", "pop", "cell_v", "slope"])
    assert got.columns == ["id", "v", "pop", "cell_v", "slope"] and [tuple(r) for r in got.collect()] == [(1, 0.5, 7, 3, 9)]
    a = spark.createDataFrame([(0, 0, 1), (300, 0, 1)], "row int, col int, value int")
    b = spark.createDataFrame([(0, 0, 2), (0, 1, 2)], "row int, col int, value int")
    for _ in range(2):
        S.write_mosaic([a, b], str(tmp_path / "m"))
    assert sorted((r["row"], r["col"], r["value"], r["band"]) for r in spark.read.parquet(str(tmp_path / "m")).collect()) == [(0, 0, 1, 0), (0, 1, 2, 0), (300, 0, 1, 1)]
