"""Worked monthly series: peaks, quantiles, lengths and concentration, with ties, zeros and wraps."""

from __future__ import annotations

import pytest

from cinderlake.functions import months as M
from cinderlake.operators import season as S

UNITS = 1_000_000
S1 = [0, 0, 0, 0.9, 1.8, 3.6, 9, 18, 13.5, 4.5, 0.9, 0]
S2 = [9, 1.8, 0, 0, 0, 0, 0, 0, 0, 0.9, 4.5, 18]
S3 = [0, 0, 0, 0, 0, 0, 0, 5.4, 5.4, 0, 0, 0]


@pytest.fixture(scope="module")
def fires(spark):
    rows = [(k, "p", m + 1, round(v * UNITS)) for k, s in enumerate((S1, S2, S3, [0.0] * 12)) for m, v in enumerate(s)]
    return spark.createDataFrame(rows, "id int, period string, month int, units long")


def by_id(df):
    return {r["id"]: r for r in df.collect()}


def test_peak_first_on_ties_null_on_zero(fires):
    got = by_id(S.peak(fires))
    assert [got[k]["peak_month"] for k in range(4)] == [8, 12, 8, None]


def test_quantiles_nearest(fires):
    got = by_id(S.quantiles_nearest(fires))
    assert [tuple(got[k])[2:] for k in range(3)] == [(5, 8, 10, 6), (10, 12, 1, 4), (3, 8, 9, 7)]
    assert tuple(got[3])[2:] == (None, None, None, None)


def test_quantiles_smoothed(fires):
    got = by_id(S.quantiles_smoothed(fires))
    want = [(4.95, 7.6, 9.62, 4.67), (10.18, 11.65, 1.05, 2.87), (7.1, 8.0, 8.9, 1.8)]
    for k, w in enumerate(want):
        assert tuple(got[k])[2:] == pytest.approx(w, abs=0.01)


def test_ranking_and_concentration(fires):
    assert [by_id(S.ranking(fires))[k]["length_ranking_80"] for k in range(4)] == [3, 2, 1, None]
    got = by_id(S.concentration(fires))
    assert [got[k]["ci"] for k in range(3)] == pytest.approx([78.750469, 91.195375, 96.592583], abs=1e-5)
    assert [got[k]["peak_ci"] for k in range(4)] == [8, 12, 8, None]


def test_wrap_keeps_fractions(spark):
    from pyspark.sql import functions as F

    got = spark.range(1).select(*[M.wrap(F.lit(x)).alias(f"c{i}") for i, x in enumerate((12.7, 0.7, 5.0))]).first()
    assert tuple(got) == pytest.approx((0.7, 12.7, 5.0))


def test_upsert_keeps_rows_of_both_sides_and_new_values_win(spark):
    a = spark.createDataFrame([(1, "p", 1, None), (2, "p", 2, 5)], "id int, period string, x int, y int")
    b = spark.createDataFrame([(2, "p", 9), (3, "p", 7)], "id int, period string, y int")
    assert sorted(tuple(r) for r in S.upsert(a, b).select("id", "period", "x", "y").collect()) == [(1, "p", 1, None), (2, "p", 2, 9), (3, "p", None, 7)]
