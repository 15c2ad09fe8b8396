"""Silhouettes are those of whole vectors."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from cinderlake.operators import multivariate as M
from cinderlake.plans import registry
from tests.compare import duck_rows, spark_rows

SCHEMA = "vec_id long, embedding array<float>, label int"


def _widths(x, y):
    far, out = np.array([np.sqrt(((x - p) ** 2).sum(1)) for p in x]), []
    for k in range(len(x)):
        inn, apart = far[k, y == y[k]].sum() / ((y == y[k]).sum() - 1), min(far[k, y == c].mean() for c in set(y) - {y[k]})
        out.append((apart - inn) / max(apart, inn))
    return out


def _same(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    got = spark_rows(registry.queries()["silhouette"](spark, str(folder)))
    assert got == duck_rows(con, registry.oracle_sql()["silhouette"])
    return got[1:]


@pytest.mark.parametrize("d", [5, 64, 70])
def test_all_numbers_of_a_vector_count(spark, tmp_path, d):
    rng = np.random.default_rng(d)
    x, y = rng.normal(size=(60, d)).astype(np.float32), np.arange(60) % 3
    x[:, :4], x[:, -1] = 0, 9 * y
    got = _same(spark, tmp_path, [(k, p.tolist(), int(c)) for k, (p, c) in enumerate(zip(x, y, strict=True))])
    want = dict(enumerate(_widths(x.astype(float), y)))
    assert len(got) == 60 and all(abs(float(s) - want[int(k)]) < 1e-5 for k, _, s in got)


def test_the_query_uses_all_numbers_of_the_given_table(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").collect()
    x, y = np.array([r["embedding"] for r in rows], float), np.array([r["label"] for r in rows])
    want = {r["vec_id"]: s for r, s in zip(rows, _widths(x, y), strict=True)}
    got = registry.queries()["silhouette"](spark, data).collect()
    assert len(got) == len(rows) and all(abs(r["silhouette"] - want[r["id"]]) < 2e-6 for r in got)


@pytest.mark.parametrize("d", [2, 12])
def test_missing_numbers_labels_and_other_lengths(spark, tmp_path, d):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=d).tolist(), k % 3) for k in range(20)]
    rows += [(20, None, 0), (21, [None, *rows[1][1][1:]], 1), (22, [], 1), (23, rows[2][1] + [1.0], 2), (24, rows[3][1] + [2.0], 2), (25, rows[3][1], None), (26, rows[4][1], 7), (27, None, 8), (28, rows[5][1], 2)]
    got = {int(k): s for k, _, s in _same(spark, tmp_path, rows)}
    assert len(got) == 29 and {got[k] for k in (20, 21, 22)} == {"NULL"} and {got[k] for k in (25, 26, 27)} == {"0.000000"}


@pytest.mark.parametrize("d", [3, 12])
def test_values_that_are_not_finite(spark, tmp_path, d):
    x = np.random.default_rng(5).normal(size=(40, d))
    x[3, 1], x[7, 2], x[8, 2], x[9, 0] = np.nan, np.inf, np.inf, -np.inf
    _same(spark, tmp_path, [(k, p.tolist(), k % 3) for k, p in enumerate(x)])


def test_an_empty_table_and_labels_all_missing(spark, tmp_path):
    assert _same(spark, tmp_path / "none", []) == []
    assert [s for *_, s in _same(spark, tmp_path / "bare", [(1, [1.0] * 9, None), (2, [2.0] * 9, None)])] == ["0.000000"] * 2


def test_near_points_far_from_the_origin_keep_their_distances(spark):
    rng = np.random.default_rng(8)
    y = np.arange(300) % 3
    x = 1e6 + rng.normal(size=(300, 12)) * 1e-3 + 1e-3 * y[:, None]
    x[0] += 5e6
    x[4] = x[1]
    df = spark.createDataFrame([(k, f"c{c}", p.tolist()) for k, (p, c) in enumerate(zip(x, y, strict=True))], "id long, kind string, v array<double>")
    got = {r["id"]: r["silhouette"] for r in M.silhouette(df, "kind", "v", size=50).collect()}
    assert [got[k] for k in range(300)] == pytest.approx(_widths(x, y), abs=1e-9)
