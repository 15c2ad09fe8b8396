"""Outlines of patches and masked windows against pixel counts."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderlake.operators import outlines as O
from cinderlake.operators import overlay as V


@pytest.mark.parametrize("tile", [1, 4, 64])
def test_outlines_of_random_labels(spark, tile):
    grid = np.random.default_rng(4).integers(0, 3, (13, 17))
    grid[3:9, 4:12] = 5
    grid[5:7, 6:9] = 1
    rows = [(1, r - 6, c - 5, int(grid[r, c]) - 1) for r in range(13) for c in range(17) if r > 2 or (r + c) % 5] + [(2, 0, 0, 7)]
    df = spark.createDataFrame(rows, "scene int, row int, col int, patch long")
    got = O.outlines(df, ["scene"], tile=tile).collect()
    at = {(s, r, c): v for s, r, c, v in rows}
    for scene, label in {(s, v) for s, _, _, v in rows}:
        mine = [x for x in got if (x["scene"], x["patch"]) == (scene, label)]
        pixels = [(r, c) for s, r, c, v in rows if (s, v) == (scene, label)]
        assert sum(x["area"] for x in mine) == pytest.approx(len(pixels))
        sides = sum(at.get((scene, r + a, c + b)) != label for r, c in pixels for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)))
        points = [np.array([(p["x"], p["y"]) for p in x["ring"]]) for x in mine]
        assert sum(np.abs(p - np.roll(p, -1, 0)).sum() for p in points) == sides
        assert all(len({tuple(q) for q in p.tolist()}) == len(p) for p in points)
    assert any(x["area"] < 0 for x in got)


def test_outlines_agree_with_areas(spark):
    mask = np.random.default_rng(5).random((20, 20)) < 0.6
    rows = [(int(r), int(c), 1) for r, c in zip(*np.nonzero(mask), strict=True)]
    found = O.outlines(spark.createDataFrame(rows, "row int, col int, patch int"), [], tile=7)
    whole = found.agg(F.collect_list("ring").alias("rings")).select(V.area("rings")).first()[0]
    assert whole == pytest.approx(mask.sum())
    assert O.outlines(spark.createDataFrame([], "row int, col int, patch int"), []).count() == 0


def test_masked_windows_of_slanted_areas_with_holes(spark):
    values = np.random.default_rng(6).integers(-300, 300, (30, 40))
    rows = [(1, r - 10, c - 20, int(values[r, c])) for r in range(30) for c in range(40)]
    rings = [[(-15.3, -8.1), (14.2, -9.7), (17.9, 12.4), (-3.3, 18.8), (-17.2, 6.6)], [(-4.1, -3.2), (6.3, -2.2), (3.9, 5.8)]]
    shape = [[{"x": x, "y": y} for x, y in r] for r in rings]
    areas = spark.createDataFrame([(1, shape), (2, []), (3, [[{"x": 900.0, "y": 0.0}, {"x": 901.0, "y": 0.0}, {"x": 900.0, "y": 1.0}]])], f"id int, rings {V.RINGS}")
    tiles = O.tiled(spark.createDataFrame(rows, "scene int, row int, col int, value int"), ["scene"], 8, nodata=-999)
    got = {(r["id"], r["row"], r["col"]): r["value"] for r in O.masked_window(tiles, areas, ["scene"], 8, nodata=-999).collect()}
    edges = V.edges_of([V.snapped(r) for r in rings])
    inside = V.Cut(edges, np.zeros(len(edges), int)).inside(np.array([(c + 0.5, r + 0.5) for _, r, c, _ in rows]))[:, 0]
    assert got == {(1, r, c): v for (_, r, c, v), ok in zip(rows, inside, strict=True) if ok}
