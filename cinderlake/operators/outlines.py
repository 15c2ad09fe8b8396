"""Rasters and areas: outlines of labelled pixels as rings with holes, rasters as rows of binary tiles, and masked windows of them.

Pixel (row, col) is the square from (col, row) to (col + 1, row + 1).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from cinderlake.functions.storage import materialise
from cinderlake.operators.overlay import bounded, edges_of, flat, joined, rings_in, stitch

#: Of a pixel's sides: where the neighbour lies, and from which corner to which the side runs with the pixel on its left.
SIDES = (((-1, 0), (0, 0), (1, 0)), ((0, 1), (1, 0), (1, 1)), ((1, 0), (1, 1), (0, 1)), ((0, -1), (0, 1), (0, 0)))


def traced(row: np.ndarray, col: np.ndarray, label: np.ndarray, own: np.ndarray, tile: int) -> Iterator[tuple]:
    """label, closed, xs, ys of the chains around the pixels of one tile (own); the others are the rim of the tiles around."""
    r0, c0 = row[own][0] // tile * tile, col[own][0] // tile * tile
    names, code = np.unique(label, return_inverse=True)
    grid = np.full((tile + 2, tile + 2), -1)
    grid[row - r0 + 1, col - c0 + 1] = code
    r, c, k = row[own], col[own], code[own]
    pieces, of = [], []
    for (dr, dc), (x0, y0), (x1, y1) in SIDES:
        out = grid[r - r0 + 1 + dr, c - c0 + 1 + dc] != k
        pieces.append(np.stack([c[out] + x0, r[out] + y0, c[out] + x1, r[out] + y1], 1))
        of.append(k[out])
    every, of_label = np.concatenate(pieces).astype(float).reshape(-1, 2, 2), np.concatenate(of)
    by = np.argsort(of_label, kind="stable")
    cuts = np.flatnonzero(np.diff(of_label[by])) + 1
    border = lambda p: p[0] in (c0, c0 + tile) or p[1] in (r0, r0 + tile)
    for mine in np.split(by, cuts):
        if len(mine):
            rings, open_ = joined(list(every[mine]), border)
            for closed, chains in ((True, rings), (False, open_)):
                yield from ((int(names[of_label[mine[0]]]), closed, c[:, 0].tolist(), c[:, 1].tolist()) for c in chains)


class TileOutlines:
    """Table function: the pixels of one tile to the chains around its patches."""

    def eval(self, row: list, col: list, label: list, own: list, tile: int):
        yield from traced(np.array(row), np.array(col), np.array(label), np.array(own, bool), tile)


def outlines(pixels: DataFrame, keys: Sequence[str], label: str = "patch", tile: int = 256) -> DataFrame:
    """§2.15: keys, label, ring, area (holes negative) of the outlines of pixels (keys, row, col, label), a pixel once for each
    value of keys. Rings touch at corners and do not cross; no edge at a tile's border stays.

    Pixels on a tile's rim also go to the tiles around, so each tile knows all neighbours. A table function traces each tile;
    chains that end at borders are stitched, label by label."""
    keys = list(keys)
    trace = udtf(TileOutlines, returnType="label bigint, closed boolean, xs array<double>, ys array<double>")
    steps = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (-1, 0, 1) for c in (-1, 0, 1)])
    at = lambda c, s: F.floor((F.col(c) + s) / tile)
    there = F.array_distinct(F.transform(steps, lambda s: F.struct(at("row", s["r"]).alias("r"), at("col", s["c"]).alias("c"))))
    sent = pixels.select(*keys, "row", "col", F.col(label).cast("long").alias("label"), F.explode(there).alias("t"))
    sent = sent.withColumn("own", (F.col("t.r") == at("row", 0)) & (F.col("t.c") == at("col", 0)))
    tiles = sent.groupBy(*keys, "t").agg(F.collect_list(F.struct("row", "col", "label", "own")).alias("p")).where(F.exists("p", lambda p: p["own"]))
    chains = tiles.lateralJoin(trace(*[F.col(f"p.{c}").outer() for c in ("row", "col", "label", "own")], F.lit(tile)))
    return stitch(materialise(chains.select(*keys, "label", "closed", "xs", "ys"), "outlines"), [*keys, "label"]).withColumnRenamed("label", label)


def tiled(pixels: DataFrame, keys: Sequence[str], tile: int = 256, nodata: int = -32768) -> DataFrame:
    """keys, tr, tc, data: a raster (keys, row, col, value) as little-endian int16 tiles of tile x tile pixels, row by row."""
    keys = list(keys)
    kinds = {f.name: f.dataType.simpleString() for f in pixels.schema.fields}

    def one(part: pd.DataFrame) -> pd.DataFrame:
        data = np.full((tile, tile), nodata, "<i2")
        data[part["row"] % tile, part["col"] % tile] = part["value"]
        first = part.iloc[:1]
        return first[[*keys, "tr", "tc"]].assign(data=[data.tobytes()])

    rows = pixels.select(*keys, "row", "col", "value").where("value IS NOT NULL").withColumns({"tr": F.floor(F.col("row") / tile), "tc": F.floor(F.col("col") / tile)})
    return rows.groupBy(*keys, "tr", "tc").applyInPandas(one, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "tr bigint, tc bigint, data binary"]))


def row_spans(edges: np.ndarray, r0: int, c0: int, tile: int) -> np.ndarray:
    """Which pixels of a tile have their centre in an area, by the spans between its edges on each row of centres."""
    y = r0 + np.arange(tile) + 0.5
    x0, y0, x1, y1 = edges.T
    on = (y0[None] > y[:, None]) != (y1[None] > y[:, None])
    row, e = np.nonzero(on)
    x = x0[e] + (y[row] - y0[e]) / (y1[e] - y0[e]) * (x1[e] - x0[e])
    turns = np.zeros((tile, tile + 1), int)
    np.add.at(turns, (row, np.clip(np.ceil(x - 0.5).astype(int) - c0, 0, tile)), 1)
    return np.cumsum(turns, 1)[:, :tile] % 2 == 1


def masked_window(tiles: DataFrame, areas: DataFrame, keys: Sequence[str], tile: int = 256, nodata: int = -32768) -> DataFrame:
    """Keys, id, row, col, value of the raster's pixels (tiled()) whose centre lies in an area (id, rings), nodata left out.

    Tiles are chosen by the areas' bounds in a join, before any is decoded; only the tiles' binary column goes to tasks."""
    keys = list(keys)
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / tile), F.floor(F.col(hi) / tile))
    wanted = bounded(areas).withColumn("tr", F.explode(span("miny", "maxy"))).withColumn("tc", F.explode(span("minx", "maxx")))
    shapes = wanted.withColumn("_f", flat("rings")).select("id", "tr", "tc", F.col("_f.x").alias("_x"), F.col("_f.y").alias("_y"), F.col("_f.n").alias("_n"))
    kinds = {f.name: f.dataType.simpleString() for f in [*tiles.schema.fields, *areas.schema.fields]}

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(len(batch)):
                one = batch.iloc[k]
                r0, c0 = int(one.tr) * tile, int(one.tc) * tile
                data = np.frombuffer(one["data"], "<i2").reshape(tile, tile)
                r, c = np.nonzero(row_spans(edges_of(rings_in(one._x, one._y, one._n)), r0, c0, tile) & (data != nodata))
                yield batch[[*keys, "id"]].iloc[[k] * len(r)].reset_index(drop=True).assign(row=r + r0, col=c + c0, value=data[r, c].astype(int))

    met = tiles.join(shapes, ["tr", "tc"]).select(*keys, "id", "tr", "tc", "data", "_x", "_y", "_n")
    return met.mapInPandas(decode, ", ".join([*(f"{k} {kinds[k]}" for k in [*keys, "id"]), "row bigint, col bigint, value int"]))
