"""Pixel tables (raster keys, row, col, value): patches, landscape metrics, terrain."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlake.functions.storage import materialise
from cinderlake.operators.graph import AROUND, FORWARD, components, neighbours, tile_labels


def label_patches(pixels: DataFrame, keys: Sequence[str], tile: int = 256) -> DataFrame:
    """Pixels (keys, px, row, col, value) with patch, the smallest pixel number of their 8-connected patch of
    equal value. Tiles are labelled one by one (a tile has tile x tile pixels at most); patches that touch across tile
    borders are then joined by components over border pairs only.
    """
    keys = list(keys)
    tiled = pixels.select(*keys, "px", "row", "col", "value", F.floor(F.col("row") / tile).alias("tr"), F.floor(F.col("col") / tile).alias("tc"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tiled.schema.fields) + ", local bigint"

    def one(part: pd.DataFrame) -> pd.DataFrame:
        return part.assign(local=tile_labels(part["px"].to_numpy(np.int64), part["row"].to_numpy(), part["col"].to_numpy(), FORWARD, part["value"].to_numpy()))

    local = materialise(tiled.groupBy(*keys, "tr", "tc").applyInPandas(one, schema), "tiles")
    local = local.withColumn("node", F.struct(*keys, "local"))
    border = local.where(f"row % {tile} IN (0, {tile - 1}) OR col % {tile} IN (0, {tile - 1})").withColumn("cell", F.struct("node", "value", "tr", "tc"))
    pairs = neighbours(border.hint("merge"), keys, FORWARD, "cell").where("src.value = dst.value AND (src.tr <> dst.tr OR src.tc <> dst.tc) AND src.node <> dst.node")
    labels = components(pairs.select(F.col("src.node").alias("a"), F.col("dst.node").alias("b")).distinct())
    joined = local.join(labels, "node", "left").withColumn("patch", F.coalesce("label", "node")["local"])
    return joined.select(*keys, "px", "row", "col", "value", "patch")


def edge_counts(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, value, edges: sides between 4-neighbours of other value, counted for each of the two values."""
    keys = list(keys)
    named = pixels.withColumn("cell", F.col("value"))
    pairs = neighbours(named, keys, ((0, 1), (1, 0)), "cell").where("src <> dst")
    both = pairs.select(*keys, F.explode(F.array("src", "dst")).alias("value"))
    return both.groupBy(*keys, "value").agg(F.count("*").alias("edges"))


def class_metrics(pixels: DataFrame, keys: Sequence[str], side_m: float = 30.0, tile: int = 256) -> DataFrame:
    """Area (ha), patches, density per 100 ha, share, largest patch, edge (m) and density, mean, median and CV of patch area."""
    keys = list(keys)
    ha = side_m * side_m / 10_000
    patches = label_patches(pixels, keys, tile).groupBy(*keys, "value", "patch").agg((F.count("*") * ha).alias("area"))
    total = patches.groupBy(*keys).agg(F.sum("area").alias("landscape"))
    per = patches.groupBy(*keys, "value").agg(
        F.sum("area").alias("total_area"), F.count("*").alias("number_of_patches"), F.max("area").alias("largest"), F.avg("area").alias("area_mn"),
        F.percentile("area", 0.5).alias("area_md"), F.stddev_pop("area").alias("sd"),
    )
    out = per.join(total, keys).join(edge_counts(pixels, keys), [*keys, "value"], "left")
    edge = F.coalesce("edges", F.lit(0)) * side_m
    return out.select(
        *keys, "value", "total_area", "number_of_patches", (F.col("number_of_patches") / F.col("landscape") * 100).alias("patch_density"),
        (F.col("total_area") / F.col("landscape") * 100).alias("proportion_of_landscape"), (F.col("largest") / F.col("landscape") * 100).alias("largest_patch_index"),
        edge.alias("total_edge"), (edge / F.col("landscape")).alias("edge_density"), "area_mn", "area_md", (F.col("sd") / F.col("area_mn") * 100).alias("area_cv"),
    )


def landscape_metrics(pixels: DataFrame, keys: Sequence[str], side_m: float = 30.0, tile: int = 256) -> DataFrame:
    """The same over all classes; the shape index is 0.25 * edge / root of area, edges between classes only."""
    keys = list(keys)
    ha = side_m * side_m / 10_000
    patches = label_patches(pixels, keys, tile).groupBy(*keys, "value", "patch").agg((F.count("*") * ha).alias("area"))
    per = patches.groupBy(*keys).agg(F.sum("area").alias("total_area"), F.count("*").alias("number_of_patches"), F.avg("area").alias("area_mn"), F.stddev_pop("area").alias("sd"))
    edges = edge_counts(pixels, keys).groupBy(*keys).agg((F.sum("edges") / 2 * side_m).alias("total_edge"))
    out = per.join(edges, keys, "left").withColumn("total_edge", F.coalesce("total_edge", F.lit(0.0)))
    return out.select(
        *keys, "total_area", "number_of_patches", (F.col("number_of_patches") / F.col("total_area") * 100).alias("patch_density"), "total_edge",
        (F.col("total_edge") / F.col("total_area")).alias("edge_density"), (0.25 * F.col("total_edge") / F.sqrt(F.col("total_area") * 10_000)).alias("landscape_shape_index"),
        "area_mn", (F.col("sd") / F.col("area_mn") * 100).alias("area_cv"),
    )


def terrain(pixels: DataFrame, keys: Sequence[str], side: float = 1.0) -> DataFrame:
    """Roughness (range of the 3 x 3 window), ruggedness (mean absolute difference to the eight neighbours) and Horn's slope
    in degrees, of every pixel. Windows at borders are extrapolated: a missing row is twice the middle one less the opposite
    one, with the nearest columns that exist; a missing side pixel likewise from its row. Where the opposite is missing too,
    the middle stands for both. One exchange: every pixel sends its value to its nine windows."""
    keys = list(keys)
    steps = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((0, 0), *AROUND)])
    sent = pixels.select(*keys, "row", "col", "value", F.explode(steps).alias("_s"))
    sent = sent.select(*keys, (F.col("row") - F.col("_s.r")).alias("row"), (F.col("col") - F.col("_s.c")).alias("col"), "value", F.col("_s.r").alias("_r"), F.col("_s.c").alias("_c"))
    cell = lambda r, c: F.max(F.when((F.col("_r") == r) & (F.col("_c") == c), F.col("value")))
    g = sent.groupBy(*keys, "row", "col").agg(*[cell(r, c).alias(f"v{r + 1}{c + 1}") for r in (-1, 0, 1) for c in (-1, 0, 1)]).where("v11 IS NOT NULL")
    v = lambda r, c: F.col(f"v{r}{c}")
    beyond = lambda middle, opposite: F.coalesce(2 * middle - opposite, middle)
    level = {(r, c): F.coalesce(v(r, c), v(r, 1)) for r in range(3) for c in range(3)}  # columns that exist
    at_line = v(0, 1).isNull() | v(2, 1).isNull()
    lined = {(r, c): F.coalesce(level[r, c], beyond(level[1, c], level[2 - r, c])) for r in range(3) for c in range(3)}
    sided = {(r, c): F.coalesce(v(r, c), beyond(v(r, 1), v(r, 2 - c))) for r in range(3) for c in range(3)}
    g = g.select(*keys, "row", "col", *[F.when(at_line, lined[r, c]).otherwise(sided[r, c]).cast("double").alias(f"v{r}{c}") for r in range(3) for c in range(3)])
    every = [v(r, c) for r in range(3) for c in range(3)]
    gaps = sum((F.abs(x - v(1, 1)) for x in every), F.lit(0.0))
    dx = (v(0, 2) + 2 * v(1, 2) + v(2, 2) - v(0, 0) - 2 * v(1, 0) - v(2, 0)) / (8 * side)
    dy = (v(2, 0) + 2 * v(2, 1) + v(2, 2) - v(0, 0) - 2 * v(0, 1) - v(0, 2)) / (8 * side)
    return g.select(*keys, "row", "col", (F.greatest(*every) - F.least(*every)).alias("roughness"), (gaps / 8).alias("tri"), F.degrees(F.atan(F.sqrt(dx * dx + dy * dy))).alias("slope"))
