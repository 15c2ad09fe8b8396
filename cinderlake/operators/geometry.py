"""Plane geometry: areas as expressions; centroids, relations and clipping (by convex rings) of polygons in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

Ring = list[tuple[float, float]]


def shoelace(ring: Ring) -> float:
    """Signed area, positive if counter-clockwise."""
    p = np.asarray(ring, float)
    x, y = p[:, 0], p[:, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def centroid(ring: Ring) -> tuple[float, float]:
    p = np.asarray(ring, float)
    x, y, x1, y1 = p[:, 0], p[:, 1], np.roll(p[:, 0], -1), np.roll(p[:, 1], -1)
    cross = x * y1 - x1 * y
    area = cross.sum() / 2
    if area == 0:
        return float(x.mean()), float(y.mean())
    return float(((x + x1) * cross).sum() / (6 * area)), float(((y + y1) * cross).sum() / (6 * area))


def clip(ring: Ring, window: Ring) -> Ring:
    """The part of ring inside a convex window, side by side of the window."""
    if shoelace(window) < 0:
        window = window[::-1]
    out = list(ring)
    for (ax, ay), (bx, by) in zip(window, window[1:] + window[:1], strict=True):
        inside = lambda p: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax) >= 0  # noqa: E731, B023
        kept: Ring = []
        for p, q in zip(out, out[1:] + out[:1], strict=True):
            if inside(p):
                kept.append(p)
            if inside(p) != inside(q):
                den = (bx - ax) * (q[1] - p[1]) - (by - ay) * (q[0] - p[0])
                t = ((by - ay) * (p[0] - ax) - (bx - ax) * (p[1] - ay)) / den
                kept.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        out = kept
        if not out:
            break
    return out


def _ring(points) -> Ring:
    return [(p["x"], p["y"]) for p in points]


def ring_area(ring: Column | str) -> Column:
    """Area of a ring by the shoelace formula, as an expression; fewer than three points have none."""
    ring = F.col(ring) if isinstance(ring, str) else ring
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    twice = F.aggregate(F.zip_with(ring, after, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(ring) > 2, F.abs(twice) / 2).otherwise(0.0)


@F.pandas_udf(DoubleType())
def clipped_area(rings: pd.Series, windows: pd.Series) -> pd.Series:
    """Area of each ring inside its convex window."""

    def one(r, w) -> float:
        part = clip(_ring(r), _ring(w)) if r is not None and w is not None else []
        return abs(shoelace(part)) if len(part) > 2 else 0.0

    return pd.Series([one(r, w) for r, w in zip(rings, windows, strict=True)])


MEET, INSIDE, A_OUT, B_OUT = 1, 2, 4, 8
#: F12, as conditions on the bits of relation(). Areas never cross in the sense of the predicate, which is for lines.
PREDICATES = {
    "intersects": lambda r: r.bitwiseAND(F.lit(MEET | INSIDE)) != 0,
    "touches": lambda r: (r.bitwiseAND(F.lit(MEET)) != 0) & (r.bitwiseAND(F.lit(INSIDE)) == 0),
    "within": lambda r: (r.bitwiseAND(F.lit(INSIDE)) != 0) & (r.bitwiseAND(F.lit(A_OUT)) == 0),
    "contains": lambda r: (r.bitwiseAND(F.lit(INSIDE)) != 0) & (r.bitwiseAND(F.lit(B_OUT)) == 0),
    "overlaps": lambda r: (r.bitwiseAND(F.lit(INSIDE)) != 0) & (r.bitwiseAND(F.lit(A_OUT)) != 0) & (r.bitwiseAND(F.lit(B_OUT)) != 0),
    "equals": lambda r: (r.bitwiseAND(F.lit(INSIDE)) != 0) & (r.bitwiseAND(F.lit(A_OUT | B_OUT)) == 0),
    "crosses": lambda r: F.lit(False),
    "bounds": lambda r: F.lit(True),
}


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]


def _sides(points: np.ndarray, ring: np.ndarray, eps: float) -> np.ndarray:
    """1 inside the ring, 0 on it, -1 outside."""
    p, q = ring, np.roll(ring, -1, 0)
    off, way = points[:, None] - p[None], (q - p)[None]
    length = (way**2).sum(-1)
    t = np.clip((off * way).sum(-1) / np.where(length > 0, length, 1), 0, 1)
    on = (((off - t[..., None] * way) ** 2).sum(-1) <= eps * eps).any(1)
    above = p[None, :, 1] > points[:, None, 1]
    spans = above != (q[None, :, 1] > points[:, None, 1])
    with np.errstate(divide="ignore", invalid="ignore"):
        at = p[None, :, 0] + (points[:, None, 1] - p[None, :, 1]) * way[..., 0] / way[..., 1]
    inside = (spans & (points[:, None, 0] < at)).sum(1) % 2 == 1
    return np.where(on, 0, np.where(inside, 1, -1))


def _pieces(a: np.ndarray, b: np.ndarray, eps: float) -> tuple[np.ndarray, bool]:
    """Middles of the pieces that b's edges cut a's edges into, and whether the two rings have a point in common."""
    p, d = a, np.roll(a, -1, 0) - a
    q, e = b, np.roll(b, -1, 0) - b
    gap = q[None] - p[:, None]
    den = _cross(d[:, None], e[None])
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = _cross(gap, e[None]) / den, _cross(gap, d[:, None]) / den
    long_d, long_e = np.sqrt((d**2).sum(1)), np.sqrt((e**2).sum(1))
    slack_d, slack_e = eps / np.maximum(long_d, eps)[:, None], eps / np.maximum(long_e, eps)[None]
    hit = (np.abs(den) > 1e-14 * long_d[:, None] * long_e[None]) & (t >= -slack_d) & (t <= 1 + slack_d) & (u >= -slack_e) & (u <= 1 + slack_e)
    ends = ((q[None] - p[:, None]) * d[:, None]).sum(-1) / np.maximum((d**2).sum(1), eps * eps)[:, None]  # b's corners along a's edges
    near = (((p[:, None] + np.clip(ends, 0, 1)[..., None] * d[:, None] - q[None]) ** 2).sum(-1) <= eps * eps)
    middles = []
    for i in range(len(a)):
        cuts = np.unique(np.clip(np.concatenate([[0, 1], t[i][hit[i]], ends[i][near[i]]]), 0, 1))
        cuts = cuts[np.concatenate([[True], np.diff(cuts) * long_d[i] > 2 * eps])]
        if cuts[-1] < 1:
            cuts = np.append(cuts, 1.0)
        middles.append(p[i] + ((cuts[1:] + cuts[:-1]) / 2)[:, None] * d[i])
    return np.concatenate(middles), bool(hit.any() or near.any())


def relate(a: Ring, b: Ring) -> int:
    """How two simple rings lie to each other: bits MEET (a point of the borders in common), INSIDE (interiors in common),
    A_OUT and B_OUT (a part of a's, of b's border lies outside the other)."""
    x, y = np.asarray(a, float), np.asarray(b, float)
    if len(x) < 3 or len(y) < 3:
        return A_OUT | B_OUT
    eps = 1e-12 * max(1.0, np.abs(x).max(), np.abs(y).max())
    mine, meet = _pieces(x, y, eps)
    other, met = _pieces(y, x, eps)
    s, o = _sides(mine, y, eps), _sides(other, x, eps)
    same = not (s != 0).any() and not (o != 0).any()
    return MEET * (meet or met) | INSIDE * bool((s > 0).any() or (o > 0).any() or same) | A_OUT * bool((s < 0).any()) | B_OUT * bool((o < 0).any())


@F.pandas_udf(IntegerType())
def relation(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([relate(_ring(x), _ring(y)) if x is not None and y is not None else 0 for x, y in zip(a, b, strict=True)], dtype="int32")


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1))


def bounds(ring: Column) -> list[Column]:
    x, y = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return [F.array_min(x).alias("minx"), F.array_min(y).alias("miny"), F.array_max(x).alias("maxx"), F.array_max(y).alias("maxy")]


def tiles_of(df: DataFrame, tile: float) -> DataFrame:
    """A row for each tile that the bounds touch: the equi-join key of spatial joins."""
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / tile), F.floor(F.col(hi) / tile))
    return df.withColumn("tx", F.explode(span("minx", "maxx"))).withColumn("ty", F.explode(span("miny", "maxy")))


def spatial_join(a: DataFrame, b: DataFrame, tile: float, predicate: str = "intersects") -> DataFrame:
    """Pairs a(a_id, a_ring), b(b_id, b_ring) for which the predicate holds (one of PREDICATES; "bounds" asks for
    bounds that meet only).

    Candidates are pairs whose bounds meet, by an equi-join on tiles; a pair is made once, in the tile that holds the lower
    corner of the common bounds, so no distinct is needed. Rings of candidates are then compared in Arrow batches.
    """
    left = tiles_of(a.select("a_id", "a_ring", *bounds(F.col("a_ring"))), tile)
    right = tiles_of(b.select("b_id", "b_ring", *bounds(F.col("b_ring"))), tile).withColumnsRenamed({c: f"o_{c}" for c in ("minx", "miny", "maxx", "maxy")})
    meet = left.join(right, ["tx", "ty"]).where("minx <= o_maxx AND o_minx <= maxx AND miny <= o_maxy AND o_miny <= maxy")
    own = (F.floor(F.greatest("minx", "o_minx") / tile) == F.col("tx")) & (F.floor(F.greatest("miny", "o_miny") / tile) == F.col("ty"))
    pairs = meet.where(own).select("a_id", "a_ring", "b_id", "b_ring")
    if predicate == "bounds":
        return pairs
    return pairs.withColumn("_relation", relation("a_ring", "b_ring")).where(PREDICATES[predicate](F.col("_relation"))).drop("_relation")


def border_flags(areas: DataFrame, border: DataFrame, tile: float) -> DataFrame:
    """Id and border (1 where an area meets a border ring and does not lie within it, 0 otherwise)."""
    pairs = spatial_join(areas.select(F.col("id").alias("a_id"), F.col("ring").alias("a_ring")), border.select(F.col("id").alias("b_id"), F.col("ring").alias("b_ring")), tile, "bounds")
    cut = pairs.where(relation("a_ring", "b_ring").bitwiseAND(F.lit(MEET)) != 0).select(F.col("a_id").alias("id")).distinct().withColumn("border", F.lit(1))
    return areas.select("id").join(cut, "id", "left").withColumn("border", F.coalesce("border", F.lit(0)))


def grid_cells(cells: DataFrame, region: DataFrame, tile: float) -> DataFrame:
    """Of the cells that meet the region's parts (rings without common interior): id, within (1 if one part holds all of it),
    clip_area, pct_area, lon, lat (centre of the cell). Cells are convex."""
    pairs = spatial_join(region.select(F.col("id").alias("a_id"), F.col("ring").alias("a_ring")), cells.select(F.col("id").alias("b_id"), F.col("ring").alias("b_ring")), tile, "bounds")
    known = pairs.select(F.col("b_id").alias("id"), "b_ring", relation("b_ring", "a_ring").alias("_relation"), clipped_area("a_ring", "b_ring").alias("part"))
    found = known.groupBy("id").agg(F.max(PREDICATES["within"](F.col("_relation")).cast("int")).alias("within"), F.sum("part").alias("clip_area"), F.first("b_ring").alias("ring")).where("clip_area > 0")
    mean = lambda k: F.aggregate(F.transform("ring", lambda p: p[k]), F.lit(0.0), lambda s, v: s + v) / F.size("ring")
    return found.select("id", "within", "clip_area", (100 * F.col("clip_area") / ring_area("ring")).alias("pct_area"), mean("x").alias("lon"), mean("y").alias("lat"))


def clip_fractions(cells: DataFrame, areas: DataFrame, tile: float) -> DataFrame:
    """Share of each cell (convex) covered by each area it meets."""
    pairs = spatial_join(areas.select(F.col("id").alias("a_id"), F.col("ring").alias("a_ring")), cells.select(F.col("id").alias("b_id"), F.col("ring").alias("b_ring")), tile, "bounds")
    return pairs.select(F.col("b_id").alias("cell"), F.col("a_id").alias("area"), (clipped_area("a_ring", "b_ring") / ring_area("b_ring")).alias("frac")).where("frac > 0")
