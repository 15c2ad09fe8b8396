"""Queries of areas with holes, steps and parts, made from parts on a lattice, so that SQL can count their pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinderlake.operators import outlines as O
from cinderlake.operators import overlay as V
from cinderlake.operators import raster as R
from cinderlake.plans.build import query
from cinderlake.plans.spatial import _PATCH, _classes
from cinderlake.sources import adapters as A

TILE, WIDE = 24.0, 96.0
#: Pixels of the areas: a square, an L, a square with a hole, two squares that meet at a corner.
_SHAPES = """shapes AS (SELECT p_partkey AS id, p_brand AS brand, p_size AS size, 2 + p_size % 8 AS a, (3 + p_size % 8) // 2 AS h, p_partkey % 4 AS kind, 6 * (p_partkey % 50) AS x, 6 * (p_partkey // 50) AS y FROM part),
dots AS (SELECT *, unnest(range(a)) AS dx FROM shapes), dots2 AS (SELECT *, unnest(range(a)) AS dy FROM dots),
px AS (SELECT id, brand, size, kind, x + dx AS c, y + dy AS r FROM dots2 WHERE CASE kind WHEN 0 THEN TRUE WHEN 1 THEN NOT (dx >= h AND dy >= h) WHEN 2 THEN NOT (dx BETWEEN 1 AND a - 2 AND dy BETWEEN 1 AND a - 2) ELSE (dx < h) = (dy < h) END)"""
_SIDES = "(VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) s(dc, dr)"
_AROUND = "(SELECT unnest(range(-1, 2)) AS dc) u, (SELECT unnest(range(-1, 2)) AS dr) w"


def _square(x, y, x1, y1):
    corner = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    return F.array(corner(x, y), corner(x1, y), corner(x1, y1), corner(x, y1))


def shapes(spark, sf):
    """id, brand, size, kind, rings: the areas whose pixels _SHAPES counts."""
    k, s = F.col("p_partkey"), F.col("p_size")
    p = A.read(spark, sf, "part").select(k.cast("long").alias("id"), F.col("p_brand").alias("brand"), s.alias("size"), (k % 4).alias("kind"), (2 + s % 8).alias("a"), F.floor((3 + s % 8) / 2).alias("h"), (6 * (k % 50)).alias("x"), (6 * F.floor(k / 50)).alias("y"))
    x, y, a, h = (F.col(c) for c in "xyah")
    corner = lambda c, r: F.struct(c.cast("double").alias("x"), r.cast("double").alias("y"))
    whole = _square(x, y, x + a, y + a)
    step = F.array(corner(x, y), corner(x + a, y), corner(x + a, y + h), corner(x + h, y + h), corner(x + h, y + a), corner(x, y + a))
    hole = F.when(a > 2, F.array(whole, _square(x + 1, y + 1, x + a - 1, y + a - 1))).otherwise(F.array(whole))
    rings = F.when(F.col("kind") == 0, F.array(whole)).when(F.col("kind") == 1, F.array(step)).when(F.col("kind") == 2, hole).otherwise(F.array(_square(x, y, x + h, y + h), _square(x + h, y + h, x + a, y + a)))
    return p.select("id", "brand", "size", "kind", rings.alias("rings"))


_PAIRS = f"""rim AS (SELECT DISTINCT id, c + dc AS c, r + dr AS r FROM px, {_AROUND}), near AS (SELECT DISTINCT p.id AS a, q.id AS b FROM rim p JOIN px q USING (c, r) WHERE p.id <> q.id),
n AS (SELECT id, count(*) AS n FROM px GROUP BY id), com AS (SELECT p.id AS a, q.id AS b, count(*) AS common FROM px p JOIN px q USING (c, r) WHERE p.id <> q.id GROUP BY ALL)"""


@query("area_predicates", "a:l b:l touches:l within:l contains:l overlaps:l common:d", "", f"""
WITH {_SHAPES}, {_PAIRS} SELECT a, b, CAST(common IS NULL AS INT) AS touches, CAST(coalesce(common, 0) = m.n AS INT) AS within, CAST(coalesce(common, 0) = o.n AS INT) AS contains,
CAST(coalesce(common, 0) BETWEEN 1 AND least(m.n, o.n) - 1 AS INT) AS overlaps, coalesce(common, 0) AS common FROM near LEFT JOIN com USING (a, b) JOIN n m ON m.id = a JOIN n o ON o.id = b WHERE a < b""")
def area_predicates(spark, sf):
    """How areas with holes and parts that intersect lie to each other, and their common area."""
    s = shapes(spark, sf)
    pairs = V.meeting(s, s, TILE).where("a_id < b_id").withColumn("how", V.relation("a_rings", "b_rings"))
    flags = [V.PREDICATES[p](F.col("how.bits")).cast("int").alias(p) for p in ("touches", "within", "contains", "overlaps")]
    return pairs.where(V.PREDICATES["intersects"](F.col("how.bits"))).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), *flags, "how.common")


@query("within_join", "a:l b:l", "", f"WITH {_SHAPES}, n AS (SELECT id, count(*) AS n FROM px GROUP BY id) SELECT p.id AS a, q.id AS b FROM px p JOIN px q USING (c, r) JOIN n ON n.id = p.id WHERE p.id <> q.id GROUP BY p.id, q.id, n.n HAVING count(*) = n.n")
def within_join(spark, sf):
    """Areas and those that hold them."""
    s = shapes(spark, sf)
    return V.join_areas(s, s, TILE, "within").where("a_id <> b_id").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


@query("clip_concave", "cell:l area:l frac:d", "grid", f"""
WITH {_SHAPES}, inside AS (SELECT g.id AS cell, px.id AS area FROM px JOIN grid g ON c // 30 = g.col AND r // 12 = g.row WHERE NOT (c % 30 >= 15 AND r % 12 >= 6)) SELECT cell, area, count(*) / 270.0::DOUBLE AS frac FROM inside GROUP BY ALL""")
def clip_concave(spark, sf):
    """Shares of L-shaped cells covered by areas with holes."""
    g = A.grid(spark, sf).select("id", (30 * F.col("col")).alias("x"), (12 * F.col("row")).alias("y"))
    x, y = F.col("x"), F.col("y")
    corner = lambda c, r: F.struct(c.cast("double").alias("x"), r.cast("double").alias("y"))
    cells = g.select("id", F.array(F.array(corner(x, y), corner(x + 30, y), corner(x + 30, y + 6), corner(x + 15, y + 6), corner(x + 15, y + 12), corner(x, y + 12))).alias("rings"))
    return V.clip_fractions(cells, shapes(spark, sf), TILE)


def _measured(rings, keys):
    """Area and length of outline of each value of keys."""
    ring = F.col("ring")
    sides = F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)), lambda p, q: F.hypot(p["x"] - q["x"], p["y"] - q["y"]))
    return rings.groupBy(*keys).agg(F.sum("area").alias("area"), F.sum(F.aggregate(sides, F.lit(0.0), lambda s, v: s + v)).alias("outline"))


def _counted(pixels: str) -> str:
    return f"u AS (SELECT DISTINCT k, c, r FROM {pixels}), edge AS (SELECT u.k, count(*) AS n FROM u, {_SIDES} WHERE NOT EXISTS (SELECT 1 FROM u o WHERE o.k = u.k AND o.c = u.c + dc AND o.r = u.r + dr) GROUP BY u.k)"


@query("dissolve_areas", "brand:s area:d outline:d", "", f"WITH {_SHAPES}, p AS (SELECT brand AS k, c, r FROM px), {_counted('p')} SELECT k AS brand, count(*) AS area, any_value(edge.n) AS outline FROM u JOIN edge USING (k) GROUP BY k")
def dissolve_areas(spark, sf):
    """The union of each brand's areas, by tiles."""
    found = V.dissolve(shapes(spark, sf).withColumnRenamed("id", "owner"), ["brand"], WIDE)
    return _measured(found, ["brand"])


@query("buffer_areas", "brand:s area:d outline:d", "", f"WITH {_SHAPES}, p AS (SELECT brand AS k, c + dc AS c, r + dr AS r FROM px, {_AROUND}), {_counted('p')} SELECT k AS brand, count(*) AS area, any_value(edge.n) AS outline FROM u JOIN edge USING (k) GROUP BY k")
def buffer_areas(spark, sf):
    """Each brand's areas grown by 1 with mitred corners, and united."""
    return _measured(V.buffer(shapes(spark, sf), 1.0, WIDE, "mitre", keys=["brand"]), ["brand"])


@query("shrink_areas", "id:l area:d outline:d", "", f"""WITH {_SHAPES}, p AS (SELECT p.id AS k, p.c, p.r FROM px p, {_AROUND}, px q WHERE q.id = p.id AND q.c = p.c + dc AND q.r = p.r + dr GROUP BY ALL HAVING count(*) = 9), {_counted('p')}
SELECT k AS id, count(*) AS area, any_value(edge.n) AS outline FROM u JOIN edge USING (k) GROUP BY k""")
def shrink_areas(spark, sf):
    """Each area less a margin of 1 with mitred corners; those without a core are gone."""
    return _measured(V.buffer(shapes(spark, sf), -1.0, WIDE, "mitre"), ["id"])


@query("nearest_area", "a:l distance:d", "", f"""
WITH {_SHAPES}, far AS (SELECT p.id AS a, min(pow(greatest(abs(p.c - q.c) - 1, 0), 2) + pow(greatest(abs(p.r - q.r) - 1, 0), 2)) AS d FROM px p, px q WHERE q.size = 1 AND q.id % 3 = 0 GROUP BY p.id) SELECT a, sqrt(d) AS distance FROM far""")
def nearest_area(spark, sf):
    """Distance of each area to the nearest of some (those of size 1, one in three)."""
    s = shapes(spark, sf)
    return V.nearest(s, s.where("size = 1 AND id % 3 = 0"), TILE).select(F.col("a_id").alias("a"), "distance")


@query("patch_outlines", "patch:l area:d outline:d", "", f"""
WITH RECURSIVE {_PATCH}, q AS (SELECT patch, b.row AS r, b.col AS c FROM patch JOIN b USING (scene, px)), sides AS (SELECT patch, count(*) AS n FROM q, {_SIDES} WHERE NOT EXISTS (SELECT 1 FROM q o WHERE o.patch = q.patch AND o.r = q.r + dr AND o.c = q.c + dc) GROUP BY patch)
SELECT patch, count(*) AS area, any_value(n) AS outline FROM q JOIN sides USING (patch) GROUP BY patch""")
def patch_outlines(spark, sf):
    """§2.15: patches of land classes as rings with holes; their areas and lengths are those of the pixels."""
    patches = R.label_patches(_classes(spark, sf), ["scene"], tile=16)
    return _measured(O.outlines(patches, ["scene"], "patch", tile=16), ["patch"])


@query("masked_window", "id:l n:l total:l", "grid", """
WITH p AS (SELECT p_partkey // 50 AS r, p_partkey % 50 AS c, p_size AS v FROM part), z AS (SELECT id, 5 * col + 2 AS x, 4 * row + 3 AS y, 1.25::DOUBLE + id % 4 AS d FROM grid)
SELECT id, count(*) AS n, sum(v) AS total FROM p JOIN z ON abs(c + 0.5 - x) + abs(r + 0.5 - y) < d AND v <> 7 GROUP BY id""")
def masked_window(spark, sf):
    """Pixels of a tiled raster under slanted areas, one value standing for no data."""
    k = F.col("p_partkey")
    raster = A.read(spark, sf, "part").select(F.lit(1).alias("scene"), F.floor(k / 50).alias("row"), (k % 50).alias("col"), F.col("p_size").alias("value"))
    x, y, d = 5 * F.col("col") + 2, 4 * F.col("row") + 3, F.lit(1.25) + F.col("id") % 4
    corner = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    zones = A.grid(spark, sf).select("id", F.array(F.array(corner(x - d, y), corner(x, y - d), corner(x + d, y), corner(x, y + d))).alias("rings"))
    found = O.masked_window(O.tiled(raster, ["scene"], 16, nodata=7), zones, ["scene"], 16, nodata=7)
    return found.groupBy("id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
