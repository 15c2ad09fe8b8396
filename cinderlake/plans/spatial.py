"""Queries of neighbours, components, patches and terrain."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinderlake.operators import graph as G
from cinderlake.operators import raster as R
from cinderlake.plans.build import query
from cinderlake.sources import adapters as A

_EDGES = "edges AS (SELECT a.id AS src, b.id AS dst FROM grid a JOIN grid b ON (b.row, b.col) IN ((a.row, a.col + 1), (a.row + 1, a.col - 1), (a.row + 1, a.col), (a.row + 1, a.col + 1)))"
_BOTH = f"{_EDGES}, sym AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges)"
_LON, _LAT = "(col * 0.5 - 60.0)", "(row * 0.5 - 20.0)"


def _edges(spark, sf):
    return G.neighbours(A.grid(spark, sf))


@query("edge_list", "src:l dst:l", "grid", f"WITH {_EDGES} SELECT src, dst FROM edges")
def edge_list(spark, sf):
    return _edges(spark, sf)


def _geodesic(rounds: int) -> str:
    """Vincenty's inverse iteration over pairs p (src, dst, l, u, w: difference of longitudes and reduced latitudes)."""
    out = "t0 AS (SELECT *, l AS lam FROM p)"
    for k in range(1, rounds + 1):
        out += f""", a{k} AS (SELECT *, sqrt(pow(cos(w) * sin(lam), 2) + pow(cos(u) * sin(w) - sin(u) * cos(w) * cos(lam), 2)) AS ss, sin(u) * sin(w) + cos(u) * cos(w) * cos(lam) AS cs FROM t{k - 1}),
b{k} AS (SELECT *, atan2(ss, cs) AS sig, coalesce(cos(u) * cos(w) * sin(lam) / nullif(ss, 0), 0) AS sa FROM a{k}), c{k} AS (SELECT *, 1 - sa * sa AS ca FROM b{k}),
d{k} AS (SELECT *, coalesce(cs - 2 * sin(u) * sin(w) / nullif(ca, 0), 0) AS cm, 1 / 298.257223563::DOUBLE / 16 * ca * (4 + 1 / 298.257223563::DOUBLE * (4 - 3 * ca)) AS cc FROM c{k}),
t{k} AS (SELECT src, dst, l, u, w, ss AS s_, cs AS c_, sig AS g_, ca AS a_, cm AS m_, l + (1 - cc) * (1 / 298.257223563::DOUBLE) * sa * (sig + cc * ss * (cm + cc * cs * (2 * cm * cm - 1))) AS lam FROM d{k})"""
    return out


@query("distance_pairs", "src:l dst:l km:d converged:l", "grid", f"""WITH {_EDGES}, q AS (SELECT id, radians(col * 0.5::DOUBLE - 60) AS lon, atan((1 - 1 / 298.257223563::DOUBLE) * tan(radians(row * 0.5::DOUBLE - 20))) AS b FROM grid),
p AS (SELECT src, dst, b.lon - a.lon AS l, a.b AS u, b.b AS w FROM edges JOIN q a ON a.id = src JOIN q b ON b.id = dst), {_geodesic(6)},
h AS (SELECT *, a_ * (6378.137::DOUBLE * 6378.137 / (6356.752314245179::DOUBLE * 6356.752314245179) - 1) AS z FROM t6),
n AS (SELECT *, 1 + z / 16384 * (4096 + z * (-768 + z * (320 - 175 * z))) AS aa, z / 1024 * (256 + z * (-128 + z * (74 - 47 * z))) AS bb FROM h)
SELECT src, dst, 6356.752314245179::DOUBLE * aa * (g_ - bb * s_ * (m_ + bb / 4 * (c_ * (2 * m_ * m_ - 1) - bb / 6 * m_ * (4 * s_ * s_ - 3) * (4 * m_ * m_ - 3)))) AS km, 1 AS converged FROM n""")
def distance_pairs(spark, sf):
    p = A.grid(spark, sf).select("id", (F.col("col") * 0.5 - 60).alias("lon"), (F.col("row") * 0.5 - 20).alias("lat"))
    at = lambda k: p.select(F.col("id").alias(k), F.col("lon").alias(f"{k}_lon"), F.col("lat").alias(f"{k}_lat"))
    e = _edges(spark, sf).join(at("src"), "src").join(at("dst"), "dst")
    return e.withColumn("g", G.geodesic(F.col("src_lon"), F.col("src_lat"), F.col("dst_lon"), F.col("dst_lat"), 8)).select("src", "dst", "g.km", F.col("g.converged").cast("int").alias("converged"))


@query("neighbour_mean", "id:l pct_area_near:d", "grid", f"WITH {_BOTH} SELECT src AS id, avg(pct_area) AS pct_area_near FROM sym JOIN grid ON grid.id = dst GROUP BY src")
def neighbour_mean(spark, sf):
    return G.neighbour_mean(A.grid(spark, sf), _edges(spark, sf), "pct_area")


def _fill_rounds(n: int) -> str:
    out = "f0 AS (SELECT id, CASE WHEN pct_area >= 60 THEN pct_area END AS v FROM grid)"
    for k in range(1, n + 1):
        out += f", f{k} AS (SELECT f.id, coalesce(max(f.v), avg(g.v)) AS v FROM f{k - 1} f LEFT JOIN sym ON sym.src = f.id LEFT JOIN f{k - 1} g ON g.id = sym.dst GROUP BY f.id)"
    return out


@query("neighbour_fill", "id:l v:d", "grid", f"WITH {_BOTH}, {_fill_rounds(8)} SELECT id, v FROM f8")
def neighbour_fill(spark, sf):
    holes = A.grid(spark, sf).select("id", F.when(F.col("pct_area") >= 60, F.col("pct_area")).alias("v"))
    return G.neighbour_fill(holes, _edges(spark, sf), "v")


@query("low_count_impute", "id:l n:l v:d imputed:l", "fires grid", f"""
WITH {_BOTH}, c AS (SELECT id, count(*) FILTER (month = 1) AS n, sum(units)::DOUBLE AS v FROM fires GROUP BY id), lim AS (SELECT avg(n) AS m FROM c)
SELECT id, n, v, 0 AS imputed FROM c WHERE n > 50 UNION ALL
SELECT a.id, a.n, round_even(avg(b.v), 0), 1 FROM c a JOIN sym ON sym.src = a.id JOIN c b ON b.id = sym.dst AND b.n > 50 WHERE a.n <= 50 GROUP BY a.id, a.n""")
def low_count_impute(spark, sf):
    c = A.fires(spark, sf).groupBy("id").agg(F.count_if(F.col("month") == 1).alias("n"), F.sum("units").cast("double").alias("v"))
    return G.low_count_impute(c, _edges(spark, sf), "n", ["v"], 50, rounded=["v"])


@query("components", "id:l label:l", "fires grid", f"""
WITH RECURSIVE {_EDGES}, c AS (SELECT id, count(*) % 2 AS odd FROM fires GROUP BY id), l AS (SELECT src, dst FROM edges JOIN c a ON a.id = src JOIN c b ON b.id = dst WHERE a.odd = 1 AND b.odd = 1),
s AS (SELECT src, dst FROM l UNION ALL SELECT dst, src FROM l), reach(a, b) AS (SELECT id, id FROM grid UNION SELECT reach.a, s.dst FROM reach JOIN s ON s.src = reach.b)
SELECT a AS id, min(b) AS label FROM reach GROUP BY a""")
def components(spark, sf):
    odd = A.fires(spark, sf).groupBy("id").agg((F.count("*") % 2).alias("odd")).where("odd = 1").select("id")
    links = _edges(spark, sf).join(odd.withColumnRenamed("id", "src"), "src").join(odd.withColumnRenamed("id", "dst"), "dst")
    return G.label_all(A.grid(spark, sf).select("id"), links.select(F.col("src").alias("a"), F.col("dst").alias("b")), "id")


@query("border_flag", "id:l border:l", "grid", "SELECT id, CAST(row = (SELECT min(row) FROM grid) OR row = (SELECT max(row) FROM grid) OR col IN ((SELECT min(col) FROM grid), (SELECT max(col) FROM grid)) AS INT) AS border FROM grid")
def border_flag(spark, sf):
    g = A.grid(spark, sf)
    ends = g.agg(*[f(c) for c in ("row", "col") for f in (F.min, F.max)]).first()
    return g.select("id", (F.col("row").isin(*ends[:2]) | F.col("col").isin(*ends[2:])).cast("int").alias("border"))


def _burned(spark, sf):
    """Burned pixels of a 50-column raster by year and month."""
    f = A.fires(spark, sf).where(F.col("units") >= A.MIN_UNITS).select("year", "month", "px").distinct()
    return f.select("year", "month", "px", F.floor(F.col("px") / 50).alias("row"), (F.col("px") % 50).alias("col"))


_BURNED = "b AS (SELECT DISTINCT year, month, px, px // 50 AS row, px % 50 AS col FROM fires WHERE units >= 3)"


def _reach(keys: str, near: str, extra: str = "TRUE") -> str:
    return f"""reach({keys}, a, b) AS (SELECT {keys}, px, px FROM b UNION SELECT {", ".join("r." + k.strip() for k in keys.split(","))}, r.a, q.px FROM reach r JOIN b p ON {" AND ".join(f"p.{k.strip()} = r.{k.strip()}" for k in keys.split(","))} AND p.px = r.b JOIN b q ON {" AND ".join(f"q.{k.strip()} = r.{k.strip()}" for k in keys.split(","))} AND {near} AND {extra})"""


@query("same_month_merge", "year:l month:l px:l fire:l", "fires", f"WITH RECURSIVE {_BURNED}, {_reach('year, month', '(q.row - p.row) * (q.row - p.row) + (q.col - p.col) * (q.col - p.col) <= 2')} SELECT year, month, a AS px, min(b) AS fire FROM reach GROUP BY ALL")
def same_month_merge(spark, sf):
    return G.merge_same_month(_burned(spark, sf), 1.5)


def _months_swept(n: int) -> str:
    """The sweep over n months, on groups of one month and the links between groups of different months."""
    out = "s0 AS (SELECT year, month AS gm, fire AS gf, month AS last, month * 1000000 + fire AS label FROM (SELECT DISTINCT year, month, fire FROM g))"
    for m in range(1, n + 1):
        k = m - 1
        out += f""", e{m} AS (SELECT DISTINCT s.year, s.label AS a, {m} * 1000000 + l.bf AS b FROM links l JOIN s{k} s ON s.year = l.year AND s.gm = l.am AND s.gf = l.af AND s.last = {k} WHERE l.bm = {m}),
w{m} AS (SELECT year, a, b FROM e{m} UNION ALL SELECT year, b, a FROM e{m}), r{m}(year, a, b) AS (SELECT DISTINCT year, a, a FROM w{m} UNION SELECT r.year, r.a, w.b FROM r{m} r JOIN w{m} w ON w.year = r.year AND w.a = r.b),
m{m} AS (SELECT year, a, min(b) AS label FROM r{m} GROUP BY ALL), s{m} AS (SELECT s.year, gm, gf, CASE WHEN t.label IS NULL THEN last ELSE {m} END AS last, coalesce(t.label, s.label) AS label FROM s{k} s LEFT JOIN m{m} t ON t.year = s.year AND t.a = s.label)"""
    return out


@query("consecutive_month_merge", "year:l px:l month0:l month:l fire_month:l fire:l", "fires", f"""
WITH RECURSIVE b AS (SELECT year, px, px // 50 AS row, px % 50 AS col, min(month) AS month FROM fires WHERE units >= 3 GROUP BY ALL), {_reach('year, month', '(q.row - p.row) * (q.row - p.row) + (q.col - p.col) * (q.col - p.col) <= 2')},
g AS (SELECT year, month, a AS px, min(b) AS fire FROM reach GROUP BY ALL), gp AS (SELECT * FROM g JOIN b USING (year, month, px)),
links AS (SELECT DISTINCT p.year, p.month AS am, p.fire AS af, q.month AS bm, q.fire AS bf FROM gp p JOIN gp q ON p.year = q.year AND p.month < q.month AND abs(p.row - q.row) <= 1 AND abs(p.col - q.col) <= 1),
{_months_swept(12)} SELECT g.year, px, g.month AS month0, s.last AS month, s.label // 1000000 AS fire_month, s.label % 1000000 AS fire FROM g JOIN s12 s ON s.year = g.year AND s.gm = g.month AND s.gf = g.fire""")
def consecutive_month_merge(spark, sf):
    first = A.fires(spark, sf).where(F.col("units") >= A.MIN_UNITS).groupBy("year", "px").agg(F.min("month").alias("month"))
    return G.merge_consecutive_months(first.select("*", F.floor(F.col("px") / 50).alias("row"), (F.col("px") % 50).alias("col")), 1.5)


def _classes(spark, sf):
    """Land classes (size of the part, in tens) on a 50-column raster."""
    p = A.read(spark, sf, "part")
    return p.select(F.lit(1).alias("scene"), F.col("p_partkey").alias("px"), F.floor(F.col("p_partkey") / 50).alias("row"), (F.col("p_partkey") % 50).alias("col"), F.floor(F.col("p_size") / 10).alias("value"))


_CLASSES = "b AS (SELECT 1 AS scene, p_partkey AS px, p_partkey // 50 AS row, p_partkey % 50 AS col, p_size // 10 AS value FROM part)"
_PATCH = f"{_CLASSES}, {_reach('scene', 'abs(q.row - p.row) <= 1 AND abs(q.col - p.col) <= 1', 'q.value = p.value')}, patch AS (SELECT scene, a AS px, min(b) AS patch FROM reach GROUP BY ALL)"
_METRICS = f"""{_PATCH}, ar AS (SELECT scene, value, patch, count(*) * 0.09::DOUBLE AS area FROM patch JOIN b USING (scene, px) GROUP BY ALL),
sides AS (SELECT p.scene, p.value AS v, q.value AS w FROM b p JOIN b q ON p.scene = q.scene AND ((q.row = p.row AND q.col = p.col + 1) OR (q.row = p.row + 1 AND q.col = p.col)) AND p.value <> q.value),
ed AS (SELECT scene, value, count(*) AS n FROM (SELECT scene, v AS value FROM sides UNION ALL SELECT scene, w FROM sides) GROUP BY ALL), land AS (SELECT scene, sum(area) AS landscape FROM ar GROUP BY scene)"""


@query("label_tiles", "px:l value:l patch:l", "", f"WITH RECURSIVE {_PATCH} SELECT px, value, patch FROM patch JOIN b USING (scene, px)")
def label_tiles(spark, sf):
    return R.label_patches(_classes(spark, sf), ["scene"], tile=8)


@query("class_metrics", "value:l total_area:d number_of_patches:l patch_density:d proportion_of_landscape:d largest_patch_index:d total_edge:d edge_density:d area_mn:d area_md:d area_cv:d", "", f"""
WITH RECURSIVE {_METRICS} SELECT ar.value, sum(area) AS total_area, count(*) AS number_of_patches, count(*) / landscape * 100 AS patch_density, sum(area) / landscape * 100 AS proportion_of_landscape, max(area) / landscape * 100 AS largest_patch_index,
coalesce(n, 0) * 30.0 AS total_edge, coalesce(n, 0) * 30.0 / landscape AS edge_density, avg(area) AS area_mn, quantile_cont(area, 0.5) AS area_md, stddev_pop(area) / avg(area) * 100 AS area_cv
FROM ar JOIN land USING (scene) LEFT JOIN ed ON ed.scene = ar.scene AND ed.value = ar.value GROUP BY ar.value, landscape, n""")
def class_metrics(spark, sf):
    return R.class_metrics(_classes(spark, sf), ["scene"], tile=8)


@query("landscape_metrics", "scene:l total_area:d number_of_patches:l patch_density:d total_edge:d edge_density:d landscape_shape_index:d area_mn:d area_cv:d", "", f"""
WITH RECURSIVE {_METRICS}, e AS (SELECT scene, sum(n) / 2 * 30.0 AS e FROM ed GROUP BY scene) SELECT ar.scene, sum(area) AS total_area, count(*) AS number_of_patches, count(*) / sum(area) * 100 AS patch_density, e AS total_edge, e / sum(area) AS edge_density,
0.25 * e / sqrt(sum(area) * 10000) AS landscape_shape_index, avg(area) AS area_mn, stddev_pop(area) / avg(area) * 100 AS area_cv FROM ar JOIN e USING (scene) GROUP BY ar.scene, e""")
def landscape_metrics(spark, sf):
    return R.landscape_metrics(_classes(spark, sf), ["scene"], tile=8)


def _window() -> str:
    """Nine values of each pixel's window, extrapolated at borders, as columns e00 .. e22."""
    v = {(r, c): f"max(v) FILTER (r = {r - 1} AND k = {c - 1}) AS v{r}{c}" for r in range(3) for c in range(3)}
    level = lambda r, c: f"coalesce(v{r}{c}, v{r}1)"
    lined = lambda r, c: f"coalesce({level(r, c)}, 2 * {level(1, c)} - {level(2 - r, c)}, {level(1, c)})"
    sided = lambda r, c: f"coalesce(v{r}{c}, 2 * v{r}1 - v{r}{2 - c}, v{r}1)"
    cells = [f"CASE WHEN v01 IS NULL OR v21 IS NULL THEN {lined(r, c)} ELSE {sided(r, c)} END::DOUBLE AS e{r}{c}" for r in range(3) for c in range(3)]
    return f"w AS (SELECT row, col, {', '.join(v.values())} FROM s GROUP BY ALL), g AS (SELECT row, col, {', '.join(cells)} FROM w)"


_CELLS = [f"e{r}{c}" for r in range(3) for c in range(3)]


@query("terrain_3x3", "row:l col:l roughness:d tri:d slope:d", "", f"""
WITH b AS (SELECT p_partkey // 50 AS row, p_partkey % 50 AS col, p_retailprice AS v FROM part),
s AS (SELECT a.row, a.col, n.v, n.row - a.row AS r, n.col - a.col AS k FROM b a JOIN b n ON abs(n.row - a.row) <= 1 AND abs(n.col - a.col) <= 1), {_window()},
d AS (SELECT *, (e02 + 2 * e12 + e22 - e00 - 2 * e10 - e20) / 8 AS dx, (e20 + 2 * e21 + e22 - e00 - 2 * e01 - e02) / 8 AS dy FROM g)
SELECT row, col, greatest({", ".join(_CELLS)}) - least({", ".join(_CELLS)}) AS roughness, ({" + ".join(f"abs({c} - e11)" for c in _CELLS)}) / 8 AS tri, degrees(atan(sqrt(dx * dx + dy * dy))) AS slope FROM d""")
def terrain_3x3(spark, sf):
    p = A.read(spark, sf, "part").select(F.lit(1).alias("scene"), F.floor(F.col("p_partkey") / 50).alias("row"), (F.col("p_partkey") % 50).alias("col"), F.col("p_retailprice").alias("value"))
    return R.terrain(p, ["scene"])
