"""Queries of intersections, dissolves, conversions and code harmonisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinderlake.operators import geometry as X
from cinderlake.operators import graph as G
from cinderlake.operators import relational as R
from cinderlake.operators import season as S
from cinderlake.plans.build import query
from cinderlake.sources import adapters as A


def _rows(spark, sf) -> int:
    return A.read(spark, sf, "lineitem").count()


def _pixels(spark, sf):
    """Line items as pixels of fires (orders); the pixel's month is its own, the fire's that of its first pixel."""
    d = A.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("fire_id"), F.col("l_suppkey").alias("id"), F.month("l_shipdate").alias("px_month"), F.col("l_quantity").cast("long").alias("units"))
    d = d.repartition(_rows(spark, sf) // 1_000_000 + 1, "fire_id")  # what a task holds does not grow with the input
    first = d.groupBy("fire_id").agg(F.min("px_month").alias("fire_month"))
    return d.join(first, "fire_id")


_PX = "px AS (SELECT l_orderkey AS fire_id, l_suppkey AS id, month(l_shipdate) AS px_month, CAST(l_quantity AS BIGINT) AS units, min(month(l_shipdate)) OVER (PARTITION BY l_orderkey) AS fire_month FROM lineitem)"


@query("intersecting_by_pixel_month", "id:l month:l npolygons:l npixels:l", "", f"WITH {_PX} SELECT id, px_month AS month, count(DISTINCT fire_id) AS npolygons, count(*) AS npixels FROM px GROUP BY ALL")
def intersecting_by_pixel_month(spark, sf):
    d = A.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("fire_id"), F.col("l_suppkey").alias("id"), F.month("l_shipdate").alias("px_month"))
    return R.intersecting(d, "px_month", rows=_rows(spark, sf))


@query("intersecting_by_fire_month", "id:l month:l npolygons:l npixels:l", "", f"WITH {_PX} SELECT id, fire_month AS month, count(DISTINCT fire_id) AS npolygons, count(*) AS npixels FROM px GROUP BY ALL")
def intersecting_by_fire_month(spark, sf):
    return R.intersecting(_pixels(spark, sf), "fire_month", rows=_rows(spark, sf))


@query("burned_area_pixels", "id:l month:l area:d", "", f"WITH {_PX} SELECT id, px_month AS month, count(*) * 0.0009::DOUBLE AS area FROM px GROUP BY ALL")
def burned_area_pixels(spark, sf):
    return R.pixel_area(_pixels(spark, sf).withColumn("value", F.col("px_month")), ["id", "px_month"]).withColumnRenamed("px_month", "month")


@query("intersecting_sizes", "id:l fire_id:l area:d", "", f"WITH {_PX}, s AS (SELECT fire_id, sum(units) * 0.01::DOUBLE AS area FROM px GROUP BY 1) SELECT DISTINCT id, fire_id, area FROM px JOIN s USING (fire_id) WHERE area >= 0.5::DOUBLE")
def intersecting_sizes(spark, sf):
    px = _pixels(spark, sf)
    return R.intersecting_sizes(px, px.groupBy("fire_id").agg((F.sum("units") * 0.01).alias("area")), 0.5)


@query("dissolve", "component:l fire_id:s year:l month:l npixels:l", "fires", "SELECT id % 7 AS component, min(fire_id) AS fire_id, min(year) AS year, max(month) AS month, count(*) AS npixels FROM fires GROUP BY 1")
def dissolve(spark, sf):
    return R.dissolve(A.fires(spark, sf).withColumn("component", F.col("id") % 7), "component")


@query("prec_season", "id:l year:l peak_month:l", "climate", "SELECT id, year, arg_max(month, (prec, -month)) AS peak_month FROM climate GROUP BY ALL")
def prec_season(spark, sf):
    """The season functions on precipitation."""
    return S.peak(A.climate(spark, sf), ["id", "year"], value="prec")


@query("unit_conversion", "id:l year:l month:l celsius:d mm:d tenth:d", "climate", "SELECT id, year, month, prec - 273.15 AS celsius, pet * 1000 * CASE WHEN month = 2 THEN 28 ELSE day(last_day(make_date(year, month, 1))) END AS mm, aet * 0.1 AS tenth FROM climate")
def unit_conversion(spark, sf):
    days = F.when(F.col("month") == 2, 28).otherwise(F.day(F.last_day(F.make_date("year", "month", F.lit(1)))))
    c = A.climate(spark, sf)
    return c.select("id", "year", "month", R.convert(F.col("prec"), "kelvin").alias("celsius"), R.convert(F.col("pet"), "metres_a_day", days).alias("mm"), R.convert(F.col("aet"), "tenths").alias("tenth"))


@query("harmonise_codes", "m_code:s s_code:s name:s area:l", "", """
WITH c AS (SELECT CAST(1700000 + c_custkey % 40 * 10 + c_nationkey * 100000 AS VARCHAR) AS code, c_name AS name, CAST(round(c_acctbal * 100) AS BIGINT) AS area FROM customer),
d AS (SELECT CASE substr(code, 1, 2) WHEN '19' THEN '17' ELSE substr(code, 1, 2) END AS s_code, substr(code, 3, 4) AS tail, name, area FROM c)
SELECT s_code || tail AS m_code, s_code, min(name) AS name, sum(area) AS area FROM d GROUP BY ALL""")
def harmonise_codes(spark, sf):
    c = A.read(spark, sf, "customer").select((1700000 + F.col("c_custkey") % 40 * 10 + F.col("c_nationkey") * 100000).alias("CD_GEOCMU"), F.col("c_name").alias("NM_MUN"), F.round(F.col("c_acctbal") * 100).cast("long").alias("area"))
    return R.harmonise(c, {"CD_GEOCMU": "code", "NM_MUN": "name"}, "code", {"19": "17"}, ["m_code", "s_code", "name", "area"])


@query("pair_combinations", "a:l b:l", "", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey <= b.n_nationkey")
def pair_combinations(spark, sf):
    return R.pairs_with_self(A.read(spark, sf, "nation"), "n_nationkey")


#: Diamonds: squares in u = x + y, v = x - y, so that SQL can compare them exactly.
_AREAS = "n AS (SELECT n_nationkey AS id, (n_nationkey * 7 % 40)::DOUBLE AS x, (n_nationkey * 3 % 40)::DOUBLE AS y, x + y AS u, x - y AS v, 1.5::DOUBLE + n_nationkey % 3 * 3 AS r FROM nation)"
_PAIRS = "p AS (SELECT a.id AS a, b.id AS b, greatest(abs(a.u - b.u), abs(a.v - b.v)) AS gap, a.r AS s, b.r AS t FROM n a JOIN n b ON a.id <> b.id)"


def _diamond(x, y, r):
    corner = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    return F.array(corner(x - r, y), corner(x, y - r), corner(x + r, y), corner(x, y + r))


def _areas(spark, sf):
    k = F.col("n_nationkey")
    return A.read(spark, sf, "nation").select(k.cast("long").alias("id"), _diamond((k * 7 % 40).cast("double"), (k * 3 % 40).cast("double"), k % 3 * 3 + F.lit(1.5)).alias("ring"))


def _both(areas):
    return areas.select(F.col("id").alias("a_id"), F.col("ring").alias("a_ring")), areas.select(F.col("id").alias("b_id"), F.col("ring").alias("b_ring"))


@query("dissolve_overlaps", "id:l label:l", "", f"""
WITH RECURSIVE {_AREAS}, {_PAIRS}, reach(a, b) AS (SELECT id, id FROM n UNION SELECT reach.a, p.b FROM reach JOIN p ON p.a = reach.b WHERE gap <= s + t) SELECT a AS id, min(b) AS label FROM reach GROUP BY a""")
def dissolve_overlaps(spark, sf):
    """Components of areas that meet."""
    n = _areas(spark, sf)
    pairs = X.spatial_join(*_both(n), 4.0).where("a_id < b_id")
    return G.label_all(n.select("id"), pairs.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")), "id")


@query("spatial_predicates", "a:l b:l touches:l within:l contains:l overlaps:l", "", f"""
WITH {_AREAS}, {_PAIRS} SELECT a, b, CAST(gap = s + t AS INT) AS touches, CAST(gap <= t - s AS INT) AS within, CAST(gap <= s - t AS INT) AS contains, CAST(gap < s + t AND gap > abs(s - t) AS INT) AS overlaps FROM p WHERE gap <= s + t""")
def spatial_predicates(spark, sf):
    """How areas that intersect lie to each other."""
    pairs = X.spatial_join(*_both(_areas(spark, sf)), 4.0).where("a_id <> b_id").withColumn("how", X.relation("a_ring", "b_ring"))
    return pairs.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), *[X.PREDICATES[p](F.col("how")).cast("int").alias(p) for p in ("touches", "within", "contains", "overlaps")])


@query("polygon_border_flag", "id:l border:l", "", f"""
WITH {_AREAS}, d AS (SELECT *, greatest(5 - x, 0, x - 35) + greatest(5 - y, 0, y - 35) AS away FROM n)
SELECT id, CAST(away <= r AND NOT (x - r > 5 AND x + r < 35 AND y - r > 5 AND y + r < 35) AS INT) AS border FROM d""")
def polygon_border_flag(spark, sf):
    """Areas that meet the border of a region."""
    region = spark.range(1).select("id", X.rectangle(F.lit(5), F.lit(5), F.lit(35), F.lit(35)).alias("ring"))
    return X.border_flags(_areas(spark, sf), region, 4.0)


@query("format_grid", "id:l within:l clip_area:d pct_area:d lon:d lat:d", "grid", "SELECT id, CAST(row + 1 <= 6 AS INT) AS within, least(row + 1, 6.5) - row AS clip_area, 100 * (least(row + 1, 6.5) - row) AS pct_area, col + 0.5 AS lon, row + 0.5 AS lat FROM grid WHERE row < 6.5")
def format_grid(spark, sf):
    """Cells that meet a region (here y < 6.5), with area share and centre."""
    cells = A.grid(spark, sf).select("id", X.rectangle(F.col("col"), F.col("row"), F.col("col") + 1, F.col("row") + 1).alias("ring"))
    region = spark.range(1).select("id", X.rectangle(F.lit(-10), F.lit(-10), F.lit(100), F.lit(6.5)).alias("ring"))
    return X.grid_cells(cells, region, 4.0)


@query("fire_size_quantiles", "id:l month:l n:l q50:d q99:d", "fires", "SELECT id, month, count(*) AS n, quantile_cont(units * 0.01::DOUBLE, 0.5) AS q50, quantile_cont(units * 0.01::DOUBLE, 0.99) AS q99 FROM fires WHERE units >= 3 GROUP BY ALL")
def fire_size_quantiles(spark, sf):
    """Size quantiles of each cell and month. Equal sizes are counted first, so a cell's buffer holds sizes, not fires."""
    f = A.fires(spark, sf).where("units >= 3").groupBy("id", "month", "units").agg(F.count("*").alias("n"))
    q = F.percentile("units", F.array(F.lit(0.5), F.lit(0.99)), F.col("n"))
    return f.groupBy("id", "month").agg(F.sum("n").alias("n"), q.alias("q")).select("id", "month", "n", (F.col("q")[0] * 0.01).alias("q50"), (F.col("q")[1] * 0.01).alias("q99"))


@query("count_density", "id:l n:l density:d", "fires grid", "SELECT id, count(f.id) AS n, count(f.id) / any_value(pct_area) AS density FROM grid LEFT JOIN fires f USING (id) WHERE pct_area > 0 GROUP BY id")
def count_density(spark, sf):
    """Rows of each cell over its area; cells without rows have density 0."""
    n = A.fires(spark, sf).groupBy("id").agg(F.count("*").alias("n"))
    g = A.grid(spark, sf).where("pct_area > 0").select("id", "pct_area").join(n, "id", "left")
    return g.select("id", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.col("pct_area")).alias("density"))
