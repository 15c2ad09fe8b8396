"""Queries of the multivariate tables, clusterings, geometry and event windows."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import functions as F

from cinderlake.operators import geometry as X
from cinderlake.operators import graph as G
from cinderlake.operators import multivariate as M
from cinderlake.operators import regimes as RG
from cinderlake.operators import relational as R
from cinderlake.operators import season as S
from cinderlake.operators import size as Z
from cinderlake.plans.build import query
from cinderlake.plans.tables import YEARS_OF
from cinderlake.sources import adapters as A
from cinderlake.streaming import incremental as I

DIMS = 4
ANCHORS = [0, 100, 200, 300, 400]
E = [f"e{i}" for i in range(DIMS)]


def _points(spark, sf, dims: int = DIMS):
    d = A.read(spark, sf, "embeddings")
    return d.select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("label"), *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(dims)])


_PTS = "pts AS (SELECT vec_id AS id, label, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS e{i}" for i in range(DIMS)) + " FROM embeddings)"


@query("regime_input", "id:l period:s size_q50:d size_q99:d number_fires:l burned_area:d season_q50s:d flammable:d burned_area_n:d", "pf cs land", """
WITH z AS (SELECT id, period, quantile_cont(units * 0.01::DOUBLE, 0.5) AS size_q50, quantile_cont(units * 0.01::DOUBLE, 0.99) AS size_q99, count(*) AS number_fires, sum(units) * 0.01::DOUBLE AS burned_area FROM pf GROUP BY ALL),
ecdf AS (SELECT id, period, peak, r, run / total AS e FROM cs),
b AS (SELECT id, period, peak, CASE WHEN max(r) FILTER (e <= t) >= 12 THEN 12.0::DOUBLE ELSE max(r) FILTER (e <= t) + (max(t) - max(e) FILTER (e <= t)) / (min(e) FILTER (e > t) - max(e) FILTER (e <= t)) END AS x FROM (SELECT *, greatest(0.5::DOUBLE, min(e) OVER (PARTITION BY id, period)) AS t FROM ecdf) GROUP BY ALL),
f AS (SELECT cell AS id, sum(value)::DOUBLE AS flammable FROM land WHERE cls <= 40 GROUP BY cell)
SELECT z.*, CASE WHEN x - 6 + peak > 12 THEN x - 18 + peak WHEN x - 6 + peak < 1 THEN x + 6 + peak ELSE x - 6 + peak END AS season_q50s, flammable, burned_area / flammable AS burned_area_n FROM z JOIN b USING (id, period) LEFT JOIN f USING (id)""")
def regime_input(spark, sf):
    f = A.period_fires(spark, sf).withColumn("area", F.col("units") * A.UNIT_KM2)
    sizes = Z.size_quantiles(f, ["id", "period"]).select("id", "period", F.col("`q_0.5`").alias("size_q50"), F.col("`q_0.99`").alias("size_q99"))
    counts = f.groupBy("id", "period").agg(F.count("*").alias("number_fires"), (F.sum("units") * A.UNIT_KM2).alias("burned_area"))
    season = S.quantiles_smoothed(f).select("id", "period", F.col("q50").alias("season_q50s"))
    fuel = A.land_pixels(spark, sf).where("cls <= 40").groupBy(F.col("cell").alias("id")).agg(F.sum("value").alias("flammable"))
    out = sizes.join(counts, ["id", "period"]).join(season, ["id", "period"]).join(fuel, "id", "left")
    return out.withColumn("burned_area_n", F.col("burned_area") / F.col("flammable"))


@query("regime_defaults", "id:l n:l area:d flammable:d", "fires", """
WITH g AS (SELECT p_partkey AS id, p_partkey // 50 AS row, p_partkey % 50 AS col FROM part),
c AS (SELECT px AS id, count(*) AS n, sum(units) * 0.01::DOUBLE AS area, sum(units)::DOUBLE AS flammable FROM fires WHERE units >= 50 GROUP BY px),
k AS (SELECT g.*, n, area, flammable FROM g LEFT JOIN c USING (id)),
o AS (SELECT a.r, b.c FROM (SELECT unnest([-1, 0, 1]) AS r) a CROSS JOIN (SELECT unnest([-1, 0, 1]) AS c) b WHERE a.r <> 0 OR b.c <> 0),
m AS (SELECT x.id, avg(y.flammable) AS near FROM (SELECT id, row + r AS row, col + c AS col FROM k CROSS JOIN o) x JOIN k y USING (row, col) GROUP BY x.id)
SELECT k.id, coalesce(n, 1) AS n, coalesce(area, 0.03) AS area, coalesce(flammable, near) AS flammable FROM k LEFT JOIN m USING (id)""")
def regime_defaults(spark, sf):
    """M1: cells (of the parts' raster) without large fires get one of the least size, and their fuel from neighbours."""
    k = F.col("p_partkey")
    cells = A.read(spark, sf, "part").select(k.alias("id"), F.floor(k / 50).alias("row"), (k % 50).alias("col"))
    c = A.fires(spark, sf).where("units >= 50").groupBy(F.col("px").alias("id")).agg(F.count("*").alias("n"), (F.sum("units") * A.UNIT_KM2).alias("area"), F.sum("units").cast("double").alias("flammable"))
    known = cells.select("id").join(c, "id", "left")
    near = G.neighbour_mean(known, G.neighbours(cells), "flammable")
    return known.join(near, "id", "left").select("id", F.coalesce("n", F.lit(1)).alias("n"), F.coalesce("area", F.lit(0.03)).alias("area"), F.coalesce("flammable", "flammable_near").alias("flammable"))


def _filled(value: str, start: str, circle: bool = False, rounds: int = 8) -> str:
    """Values of k filled from neighbours (sym) in rounds."""
    angle = "atan2(avg(sin(h.v * pi() / 6)), avg(cos(h.v * pi() / 6))) * 6 / pi()"
    near = f"CASE WHEN pow(avg(sin(h.v * pi() / 6)), 2) + pow(avg(cos(h.v * pi() / 6)), 2) > 1e-18 THEN CASE WHEN {angle} > 0 THEN {angle} ELSE {angle} + 12 END END" if circle else "avg(h.v)"
    out = f"{value}0 AS (SELECT id, period, {start}::DOUBLE AS v FROM k)"
    for r in range(1, rounds + 1):
        out += f", {value}{r} AS (SELECT g.id, g.period, coalesce(max(g.v), {near}) AS v FROM {value}{r - 1} g LEFT JOIN sym ON sym.src = g.id LEFT JOIN {value}{r - 1} h ON h.id = sym.dst AND h.period = g.period GROUP BY g.id, g.period)"
    return out


_LARGE = f"""fires AS ({A.CTES["fires"]}), pf AS ({A.CTES["pf"]}), land AS ({A.CTES["land"]}), big AS (SELECT px AS id, id AS pix, period, year, month, units FROM pf WHERE units >= 45),
cm AS ({A.CTES["cm"].replace("pf", "big")}), months AS ({A.CTES["months"]}), dense AS ({A.CTES["dense"]}), pk AS ({A.CTES["pk"]}), rl AS ({A.CTES["rl"]}), cs AS ({A.CTES["cs"]}),
z AS (SELECT id, period, quantile_cont(units * 0.01::DOUBLE, 0.5) AS size_q50, quantile_cont(units * 0.01::DOUBLE, 0.99) AS size_q99, count(*) AS number_fires, sum(units) * 0.01::DOUBLE AS burned_area FROM big GROUP BY ALL),
ecdf AS (SELECT id, period, peak, r, run / total AS e FROM cs), sx AS (SELECT id, period, peak, CASE WHEN max(r) FILTER (e <= t) >= 12 THEN 12.0::DOUBLE ELSE max(r) FILTER (e <= t) + (max(t) - max(e) FILTER (e <= t)) / (min(e) FILTER (e > t) - max(e) FILTER (e <= t)) END AS x FROM (SELECT *, greatest(0.5::DOUBLE, min(e) OVER (PARTITION BY id, period)) AS t FROM ecdf) GROUP BY ALL),
season AS (SELECT id, period, CASE WHEN x - 6 + peak > 12 THEN x - 18 + peak WHEN x - 6 + peak < 1 THEN x + 6 + peak ELSE x - 6 + peak END AS season_q50s FROM sx),
fl AS (SELECT px AS id, year, sum(value)::DOUBLE AS flammable FROM land WHERE cls <= 40 GROUP BY ALL), ya AS (SELECT id, period, year, sum(units) * 0.01::DOUBLE AS area FROM big GROUP BY ALL),
ri AS (SELECT id, period, avg(flammable) AS flammable, 1 / avg(area / flammable) AS fri, 2 * avg(area / flammable) AS fri_freq FROM ya JOIN fl USING (id, year) GROUP BY ALL),
hist AS (SELECT id, period, count(*) FILTER (f = 1) AS one, count(*) AS n, min(f) AS lo, max(f) AS hi FROM (SELECT id, period, pix, count(DISTINCT year) AS f FROM big GROUP BY ALL) GROUP BY ALL),
fq AS (SELECT id, period, CASE WHEN lo = hi THEN lo::DOUBLE WHEN one::DOUBLE / n > 0.99 THEN 2.0::DOUBLE ELSE 1 + (0.99::DOUBLE - one::DOUBLE / n) / (1 - one::DOUBLE / n) END AS frequency_q99s FROM hist),
vars AS (SELECT * FROM z JOIN season USING (id, period) JOIN ri USING (id, period) JOIN fq USING (id, period)),
cells AS (SELECT p_partkey AS id, p_partkey // 50 AS row, p_partkey % 50 AS col FROM part), edges AS (SELECT a.id AS src, b.id AS dst FROM cells a JOIN cells b ON (b.row, b.col) IN ((a.row, a.col + 1), (a.row + 1, a.col - 1), (a.row + 1, a.col), (a.row + 1, a.col + 1))),
sym AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges), per AS (SELECT unnest({[f"{a}-{b}" for a, b in A.PERIODS]}) AS period), k AS (SELECT cells.id, per.period, vars.* EXCLUDE (id, period) FROM cells CROSS JOIN per LEFT JOIN vars ON vars.id = cells.id AND vars.period = per.period)"""
_FILLED = ", ".join(_filled(v, v) for v in ("flammable", "fri", "fri_freq")) + ", " + _filled("s_", "CASE WHEN number_fires > 1 THEN season_q50s END", circle=True)


@query("regime_full", "id:l period:s number_fires:l burned_area:d size_q50:d size_q99:d frequency_q99s:d flammable:d fri:d fri_freq:d season_q50s:d imputed:l burned_area_n:d number_fires_n:d", "", f"""
WITH {_LARGE}, {_FILLED} SELECT k.id, k.period, coalesce(number_fires, 1) AS number_fires, coalesce(burned_area, 0.03) AS burned_area, coalesce(size_q50, 0.03) AS size_q50, coalesce(size_q99, 0.03) AS size_q99, coalesce(frequency_q99s, 0) AS frequency_q99s,
a.v AS flammable, b.v AS fri, c.v AS fri_freq, d.v AS season_q50s, CAST(number_fires IS NULL AS INT) AS imputed, coalesce(burned_area, 0.03) / nullif(a.v, 0) AS burned_area_n, coalesce(number_fires, 1) / nullif(a.v, 0) AS number_fires_n
FROM k JOIN flammable8 a USING (id, period) JOIN fri8 b USING (id, period) JOIN fri_freq8 c USING (id, period) JOIN s_8 d USING (id, period)""")
def regime_full(spark, sf):
    """M1: all variables of every cell (of the parts' raster) in every period, from large fires only, so that cells are empty."""
    f = A.period_fires(spark, sf).where("units >= 45").select(F.col("px").alias("id"), F.col("id").alias("pix"), "period", "year", "month", "units").withColumn("area", F.col("units") * A.UNIT_KM2)
    keys = ["id", "period"]
    sizes = Z.size_quantiles(f, keys).select(*keys, F.col("`q_0.5`").alias("size_q50"), F.col("`q_0.99`").alias("size_q99"))
    counts = f.groupBy(*keys).agg(F.count("*").alias("number_fires"), (F.sum("units") * A.UNIT_KM2).alias("burned_area"))
    season = S.quantiles_smoothed(f).select(*keys, F.col("q50").alias("season_q50s"))
    fuel = A.land_pixels(spark, sf).where("cls <= 40").groupBy(F.col("px").alias("id"), "year").agg(F.sum("value").alias("flammable"))
    yearly = f.groupBy(*keys, "year").agg((F.sum("units") * A.UNIT_KM2).alias("area")).join(fuel, ["id", "year"])
    interval = Z.return_interval(yearly, YEARS_OF).select(*keys, "flammable", "fri", "fri_freq")
    years = f.select(*keys, "pix", "year").distinct().groupBy(*keys, "pix").agg(F.count("*").alias("frequency")).groupBy(*keys, "frequency").agg(F.count("*").alias("npixels"))
    often = Z.frequency_smoothed(years, keys, 2).select(*keys, F.col("f99").alias("frequency_q99s"))
    known = reduce(lambda a, b: a.join(b, keys), (sizes, counts, season, interval, often))
    k = F.col("p_partkey")
    cells = A.read(spark, sf, "part").select(k.alias("id"), F.floor(k / 50).alias("row"), (k % 50).alias("col"))
    return RG.regime_table(known, cells, G.neighbours(cells), [f"{a}-{b}" for a, b in A.PERIODS])


@query("analysis_table", "id:l year:l prec:d units:l row:l", "climate fires grid", "SELECT c.id, c.year, sum(prec) AS prec, max(f.units) AS units, max(g.row) AS row FROM climate c LEFT JOIN (SELECT id, year, sum(units) AS units FROM fires GROUP BY ALL) f ON f.id = c.id AND f.year = c.year LEFT JOIN grid g ON g.id = c.id GROUP BY c.id, c.year")
def analysis_table(spark, sf):
    c = A.climate(spark, sf).groupBy("id", "year").agg(F.sum("prec").alias("prec"))
    f = A.fires(spark, sf).groupBy("id", "year").agg(F.sum("units").alias("units"))
    return c.join(f, ["id", "year"], "left").join(A.grid(spark, sf).select("id", "row"), "id", "left")


@query("bic", "n:l k:l bic:d", "", f"""
WITH {_PTS}, g AS (SELECT label, count(*) AS m, {" + ".join(f"(sum(e{i} * e{i}) - sum(e{i}) * sum(e{i}) / count(*))" for i in range(DIMS))} AS w FROM pts GROUP BY label),
t AS (SELECT sum(m)::DOUBLE AS n, count(*) AS k, sum(w) AS w, sum(m * ln(m)) AS ml FROM g)
SELECT n, k, ml - n * ln(n) - n * {DIMS} / 2 * ln(2 * {math.pi!r}::DOUBLE * w / ({DIMS} * (n - k))) - {DIMS} * (n - k) / 2 - k * {DIMS + 1}.0 / 2 * ln(n) AS bic FROM t""")
def bic(spark, sf):
    return M.bic(_points(spark, sf), "label", E)


@query("overlap_1d", "a:l b:l merge:l", "", f"WITH {_PTS}, r AS (SELECT label, min(e0) AS lo, max(e0) AS hi FROM pts GROUP BY label) SELECT p.label AS a, q.label AS b, CAST(greatest(p.hi, q.hi) - least(p.lo, q.lo) < p.hi - p.lo + q.hi - q.lo AS INT) AS merge FROM r p JOIN r q ON p.label < q.label")
def overlap_1d(spark, sf):
    return M.overlap_1d(_points(spark, sf), "label", "e0")


@query("cluster_label", "id:l cluster:l label:s", "", "WITH c AS (SELECT vec_id AS id, label AS cluster FROM embeddings), a AS (SELECT id, chr(CAST(65 + id // 100 AS INT)) AS letter FROM c WHERE id IN (0, 100, 200, 300, 400)), n AS (SELECT cluster, min(letter) AS label FROM a JOIN c USING (id) GROUP BY cluster) SELECT id, cluster, coalesce(label, '99') AS label FROM c LEFT JOIN n USING (cluster)")
def cluster_label(spark, sf):
    c = _points(spark, sf, 0).select("id", F.col("label").alias("cluster"))
    anchors = c.where(F.col("id").isin(ANCHORS)).select("id", F.char((65 + F.floor(F.col("id") / 100)).cast("int")).alias("letter"))
    return M.label_by_anchor(c, anchors, [])


@query("pca", "id:l PC1:d PC2:d PC3:d PC4:d")
def pca(spark, sf):
    return M.pca(_points(spark, sf), E)[0]


@query("pca_explained", "axis:s eigenvalue:d proportion:d cumulative:d by_chance:d")
def pca_explained(spark, sf):
    """Shares of variance, beside those of a broken stick."""
    found = M.explained(M.pca(_points(spark, sf), E)[1])
    return spark.createDataFrame([(*row, chance) for row, chance in zip(found, M.broken_stick(DIMS), strict=True)], "axis string, eigenvalue double, proportion double, cumulative double, by_chance double")


@query("biplot_sites", "id:l year:l month:l PC1:d PC2:d", "climate", """
WITH z AS (SELECT *, (prec - avg(prec) OVER ()) / stddev_samp(prec) OVER () AS a, (aet - avg(aet) OVER ()) / stddev_samp(aet) OVER () AS b FROM climate), r AS (SELECT corr(prec, aet) AS r FROM climate)
SELECT id, year, month, (a + CASE WHEN r > 0 THEN b ELSE -b END) / sqrt(2) / sqrt(1 + abs(r)) AS PC1, (a + CASE WHEN r > 0 THEN -b ELSE b END) / sqrt(2) / sqrt(1 - abs(r)) AS PC2 FROM z, r""")
def biplot_sites(spark, sf):
    """M2: scores of rows on the components of two variables, scaling 2."""
    c = A.climate(spark, sf)
    scores, values, vectors = M.pca(c, ["prec", "aet"])
    return M.biplot(scores, ["prec", "aet"], values, vectors, c.count(), 2)[0]


#: Two standardised responses (y) on two variables (x), in closed form: r.. correlations, c.. coefficients, f.. fitted moments.
_RDA = """s AS (SELECT corr(aet, month) AS x, corr(prec, aet) AS p1, corr(prec, month) AS p2, corr(pet, aet) AS q1, corr(pet, month) AS q2, corr(prec, pet) AS y, count(*) AS n FROM climate),
k AS (SELECT *, (p1 - x * p2) / (1 - x * x) AS c11, (p2 - x * p1) / (1 - x * x) AS c21, (q1 - x * q2) / (1 - x * x) AS c12, (q2 - x * q1) / (1 - x * x) AS c22 FROM s),
f AS (SELECT *, c11 * p1 + c21 * p2 AS f11, c11 * q1 + c21 * q2 AS f12, c12 * q1 + c22 * q2 AS f22 FROM k),
w AS (SELECT *, (f11 + f22) / 2 + sqrt(pow((f11 - f22) / 2, 2) + f12 * f12) AS l1, (f11 + f22) / 2 - sqrt(pow((f11 - f22) / 2, 2) + f12 * f12) AS l2, (2 - f11 - f22) / 2 + sqrt(pow((f22 - f11) / 2, 2) + (y - f12) * (y - f12)) AS g1 FROM f)"""
_AXES = """v AS (SELECT *, f12 AS u1, l1 - f11 AS u2, y - f12 AS t1, g1 - 1 + f11 AS t2 FROM w), a AS (SELECT *, u1 / sqrt(u1 * u1 + u2 * u2) * CASE WHEN abs(u1) >= abs(u2) THEN sign(u1) ELSE sign(u2) END AS a1, u2 / sqrt(u1 * u1 + u2 * u2) * CASE WHEN abs(u1) >= abs(u2) THEN sign(u1) ELSE sign(u2) END AS a2,
t1 / sqrt(t1 * t1 + t2 * t2) * CASE WHEN abs(t1) >= abs(t2) THEN sign(t1) ELSE sign(t2) END AS b1, t2 / sqrt(t1 * t1 + t2 * t2) * CASE WHEN abs(t1) >= abs(t2) THEN sign(t1) ELSE sign(t2) END AS b2 FROM v),
z AS (SELECT id, year, month, (prec - avg(prec) OVER ()) / stddev_samp(prec) OVER () AS z1, (pet - avg(pet) OVER ()) / stddev_samp(pet) OVER () AS z2, (aet - avg(aet) OVER ()) / stddev_samp(aet) OVER () AS x1, (month - avg(month) OVER ()) / stddev_samp(month) OVER () AS x2 FROM climate)"""


@query("redundancy_scores", "id:l year:l month:l fit1:d site1:d res1:d", "climate", f"""
WITH {_RDA}, {_AXES} SELECT id, year, month, (a1 * (c11 * x1 + c21 * x2) + a2 * (c12 * x1 + c22 * x2)) / sqrt(l1) AS fit1, (a1 * z1 + a2 * z2) / sqrt(l1) AS site1,
(b1 * (z1 - c11 * x1 - c21 * x2) + b2 * (z2 - c12 * x1 - c22 * x2)) / sqrt(g1) AS res1 FROM z, a""")
def redundancy_scores(spark, sf):
    """Scores of rows on the first fitted and residual axes, scaling 2."""
    return M.ordination_scores(A.climate(spark, sf), ["prec", "pet"], ["aet", "month"], scaling=2)


@query("bd_distance", "a:l b:l bd:d")
def bd_distance(spark, sf):
    return M.bd_distances(_points(spark, sf), "label", E)


@query("mvee", "label:l n:l volume:d")
def mvee(spark, sf):
    return M.volumes(_points(spark, sf), "label", E)


@query("should_merge", "a:l b:l by_volume:l inside:d merge:l")
def should_merge(spark, sf):
    """M9: classes 0 and 1, 2 and 3, ..."""
    out = M.merges(_points(spark, sf), "label", E, [(k, k + 1) for k in range(0, 10, 2)])
    return out.withColumns({c: F.col(c).cast("int") for c in ("by_volume", "merge")})


@query("dunn_index", "separation:d diameter:d dunn:d", "", f"""
WITH {_PTS}, d AS (SELECT a.label = b.label AS same, sqrt({" + ".join(f"(a.e{i} - b.e{i}) * (a.e{i} - b.e{i})" for i in range(DIMS))}) AS d FROM pts a JOIN pts b ON a.id <= b.id)
SELECT min(d) FILTER (NOT same) AS separation, max(d) FILTER (same) AS diameter, min(d) FILTER (NOT same) / max(d) FILTER (same) AS dunn FROM d""")
def dunn_index(spark, sf):
    """M4: Dunn's index of the labels."""
    return M.dunn(_points(spark, sf), "label", E)


@query("silhouette", "id:l label:l silhouette:d", "", """
WITH pts AS (SELECT vec_id AS id, label, CASE WHEN len(embedding) > 0 AND list_count(embedding) = len(embedding) THEN embedding::DOUBLE[] END AS v FROM embeddings), d AS (SELECT a.id, a.label, b.label AS other, sum(CASE WHEN len(a.v) = len(b.v) THEN list_distance(a.v, b.v) END) AS s, count(*) AS n FROM pts a CROSS JOIN pts b GROUP BY ALL),
m AS (SELECT id, label, max(CASE WHEN other = label THEN s / nullif(n - 1, 0) END) AS inn, min(CASE WHEN other <> label THEN s / n END) AS outt, max(CASE WHEN other = label THEN n END) AS own FROM d GROUP BY ALL)
SELECT id, label, CASE WHEN own > 1 THEN (outt - inn) / greatest(inn, outt) ELSE 0 END AS silhouette FROM m""")
def silhouette(spark, sf):
    """M4: of all numbers of each embedding."""
    d = A.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("label"), "embedding")
    return M.silhouette(d, "label", "embedding")


_WITHIN = " + ".join(f"var_pop(e{i})" for i in range(DIMS))
_APART = " + ".join(f"(a{i} - t{i} / n) * (a{i} - t{i} / n)" for i in range(DIMS))


@query("calinski_harabasz", "n:l k:l ch:d", "", f"""
WITH {_PTS}, g AS (SELECT label, count(*) AS m, {", ".join(f"avg(e{i}) AS a{i}" for i in range(DIMS))}, count(*) * ({_WITHIN}) AS w FROM pts GROUP BY label),
t AS (SELECT sum(m) AS n, count(*) AS k, sum(w) AS w, {", ".join(f"sum(m * a{i}) AS t{i}" for i in range(DIMS))} FROM g)
SELECT n, k, sum(m * ({_APART})) / (k - 1) / (t.w / (n - k)) AS ch FROM g CROSS JOIN t GROUP BY n, k, t.w""")
def calinski_harabasz(spark, sf):
    return M.calinski_harabasz(_points(spark, sf), "label", E)


@query("discriminant_accuracy", "label:l n:l accuracy:d")
def discriminant_accuracy(spark, sf):
    return M.discriminant_accuracy(_points(spark, sf), "label", E)


def _season_cells(spark, sf, g):
    return S.series(A.period_fires(spark, sf)).select("id", "period", *[F.element_at("m", m).cast("double").alias(f"m{m}") for m in (1, 4, 7, 10)]).join(g.select("id"), "id")


@query("fusion_levels", "period:s step:l height:d")
def fusion_levels(spark, sf):
    """M4: costs of all constrained merges of each period's cells."""
    g = A.grid(spark, sf)
    return M.fusion_levels(_season_cells(spark, sf, g), G.neighbours(g), ["period"], ["m1", "m4", "m7", "m10"])


@query("partial_redundancy", "axis:l eigenvalue:d r2:d r2_adj:d")
def partial_redundancy(spark, sf):
    """What aet explains of prec and pet beside the month."""
    r2, adjusted, values = M.redundancy(A.climate(spark, sf), ["prec", "pet"], ["aet"], ["month"])
    return spark.createDataFrame([(k + 1, float(v), r2, adjusted) for k, v in enumerate(values)], "axis int, eigenvalue double, r2 double, r2_adj double")


@query("constrained_clusters", "period:s id:l cluster:l")
def constrained_clusters(spark, sf):
    g = A.grid(spark, sf)
    return M.constrained_clusters(_season_cells(spark, sf, g), G.neighbours(g), ["period"], ["m1", "m4", "m7", "m10"], 5)


@query("discriminants", "axis:l variable:s coefficient:d eigenvalue:d")
def discriminants(spark, sf):
    values, vectors = M.discriminants(_points(spark, sf), "label", E)
    return spark.createDataFrame([(k + 1, E[i], float(vectors[i, k]), float(values[k])) for k in range(len(values)) for i in range(DIMS)], "axis int, variable string, coefficient double, eigenvalue double")


@query("redundancy", "axis:l eigenvalue:d r2:d r2_adj:d", "climate", f"WITH {_RDA} SELECT axis, CASE axis WHEN 1 THEN l1 ELSE l2 END AS eigenvalue, (f11 + f22) / 2 AS r2, 1 - (1 - (f11 + f22) / 2) * (n - 1) / (n - 3) AS r2_adj FROM w, (VALUES (1), (2)) t(axis)")
def redundancy(spark, sf):
    c = A.climate(spark, sf)
    r2, adjusted, values = M.redundancy(c, ["prec", "pet"], ["aet", "month"])
    return spark.createDataFrame([(k + 1, float(v), r2, adjusted) for k, v in enumerate(values)], "axis int, eigenvalue double, r2 double, r2_adj double")


@query("clip_fraction", "cell:l area:l frac:d", "grid", """
WITH n AS (SELECT n_nationkey AS id, (n_nationkey * 7 % 10)::DOUBLE AS x0, (n_nationkey * 3 % 10)::DOUBLE + 0.25 AS y0, 1.5 + n_nationkey % 3 AS w, 0.5 + n_nationkey % 2 AS h FROM nation)
SELECT g.id AS cell, n.id AS area, (least(col + 1, x0 + w) - greatest(col, x0)) * (least(row + 1, y0 + h) - greatest(row, y0)) AS frac
FROM grid g JOIN n ON least(col + 1, x0 + w) > greatest(col, x0) AND least(row + 1, y0 + h) > greatest(row, y0)""")
def clip_fraction(spark, sf):
    k = F.col("n_nationkey")
    x0, y0 = (k * 7 % 10).cast("double"), (k * 3 % 10).cast("double") + 0.25
    areas = A.read(spark, sf, "nation").select(k.cast("long").alias("id"), X.rectangle(x0, y0, x0 + 1.5 + k % 3, y0 + 0.5 + k % 2).alias("ring"))
    g = A.grid(spark, sf)
    cells = g.select("id", X.rectangle(F.col("col"), F.col("row"), F.col("col") + 1, F.col("row") + 1).alias("ring"))
    return X.clip_fractions(cells, areas, 2.0)


@query("areal_density", "id:l density:d", "grid", """
WITH n AS (SELECT n_nationkey AS id, (n_nationkey * 7 % 10)::DOUBLE AS x0, (n_nationkey * 3 % 10)::DOUBLE + 0.25 AS y0, 1.5 + n_nationkey % 3 AS w, 0.5 + n_nationkey % 2 AS h FROM nation),
c AS (SELECT c_nationkey AS area, avg(c_acctbal) AS density FROM customer GROUP BY 1),
f AS (SELECT g.id AS cell, n.id AS area, (least(col + 1, x0 + w) - greatest(col, x0)) * (least(row + 1, y0 + h) - greatest(row, y0)) AS frac FROM grid g JOIN n ON least(col + 1, x0 + w) > greatest(col, x0) AND least(row + 1, y0 + h) > greatest(row, y0))
SELECT cell AS id, sum(frac * density) AS density FROM f JOIN c USING (area) GROUP BY cell""")
def areal_density(spark, sf):
    """A24 over clipped fractions: sum of fraction times density."""
    density = A.read(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("long").alias("area")).agg(F.avg("c_acctbal").alias("density"))
    return clip_fraction(spark, sf).join(density, "area").groupBy(F.col("cell").alias("id")).agg(F.sum(F.col("frac") * F.col("density")).alias("density"))


@query("tumbling_events", "start:s event_type:s total:d n:l", "", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, sum(value) AS total, count(*) AS n FROM events GROUP BY ALL")
def tumbling_events(spark, sf):
    return I.tumbling(A.read(spark, sf, "events"))


@query("sliding_events", "start:s n:l", "", "SELECT strftime(time_bucket(INTERVAL 2 HOURS, ts, TIMESTAMP '1970-01-01') - INTERVAL 2 HOURS * k, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM events CROSS JOIN (SELECT unnest(range(0, 3)) AS k) GROUP BY ALL")
def sliding_events(spark, sf):
    return I.sliding(A.read(spark, sf, "events"))


@query("session_events", "user_id:l first_s:l last_s:l n:l", "", """
WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS first_s, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_s, count(*) AS n FROM s GROUP BY user_id, k""")
def session_events(spark, sf):
    seconds = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / 1e6)
    return I.sessions(A.read(spark, sf, "events")).select("user_id", seconds("start").alias("first_s"), seconds("last").alias("last_s"), "n")


@query("top_customers", "c_nationkey:l c_custkey:l total:d", "", "SELECT c_nationkey, c_custkey, sum(CAST(round(o_totalprice * 100) AS BIGINT)) / 100.0 AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_nationkey, c_custkey QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY sum(CAST(round(o_totalprice * 100) AS BIGINT)) DESC, c_custkey) <= 3")
def top_customers(spark, sf):
    c, o = A.read(spark, sf, "customer"), A.read(spark, sf, "orders")
    sums = c.join(o, c.c_custkey == o.o_custkey).groupBy("c_nationkey", "c_custkey").agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / 100.0).alias("total"))
    return R.top_by(sums, ["c_nationkey"], [F.col("total").desc(), F.col("c_custkey")], 3)
