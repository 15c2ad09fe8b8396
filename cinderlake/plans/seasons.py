"""Queries of the season family over fires by cell and period."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinderlake.functions import months as M
from cinderlake.operators import season as S
from cinderlake.plans.build import query
from cinderlake.sources import adapters as A

_BACK = "CASE WHEN {0} - 6 + peak > 12 THEN {0} - 18 + peak WHEN {0} - 6 + peak < 1 THEN {0} + 6 + peak ELSE {0} - 6 + peak END"


@query("peak_month", "id:l period:s peak_month:l", "pk", "SELECT id, period, peak AS peak_month FROM pk")
def peak_month(spark, sf):
    return S.peak(A.period_fires(spark, sf))


@query("month_relabel", "id:l period:s month:l relabelled:l units:l", "rl", "SELECT id, period, month, r AS relabelled, v AS units FROM rl")
def month_relabel(spark, sf):
    s = S.with_peak(S.series(A.period_fires(spark, sf)))
    rows = s.select("id", "period", "peak", F.posexplode("rel").alias("pos", "units")).withColumn("relabelled", F.col("pos") + 1)
    return rows.withColumn("month", M.original(F.col("relabelled"), F.col("peak")))


@query("season_quantiles", "id:l period:s q05_month:l median_month:l q95_month:l q_length:l", "cs", f"""
WITH g AS (SELECT *, 100.0::DOUBLE * run / total AS share FROM cs),
q AS (SELECT id, period, peak, arg_min(r, (abs(share - 5), r)) AS a, arg_min(r, (abs(share - 50), r)) AS b, arg_min(r, (abs(share - 95), r)) AS c FROM g GROUP BY ALL)
SELECT id, period, {_BACK.format("a")} AS q05_month, {_BACK.format("b")} AS median_month, {_BACK.format("c")} AS q95_month, c - a + 1 AS q_length FROM q""")
def season_quantiles(spark, sf):
    return S.quantiles_nearest(A.period_fires(spark, sf))


@query("prec_season_quantiles", "id:l period:s peak_month:l q05_month:l median_month:l q95_month:l q_length:l", "climate", f"""
WITH m AS (SELECT id, {A.PERIOD_SQL} AS period, month, avg(prec) AS v FROM climate WHERE {A.PERIOD_SQL} IS NOT NULL GROUP BY ALL),
d AS (SELECT k.id, k.period, t.month, coalesce(m.v, 0.0::DOUBLE) AS v FROM (SELECT DISTINCT id, period FROM m) k CROSS JOIN (SELECT unnest(range(1, 13)) AS month) t LEFT JOIN m ON m.id = k.id AND m.period = k.period AND m.month = t.month),
p AS (SELECT id, period, arg_max(month, (v, -month)) AS peak FROM d GROUP BY ALL),
r AS (SELECT id, period, peak, v, (month + 6 - peak + 23) % 12 + 1 AS r FROM d JOIN p USING (id, period)),
g AS (SELECT *, 100.0::DOUBLE * sum(v) OVER (PARTITION BY id, period ORDER BY r) / sum(v) OVER (PARTITION BY id, period) AS share FROM r),
q AS (SELECT id, period, peak, arg_min(r, (abs(share - 5), r)) AS a, arg_min(r, (abs(share - 50), r)) AS b, arg_min(r, (abs(share - 95), r)) AS c FROM g GROUP BY ALL)
SELECT id, period, peak AS peak_month, {_BACK.format("a")} AS q05_month, {_BACK.format("b")} AS median_month, {_BACK.format("c")} AS q95_month, c - a + 1 AS q_length FROM q""")
def prec_season_quantiles(spark, sf):
    """Peak and quantiles of the mean monthly precipitation of a period, outer-joined."""
    c = A.climate(spark, sf).withColumn("period", A.period_of(F.col("year"))).where("period IS NOT NULL")
    mean = c.groupBy("id", "period", "month").agg(F.avg("prec").alias("mean_prec"))
    return S.upsert(S.peak(mean, value="mean_prec"), S.quantiles_nearest(mean, value="mean_prec"))


@query("season_variance","id:l period:s mean:d var_month:d std_month:d", "rl", """
WITH mu AS (SELECT id, period, sum(v * r)::DOUBLE / sum(v) AS mean FROM rl GROUP BY ALL)
SELECT id, period, mean, sum(v * (r - mean) * (r - mean)) / sum(v) AS var_month, sqrt(sum(v * (r - mean) * (r - mean)) / sum(v)) AS std_month FROM rl JOIN mu USING (id, period) GROUP BY id, period, mean""")
def season_variance(spark, sf):
    return S.variance(A.period_fires(spark, sf))


def _inverse(q: str) -> str:
    return f"""(SELECT id, period, CASE WHEN max(r) FILTER (e <= t) >= 12 THEN 12.0::DOUBLE
      ELSE max(r) FILTER (e <= t) + (max(t) - max(e) FILTER (e <= t)) / (min(e) FILTER (e > t) - max(e) FILTER (e <= t)) END AS x
      FROM (SELECT *, greatest({q}, min(e) OVER (PARTITION BY id, period)) AS t FROM ecdf) GROUP BY ALL)"""


@query("season_secdf", "id:l period:s q05:d q50:d q95:d q_length:d", "cs", f"""
WITH ecdf AS (SELECT id, period, peak, r, run / total AS e FROM cs),
q AS (SELECT k.id, k.period, k.peak, a.x AS a, b.x AS b, c.x AS c FROM pk k JOIN {_inverse("0.05::DOUBLE")} a USING (id, period) JOIN {_inverse("0.5::DOUBLE")} b USING (id, period) JOIN {_inverse("0.95::DOUBLE")} c USING (id, period))
SELECT id, period, {_BACK.format("a")} AS q05, {_BACK.format("b")} AS q50, {_BACK.format("c")} AS q95, c - a AS q_length FROM q""")
def season_secdf(spark, sf):
    return S.quantiles_smoothed(A.period_fires(spark, sf))


@query("season_ranking", "id:l period:s length_ranking_80:l", "dense", """
WITH r AS (SELECT id, period, row_number() OVER (PARTITION BY id, period ORDER BY v DESC, month) AS k, 100.0::DOUBLE * sum(v) OVER (PARTITION BY id, period ORDER BY v DESC, month) / sum(v) OVER (PARTITION BY id, period) AS share FROM dense),
b AS (SELECT id, period, arg_min(k, (abs(share - 80), k)) AS k FROM r GROUP BY ALL)
SELECT b.id, b.period, CASE WHEN r.share - 80 > 2 THEN greatest(b.k - 1, 1) ELSE b.k END AS length_ranking_80 FROM b JOIN r USING (id, period, k)""")
def season_ranking(spark, sf):
    return S.ranking(A.period_fires(spark, sf))


@query("concentration_index", "id:l period:s ci:d peak_ci:l", "dense", """
WITH xy AS (SELECT id, period, sum(v * cos(radians(month * 30.0 - 15.0))) AS x, sum(v * sin(radians(month * 30.0 - 15.0))) AS y, sum(v) AS t FROM dense GROUP BY ALL),
d AS (SELECT *, CASE WHEN degrees(atan2(y, x)) < 0 THEN degrees(atan2(y, x)) + 360.0 ELSE degrees(atan2(y, x)) END AS g FROM xy)
SELECT id, period, 100.0 * sqrt(x * x + y * y) / t AS ci, arg_min(month, (round(abs(month * 30.0 - 15.0 - g), 9), month)) AS peak_ci FROM d CROSS JOIN months GROUP BY id, period, x, y, t""")
def concentration_index(spark, sf):
    return S.concentration(A.period_fires(spark, sf))


@query("interquantile_dates", "id:l year:l first_date:s last_date:s days:l", "fires", """
WITH d AS (SELECT id, year, date, sum(units) AS v FROM fires GROUP BY ALL),
s AS (SELECT *, 100.0::DOUBLE * sum(v) OVER (PARTITION BY id, year ORDER BY date) / sum(v) OVER (PARTITION BY id, year) AS share FROM d),
p AS (SELECT id, year, arg_min(date, (abs(share - 10), date)) AS a, arg_min(date, (abs(share - 90), date)) AS b FROM s GROUP BY ALL)
SELECT id, year, a AS first_date, b AS last_date, date_diff('day', a, b) + 1 AS days FROM p""")
def interquantile_dates(spark, sf):
    return S.interquantile_dates(A.fires(spark, sf))


@query("threshold_season", "id:l period:s first_month:l last_month:l length:l", "dense", """
SELECT id, period, min(month) FILTER (hit) AS first_month, max(month) FILTER (hit) AS last_month, max(month) FILTER (hit) - min(month) FILTER (hit) + 1 AS length
FROM (SELECT *, v * 100.0::DOUBLE / sum(v) OVER (PARTITION BY id, period) >= 10 AS hit FROM dense) GROUP BY id, period""")
def threshold_season(spark, sf):
    return S.threshold_season(A.period_fires(spark, sf))


@query("threshold_avg_season", "id:l year:l first_month:l last_month:l length:l", "fires", """
WITH m AS (SELECT id, year, month, sum(units)::DOUBLE AS v FROM fires GROUP BY ALL), t AS (SELECT id, year, sum(v) AS t FROM m GROUP BY ALL), a AS (SELECT id, avg(t) AS a FROM t GROUP BY ALL)
SELECT t.id, t.year, min(m.month) AS first_month, max(m.month) AS last_month, max(m.month) - min(m.month) + 1 AS length
FROM t JOIN a ON a.id = t.id LEFT JOIN m ON m.id = t.id AND m.year = t.year AND m.v * 100.0::DOUBLE / a.a >= 10 GROUP BY t.id, t.year""")
def threshold_avg_season(spark, sf):
    return S.threshold_season_longrun(A.fires(spark, sf))


@query("season_nearest_quantile", "id:l period:s q05:l q50:l q95:l length:l", "pf months", f"""
WITH c AS (SELECT k.id, k.period, month, count(p.fire_id) AS v FROM (SELECT DISTINCT id, period FROM pf) k CROSS JOIN months LEFT JOIN pf p USING (id, period, month) GROUP BY ALL),
k AS (SELECT id, period, month AS peak FROM c QUALIFY row_number() OVER (PARTITION BY id, period ORDER BY v DESC, month) = 1),
r AS (SELECT id, period, peak, v, (month + 6 - peak + 23) % 12 + 1 AS r FROM c JOIN k USING (id, period)),
s AS (SELECT *, sum(v) OVER (PARTITION BY id, period ORDER BY r) AS run, sum(v) OVER (PARTITION BY id, period) AS n FROM r),
q AS (SELECT id, period, peak, min(r) FILTER (run >= round_even(0.05::DOUBLE * (n - 1), 0) + 1) AS a, min(r) FILTER (run >= round_even(0.5::DOUBLE * (n - 1), 0) + 1) AS b, min(r) FILTER (run >= round_even(0.95::DOUBLE * (n - 1), 0) + 1) AS c FROM s GROUP BY ALL)
SELECT id, period, {_BACK.format("a")} AS q05, {_BACK.format("b")} AS q50, {_BACK.format("c")} AS q95, c - a + 1 AS length FROM q""")
def season_nearest_quantile(spark, sf):
    return S.quantiles_by_count(A.period_fires(spark, sf))


@query("season_code", "id:l period:s code:s", "cs", f"""
WITH g AS (SELECT *, 100.0::DOUBLE * run / total AS share FROM cs),
q AS (SELECT id, period, peak, arg_min(r, (abs(share - 5), r)) AS a, arg_min(r, (abs(share - 95), r)) AS c FROM g GROUP BY ALL)
SELECT id, period, substr('JFMAMJJASONDJFMAMJJASOND', {_BACK.format("a")}, CAST((({_BACK.format("c")}) - ({_BACK.format("a")}) + 12) % 12 + 1 AS BIGINT)) AS code FROM q""")
def season_code(spark, sf):
    return S.quantiles_nearest(A.period_fires(spark, sf)).withColumn("code", M.season_code(F.col("q05_month"), F.col("q95_month")))


@query("season_upsert", "id:l period:s peak_month:l length_ranking_80:l ci:d", "pk dense", """
WITH xy AS (SELECT id, period, sum(v * cos(radians(month * 30.0 - 15.0))) AS x, sum(v * sin(radians(month * 30.0 - 15.0))) AS y, sum(v) AS t FROM dense GROUP BY ALL),
r AS (SELECT id, period, row_number() OVER (PARTITION BY id, period ORDER BY v DESC, month) AS k, 100.0::DOUBLE * sum(v) OVER (PARTITION BY id, period ORDER BY v DESC, month) / sum(v) OVER (PARTITION BY id, period) AS share FROM dense),
b AS (SELECT id, period, arg_min(k, (abs(share - 80), k)) AS k FROM r GROUP BY ALL)
SELECT pk.id, pk.period, peak AS peak_month, CASE WHEN r.share - 80 > 2 THEN greatest(b.k - 1, 1) ELSE b.k END AS length_ranking_80, 100.0 * sqrt(x * x + y * y) / t AS ci
FROM pk JOIN b USING (id, period) JOIN r USING (id, period, k) JOIN xy USING (id, period)""")
def season_upsert(spark, sf):
    f = A.period_fires(spark, sf)
    return S.upsert(S.upsert(S.peak(f), S.ranking(f)), S.concentration(f))


@query("largest_fire_month", "id:l period:s largest_fire_month:l most_fires_month:l", "pf dense", """
SELECT id, period, l AS largest_fire_month, m AS most_fires_month FROM (SELECT id, period, arg_max(month, (units, -month)) AS l FROM pf GROUP BY ALL)
JOIN (SELECT id, period, arg_max(month, (n, -month)) AS m FROM dense GROUP BY ALL) USING (id, period)""")
def largest_fire_month(spark, sf):
    return S.largest_fire_month(A.period_fires(spark, sf))


@query("gap_fill", "id:l year:l peak_month:l was_missing:l", "fires", """
WITH m AS (SELECT id, year, month, sum(units) AS v FROM fires GROUP BY ALL), p AS (SELECT id, year, arg_max(month, (v, -month)) AS p, max(v) AS v, sum(v) AS t FROM m GROUP BY id, year),
g AS (SELECT id, year, CASE WHEN v * 7 >= t THEN p END AS p FROM p)
SELECT id, year, coalesce(p, CAST(floor((lag(p) OVER w + lead(p) OVER w) / 2.0) AS BIGINT), lag(p) OVER w) AS peak_month, CAST(p IS NULL AS INT) AS was_missing FROM g WINDOW w AS (PARTITION BY id ORDER BY year)""")
def gap_fill(spark, sf):
    s = S.series(A.fires(spark, sf), ["id", "year"])
    clear = F.array_max("m") * 7 >= M.total(F.col("m"))  # years without a clear peak count as missing
    return S.fill_gaps(s.select("id", "year", F.when(clear, M.peak_month(F.col("m"))).alias("peak_month")))


@query("driest_month", "id:l lowest_month:l", "climate", "SELECT id, arg_min(month, (round(v, 9), month)) AS lowest_month FROM (SELECT id, month, avg(prec) AS v FROM climate GROUP BY ALL) GROUP BY id")
def driest_month(spark, sf):
    return S.lowest_month(A.climate(spark, sf), "prec")


@query("fire_year_shift", "id:l year:l month:l fire_year:l fire_month:l", "climate", """
WITH s AS (SELECT id, arg_min(month, (round(v, 9), month)) AS shift FROM (SELECT id, month, avg(prec) AS v FROM climate GROUP BY ALL) GROUP BY id),
a AS (SELECT c.id, year, month, 12 * (year - 1995) + month - 1 - shift AS k FROM climate c JOIN s ON s.id = c.id)
SELECT id, year, month, CASE WHEN k >= 0 THEN k // 12 + 1995 END AS fire_year, CASE WHEN k >= 0 THEN k % 12 + 1 END AS fire_month FROM a""")
def fire_year_shift(spark, sf):
    c = A.climate(spark, sf)
    return S.fire_year(c, S.lowest_month(c, "prec").withColumnRenamed("lowest_month", "shift"), A.YEARS[0])
