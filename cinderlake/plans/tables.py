"""Queries of counts, sizes, frequencies, climate and land cover."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinderlake.operators import climate as C
from cinderlake.operators import multivariate as M
from cinderlake.operators import relational as R
from cinderlake.operators import size as Z
from cinderlake.plans.build import query
from cinderlake.sources import adapters as A

MONTHS = range(1, 13)
YEARS_OF = lambda p: F.substring(p, 6, 4).cast("int") - F.substring(p, 1, 4).cast("int") + 1
#: Class codes (1 to 50) in an invented three-level tree: tens, then fives, then codes.
GROUPS = {1: "natural", 3: "natural", 4: "natural", 11: "natural", 12: "natural", 13: "natural", 14: "anthropic", 15: "anthropic", 18: "anthropic", 21: "anthropic", 22: "nonflammable", 26: "nonflammable", 27: "nonflammable", 29: "nonflammable", 32: "nonflammable"}
FLAMMABLE = [1, 11, 12, 13, 14]
VINTAGES = {1995: 1994, 1996: 1997, 1997: 2000, 1998: 2000, 1999: 2000, 2000: 2000, 2001: 2001}


@query("fire_count", "id:l period:s npolygons:l", "pf", "SELECT id, period, count(*) AS npolygons FROM pf GROUP BY ALL")
def fire_count(spark, sf):
    return R.count_by(A.period_fires(spark, sf), ["id", "period"])


@query("cell_month_area", "id:l year:l month:l area:d npolygons:l", "fires", "SELECT id, year, month, sum(units) * 0.01 AS area, count(*) AS npolygons FROM fires WHERE units >= 3 GROUP BY ALL")
def cell_month_area(spark, sf):
    f = A.fires(spark, sf).where(F.col("units") >= A.MIN_UNITS)
    return f.groupBy("id", "year", "month").agg((F.sum("units") * A.UNIT_KM2).alias("area"), F.count("*").alias("npolygons"))


@query("cell_month_wide", "id:l year:l " + " ".join(f"m{m}:l" for m in MONTHS), "fires", "SELECT id, year, " + ", ".join(f"coalesce(sum(units) FILTER (month = {m}), 0) AS m{m}" for m in MONTHS) + " FROM fires WHERE units >= 3 GROUP BY ALL")
def cell_month_wide(spark, sf):
    return R.pivot_sum(A.fires(spark, sf).where(F.col("units") >= A.MIN_UNITS), ["id", "year"], "month", MONTHS, "units", "m")


@query("period_rollup", "id:l period:s npolygons:l area:d", "pf", "SELECT id, period, count(*) AS npolygons, sum(units) * 0.01 AS area FROM pf GROUP BY ALL")
def period_rollup(spark, sf):
    yearly = A.period_fires(spark, sf).groupBy("id", "period", "year").agg(F.count("*").alias("n"), F.sum("units").alias("u"))
    return yearly.groupBy("id", "period").agg(F.sum("n").alias("npolygons"), (F.sum("u") * A.UNIT_KM2).alias("area"))


@query("month_melt", "id:l year:l month:s units:l", "fires", "WITH k AS (SELECT DISTINCT id, year FROM fires), m AS (SELECT unnest(range(1, 13)) AS month) SELECT k.id, k.year, 'm' || m.month AS month, coalesce(sum(f.units), 0) AS units FROM k CROSS JOIN m LEFT JOIN fires f USING (id, year, month) GROUP BY ALL")
def month_melt(spark, sf):
    wide = R.pivot_sum(A.fires(spark, sf), ["id", "year"], "month", MONTHS, "units", "m")
    return R.melt(wide, ["id", "year"], [f"m{m}" for m in MONTHS], "month", "units")


@query("period_bin", "period:s years:l fires:l", "fires", f"SELECT {A.PERIOD_SQL} AS period, count(DISTINCT year) AS years, count(*) AS fires FROM fires GROUP BY 1")
def period_bin(spark, sf):
    return A.fires(spark, sf).withColumn("period", A.period_of(F.col("year"))).groupBy("period").agg(F.count_distinct("year").alias("years"), F.count("*").alias("fires"))


@query("grid_filter", "id:l row:l col:l pct_area:d npolygons:l", "fires grid", "SELECT id, row, col, pct_area, count(*) AS npolygons FROM fires JOIN grid USING (id) WHERE (pct_area >= 75 OR id IN (7, 8)) AND id NOT IN (5) GROUP BY ALL")
def grid_filter(spark, sf):
    counts = R.count_by(A.fires(spark, sf), ["id"])
    return R.cell_filter(counts, A.grid(spark, sf), 75, include=[7, 8], exclude=[5])


@query("id_format", "year_month:s n:l first_id:s", "fires", "SELECT year || lpad(CAST(month AS VARCHAR), 2, '0') AS year_month, count(*) AS n, min(year || lpad(CAST(month AS VARCHAR), 2, '0') || '_' || fire_id) AS first_id FROM fires GROUP BY 1")
def id_format(spark, sf):
    f = A.fires(spark, sf).withColumn("year_month", F.format_string("%d%02d", "year", "month"))
    return f.groupBy("year_month").agg(F.count("*").alias("n"), F.min(F.concat_ws("_", "year_month", "fire_id")).alias("first_id"))


@query("date_parts", "year:l quarter:l day_of_year:l days_in_month:l n:l", "fires", "SELECT year, quarter(date) AS quarter, dayofyear(date) AS day_of_year, CASE WHEN month = 2 THEN 28 ELSE day(last_day(date)) END AS days_in_month, count(*) AS n FROM fires GROUP BY ALL")
def date_parts(spark, sf):
    days = F.when(F.col("month") == 2, 28).otherwise(F.day(F.last_day("date")))
    return A.fires(spark, sf).groupBy("year", F.quarter("date").alias("quarter"), F.dayofyear("date").alias("day_of_year"), days.alias("days_in_month")).agg(F.count("*").alias("n"))


@query("size_quantiles", "id:l period:s q_0.05:d q_0.5:d q_0.95:d q_0.99:d q_1.0:d", "pf", "SELECT id, period, " + ", ".join(f'quantile_cont(units * 0.01::DOUBLE, {q}) AS "q_{q}"' for q in Z.QUANTILES) + " FROM pf GROUP BY ALL")
def size_quantiles(spark, sf):
    return Z.size_quantiles(A.period_fires(spark, sf).withColumn("area", F.col("units") * A.UNIT_KM2), ["id", "period"])


@query("powerlaw_fit", "id:l period:s pwl_alpha:d pwl_sigma:d", "pf", "SELECT id, period, 1 + n / nullif(s, 0) AS pwl_alpha, (n / nullif(s, 0)) / sqrt(n) AS pwl_sigma FROM (SELECT id, period, count(*) AS n, sum(ln(units * 0.01::DOUBLE / 0.03::DOUBLE)) AS s FROM pf GROUP BY ALL)")
def powerlaw_fit(spark, sf):
    return Z.power_law(A.period_fires(spark, sf).withColumn("area", F.col("units") * A.UNIT_KM2), ["id", "period"], least=0.03)


@query("size_by_month", "month:l q50:d q95:d largest:d", "fires", "SELECT month, quantile_cont(units * 0.01::DOUBLE, 0.5) AS q50, quantile_cont(units * 0.01::DOUBLE, 0.95) AS q95, max(units) * 0.01 AS largest FROM fires GROUP BY month")
def size_by_month(spark, sf):
    f = A.fires(spark, sf).withColumn("area", F.col("units") * A.UNIT_KM2)
    return R.quantiles_by(f, ["month"], "area", {"q50": 0.5, "q95": 0.95, "largest": 1.0})


@query("size_by_cell_month", "id:l " + " ".join(f"m{m}:d" for m in MONTHS), "fires", "SELECT id, " + ", ".join(f"quantile_cont(units * 0.01::DOUBLE, 0.5) FILTER (month = {m}) AS m{m}" for m in MONTHS) + " FROM fires GROUP BY id")
def size_by_cell_month(spark, sf):
    """Median sizes by cell, a column for each month; null in months without fires."""
    f = A.fires(spark, sf).withColumn("area", F.col("units") * A.UNIT_KM2)
    q = R.quantiles_by(f, ["id", "month"], "area", {"q50": 0.5})
    return q.groupBy("id").agg(*[F.max(F.when(F.col("month") == m, F.col("q50"))).alias(f"m{m}") for m in MONTHS])


@query("density", "id:l n:l area:d density:d", "", "SELECT c_nationkey AS id, count(*) AS n, c_nationkey % 5 * 2.5 AS area, count(*) / nullif(c_nationkey % 5 * 2.5::DOUBLE, 0) AS density FROM customer GROUP BY c_nationkey")
def density(spark, sf):
    """Customers of each nation to the area; some areas are 0."""
    n = R.count_by(A.read(spark, sf, "customer").select(F.col("c_nationkey").alias("id")), ["id"], "n")
    return R.density(n.withColumn("area", F.col("id") % 5 * 2.5), "n", "area")


@query("fire_return_interval", "id:l period:s area_T:d flammable:d perc_ba:d fri:d fri_freq:d", "pf land", f"""
WITH b AS (SELECT id, period, year, sum(units) * 0.01::DOUBLE AS area FROM pf GROUP BY ALL), fl AS (SELECT cell AS id, year, sum(value)::DOUBLE AS flammable FROM land WHERE cls <= 40 GROUP BY ALL)
SELECT id, period, sum(area) AS area_T, avg(flammable) AS flammable, avg(area / flammable) AS perc_ba, 1 / avg(area / flammable) AS fri, 2 * avg(area / flammable) AS fri_freq FROM b JOIN fl USING (id, year) GROUP BY ALL""")
def fire_return_interval(spark, sf):
    burned = A.period_fires(spark, sf).groupBy("id", "period", "year").agg((F.sum("units") * A.UNIT_KM2).alias("area"))
    fuel = A.land_pixels(spark, sf).where("cls <= 40").groupBy(F.col("cell").alias("id"), "year").agg(F.sum("value").alias("flammable"))
    return Z.return_interval(burned.join(fuel, ["id", "year"]), YEARS_OF)


_FREQ = """fr AS (SELECT id, ok, frequency, count(*) AS npixels FROM (SELECT cell % 25 AS id, px, bool_and(cls <> 50) AS ok, count(DISTINCT year) AS frequency FROM land GROUP BY ALL) WHERE ok GROUP BY ALL)"""


def _frequency(spark, sf):
    px = A.land_pixels(spark, sf).groupBy((F.col("cell") % 25).alias("id"), "px", "year").agg(F.bool_and(F.col("cls") != 50).alias("flammable")).withColumn("burned", F.lit(1))
    return Z.pixel_frequency(px, ["id"])


@query("pixel_frequency", "id:l frequency:l npixels:l", "land", f"WITH {_FREQ} SELECT id, frequency, npixels FROM fr")
def pixel_frequency(spark, sf):
    return _frequency(spark, sf)


_ECDF = f"{_FREQ}, ks AS (SELECT unnest(range(0, 8)) AS k), e AS (SELECT i.id, k, coalesce(sum(npixels) FILTER (frequency <= k), 0)::DOUBLE / sum(npixels) AS e FROM (SELECT DISTINCT id FROM fr) i CROSS JOIN ks JOIN fr ON fr.id = i.id GROUP BY ALL)"


@query("freq_quantile_nearest", "id:l f05:l f50:l f95:l f99:l", "land", f"WITH {_ECDF} SELECT id, " + ", ".join(f"arg_min(k, (abs(e - {q}::DOUBLE), k)) AS {n}" for q, n in ((0.05, "f05"), (0.5, "f50"), (0.95, "f95"), (0.99, "f99"))) + " FROM e GROUP BY id")
def freq_quantile_nearest(spark, sf):
    return Z.frequency_nearest(_frequency(spark, sf), ["id"], 7)


def _smooth(q: float, name: str) -> str:
    return f"(SELECT id, CASE WHEN max(k) FILTER (e <= t) >= 7 THEN 7.0::DOUBLE ELSE max(k) FILTER (e <= t) + (max(t) - max(e) FILTER (e <= t)) / (min(e) FILTER (e > t) - max(e) FILTER (e <= t)) END AS {name} FROM (SELECT *, greatest({q}::DOUBLE, min(e) OVER (PARTITION BY id)) AS t FROM e) GROUP BY id)"


@query("freq_quantile_secdf", "id:l f05:d f50:d f95:d f99:d", "land", f"WITH {_ECDF}, one AS (SELECT id, min(frequency) AS lo, max(frequency) AS hi FROM fr GROUP BY id) SELECT id, " + ", ".join(f"CASE WHEN lo = hi THEN lo ELSE {n} END AS {n}" for n in ("f05", "f50", "f95", "f99")) + f" FROM one JOIN {_smooth(0.05, 'f05')} USING (id) JOIN {_smooth(0.5, 'f50')} USING (id) JOIN {_smooth(0.95, 'f95')} USING (id) JOIN {_smooth(0.99, 'f99')} USING (id)")
def freq_quantile_secdf(spark, sf):
    return Z.frequency_smoothed(_frequency(spark, sf), ["id"], 7)


@query("freq_exceedance", "id:l mean:d q95:d ge1:d ge2:d ge3:d", "land", f"WITH {_FREQ}, x AS (SELECT id, unnest(range(0, npixels)), frequency FROM fr) SELECT id, avg(frequency) AS mean, quantile_cont(frequency, 0.95) AS q95, avg(CAST(frequency >= 1 AS INT)) AS ge1, avg(CAST(frequency >= 2 AS INT)) AS ge2, avg(CAST(frequency >= 3 AS INT)) AS ge3 FROM x GROUP BY id")
def freq_exceedance(spark, sf):
    return Z.frequency_summary(_frequency(spark, sf), ["id"])


@query("rainy_months", "id:l month:l mean_prec:d", "climate", "SELECT id, month, v AS mean_prec FROM (SELECT id, month, avg(prec) AS v FROM climate GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(v, 9) DESC, month) <= 3")
def rainy_months(spark, sf):
    return C.rainy_months(A.climate(spark, sf))


@query("exclude_rainy", "id:l period:s month:l npolygons:l units:l", "pf climate", """
WITH r AS (SELECT id, month FROM (SELECT id, month, avg(prec) AS v FROM climate GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(v, 9) DESC, month) <= 3)
SELECT p.id, period, p.month, CASE WHEN r.id IS NULL THEN count(*) ELSE 0 END AS npolygons, CASE WHEN r.id IS NULL THEN sum(units) ELSE 0 END AS units FROM pf p LEFT JOIN r ON r.id = p.id AND r.month = p.month GROUP BY p.id, period, p.month, r.id""")
def exclude_rainy(spark, sf):
    return C.exclude_rainy(A.period_fires(spark, sf), C.rainy_months(A.climate(spark, sf)))


@query("climate_annual", "id:l year:l prec:d mean_pet:d mean_aet:d ds_len:l", "climate", "SELECT id, year, sum(prec) AS prec, avg(pet) AS mean_pet, avg(aet) AS mean_aet, count(*) FILTER (prec - pet < 0) AS ds_len FROM climate GROUP BY ALL")
def climate_annual(spark, sf):
    return C.annual(A.climate(spark, sf))


@query("dry_season", "id:l period:s mean_prec_ds:d mean_pet_ds:d", "climate", f"SELECT id, period, avg(p) AS mean_prec_ds, avg(e) AS mean_pet_ds FROM (SELECT id, {A.PERIOD_SQL} AS period, year, sum(prec) FILTER (prec - pet < 0) AS p, avg(pet) FILTER (prec - pet < 0) AS e FROM climate GROUP BY ALL) WHERE period IS NOT NULL GROUP BY id, period")
def dry_season(spark, sf):
    return C.dry_season(A.climate(spark, sf), A.period_of(F.col("year")))


@query("monthly_prec", "id:l period:s month:l mean_prec:d", "climate", f"SELECT id, {A.PERIOD_SQL} AS period, month, avg(prec) AS mean_prec FROM climate WHERE {A.PERIOD_SQL} IS NOT NULL GROUP BY ALL")
def monthly_prec(spark, sf):
    c = A.climate(spark, sf).withColumn("period", A.period_of(F.col("year"))).where("period IS NOT NULL")
    return c.groupBy("id", "period", "month").agg(F.avg("prec").alias("mean_prec"))


_WETTEST = "w AS (SELECT id, arg_max(month, (round(v, 9), -month)) AS wettest FROM (SELECT id, month, avg(prec) AS v FROM climate GROUP BY ALL) GROUP BY id)"
_WETTEST_SINGLE = "w AS (SELECT id, arg_max(month, (round(prec, 9), -year, -month)) AS wettest FROM climate GROUP BY id)"
_DEFICIT = """
a AS (SELECT c.*, 12 * (year - 1995) + month - 1 AS m, 12 * (year - 1995) + month - wettest AS pos FROM climate c JOIN w ON w.id = c.id),
y AS (SELECT *, pos // 12 + 1995 AS climate_year, pos % 12 AS k FROM a WHERE pos >= 0),
z AS (SELECT * FROM y QUALIFY count(*) OVER (PARTITION BY id, climate_year) = 12 AND max(m) OVER (PARTITION BY id, climate_year) < 83),
cwd(id, climate_year, k, month, prec, aet, cwd) AS (
  SELECT id, climate_year, k, month, prec, aet, 0.0::DOUBLE FROM z WHERE k = 0
  UNION ALL SELECT z.id, z.climate_year, z.k, z.month, z.prec, z.aet, least(0.0, c.cwd + z.prec - abs(z.aet)) FROM cwd c JOIN z ON z.id = c.id AND z.climate_year = c.climate_year AND z.k = c.k + 1)"""
_CWD = f"{_WETTEST},{_DEFICIT}"


@query("cwd_series", "id:l climate_year:l month:l cwd:d", "climate", f"WITH RECURSIVE {_CWD.strip()} SELECT id, climate_year, month, cwd FROM cwd")
def cwd_series(spark, sf):
    return C.water_deficit(A.climate(spark, sf), 1995, 2001)


@query("mcwd", "id:l climate_year:l mcwd:d mcwd_month:l cwd_length:l", "climate", f"WITH RECURSIVE {_CWD.strip()} SELECT id, climate_year, min(cwd) AS mcwd, arg_min(month, (round(cwd, 9), k)) AS mcwd_month, count(*) FILTER (prec - aet < 0 AND k > 0) AS cwd_length FROM cwd GROUP BY ALL")
def mcwd(spark, sf):
    return C.max_deficit(C.water_deficit(A.climate(spark, sf), 1995, 2001))


@query("mcwd_period", "id:l period:s mean_mcwd:d mean_peak:d mean_length:d", "climate", f"WITH RECURSIVE {_CWD.strip()}, mc AS (SELECT id, climate_year AS year, min(cwd) AS mcwd, arg_min(month, (round(cwd, 9), k)) AS p, count(*) FILTER (prec - aet < 0 AND k > 0) AS l FROM cwd GROUP BY ALL) SELECT id, {A.PERIOD_SQL} AS period, avg(mcwd) AS mean_mcwd, avg(p) AS mean_peak, avg(l) AS mean_length FROM mc WHERE {A.PERIOD_SQL} IS NOT NULL GROUP BY ALL")
def mcwd_period(spark, sf):
    return C.max_deficit_by_period(C.max_deficit(C.water_deficit(A.climate(spark, sf), 1995, 2001)), A.period_of(F.col("climate_year")))


@query("mcwd_annual", "id:l climate_year:l mcwd_year:l mcwd:d mcwd_month:l peak_rel:d cwd_length:l", "climate", f"""
WITH RECURSIVE {_WETTEST_SINGLE},{_DEFICIT}, mc AS (SELECT id, climate_year, min(cwd) AS mcwd, arg_min(month, (round(cwd, 9), k)) AS p, count(*) FILTER (prec - aet < 0 AND k > 0) AS l FROM cwd GROUP BY ALL),
r AS (SELECT *, p + 6 - avg(p) OVER (PARTITION BY id) AS x FROM mc)
SELECT r.id, climate_year, climate_year + CAST(p < wettest AS INT) AS mcwd_year, mcwd, p AS mcwd_month, CASE WHEN x > 12 THEN x - 12 WHEN x < 1 THEN x + 12 ELSE x END AS peak_rel, l AS cwd_length FROM r JOIN w ON w.id = r.id""")
def mcwd_annual(spark, sf):
    return C.relabelled_deficit(C.max_deficit(C.water_deficit(A.climate(spark, sf), 1995, 2001, single=True)))


_CLASSES = range(1, 51)


@query("class_histogram", "cell:l " + " ".join(f"c{c}:l" for c in _CLASSES), "land", "SELECT cell, " + ", ".join(f"count(*) FILTER (cls = {c}) AS c{c}" for c in _CLASSES) + " FROM land GROUP BY cell")
def class_histogram(spark, sf):
    return R.pivot_sum(A.land_pixels(spark, sf).withColumn("one", F.lit(1)), ["cell"], "cls", _CLASSES, "one", "c")


@query("zonal_mode", "cell:l mode:l", "land", "SELECT cell, arg_max(cls, (n, -cls)) AS mode FROM (SELECT cell, cls, count(*) AS n FROM land WHERE cls <> 0 GROUP BY ALL) GROUP BY cell")
def zonal_mode(spark, sf):
    return R.mode_by(A.land_pixels(spark, sf), ["cell"], "cls")


@query("zonal_stats", "cell:l mean:d lo:l hi:l med:d q95:d", "land", "SELECT cell, avg(v) AS mean, min(v) AS lo, max(v) AS hi, quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.95) AS q95 FROM (SELECT cell, nullif(value, 1) AS v FROM land) GROUP BY cell")
def zonal_stats(spark, sf):
    v = F.nullif(F.col("value"), F.lit(1).cast("long"))  # 1 stands for no data
    px = A.land_pixels(spark, sf).select("cell", v.alias("v"))
    plain = px.groupBy("cell").agg(F.avg("v").alias("mean"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    return plain.join(R.quantiles_by(px, ["cell"], "v", {"med": 0.5, "q95": 0.95}), "cell")


@query("weighted_zonal_mean", "cell:l weighted_mean:d", "land", "SELECT cell, sum(cls * value)::DOUBLE / sum(value) AS weighted_mean FROM land GROUP BY cell")
def weighted_zonal_mean(spark, sf):
    return R.weighted_mean(A.land_pixels(spark, sf), ["cell"], "cls", "value")


@query("lulc_rollup", "cell:l ancestor:s level:l npixels:l", "land", "SELECT cell, ancestor, level, count(*) AS npixels FROM (SELECT cell, 'c' || cls AS ancestor, 3 AS level FROM land UNION ALL SELECT cell, 'f' || cls // 5, 2 FROM land UNION ALL SELECT cell, 't' || cls // 10, 1 FROM land) GROUP BY ALL")
def lulc_rollup(spark, sf):
    codes = spark.range(1, 51).select(F.col("id").cast("int").alias("cls"))
    levels = F.array(F.struct(F.concat(F.lit("c"), "cls").alias("ancestor"), F.lit(3).alias("level")), F.struct(F.concat(F.lit("f"), F.floor(F.col("cls") / 5)).alias("ancestor"), F.lit(2).alias("level")), F.struct(F.concat(F.lit("t"), F.floor(F.col("cls") / 10)).alias("ancestor"), F.lit(1).alias("level")))
    closure = codes.select("cls", F.inline(levels))
    counts = A.land_pixels(spark, sf).groupBy("cell", "cls").agg(F.count("*").alias("npixels"))
    return R.roll_up(counts, ["cell"], "cls", "npixels", closure)


@query("lulc_groups", "cell:l anthropic:d natural:d flammable:d nonflammable:d", "land", "SELECT cell, " + ", ".join(f"100.0 * count(*) FILTER (cls IN ({', '.join(map(str, cs))})) / count(*) AS {n}" for n, cs in (("anthropic", [14]), ("natural", [1, 11, 12]), ("flammable", [1, 11, 12, 13, 14]), ("nonflammable", [22, 26, 27, 29, 32]))) + " FROM land GROUP BY cell")
def lulc_groups(spark, sf):
    part = lambda codes: 100.0 * F.count_if(F.col("cls").isin(codes)) / F.count("*")
    return A.land_pixels(spark, sf).groupBy("cell").agg(part([14]).alias("anthropic"), part([1, 11, 12]).alias("natural"), part(FLAMMABLE).alias("flammable"), part([22, 26, 27, 29, 32]).alias("nonflammable"))


@query("reclass", "grp:s n:l", "land", "SELECT CASE " + " ".join(f"WHEN cls = {c} THEN '{g}'" for c, g in GROUPS.items()) + " ELSE 'other' END AS grp, count(*) AS n FROM land GROUP BY 1")
def reclass(spark, sf):
    names = F.create_map(*[F.lit(x) for kv in GROUPS.items() for x in kv])
    return A.land_pixels(spark, sf).groupBy(F.coalesce(names[F.col("cls")], F.lit("other")).alias("grp")).agg(F.count("*").alias("n"))


#: Lists of land-cover classes that analyses take together.
CLASS_LISTS = {
    "standard_5": [3, 4, 9, 12, 15, 39, 20, 41, 36, 21],
    "standard_6": [3, 4, 11, 12, 15, 18, 21, 22],
    "main": [3, 4, 12, 18, 15, 21, 22],
    "main_cutoff": [3, 4, 12, 18, 15],
}


@query("class_lists", "cell:l list:s npixels:l", "land", "SELECT cell, list, count(*) AS npixels FROM land JOIN (" + " UNION ALL ".join(f"SELECT '{n}' AS list, unnest({cs}) AS class" for n, cs in CLASS_LISTS.items()) + ") ON cls = class GROUP BY ALL")
def class_lists(spark, sf):
    """pixels by cell and class list; cells and classes are counted before the join."""
    counts = R.count_by(A.land_pixels(spark, sf), ["cell", "cls"], "n")
    return R.by_class_list(counts, "cls", R.class_table(spark, CLASS_LISTS)).groupBy("cell", "list").agg(F.sum("n").alias("npixels"))


@query("mean_delta", "id:l period:s prec:d prec_delta:d", "climate", f"WITH y AS (SELECT id, {A.PERIOD_SQL} AS period, year, sum(prec) AS prec FROM climate GROUP BY ALL) SELECT id, period, avg(prec) AS prec, arg_max(prec, year) - arg_min(prec, year) AS prec_delta FROM y WHERE period IS NOT NULL GROUP BY ALL")
def mean_delta(spark, sf):
    yearly = A.climate(spark, sf).groupBy("id", "year").agg(F.sum("prec").alias("prec")).withColumn("period", A.period_of(F.col("year"))).where("period IS NOT NULL")
    return R.mean_and_delta(yearly, ["id", "period"], "year", "prec")


@query("median_delta", "id:l period:s aet:d aet_delta:d", "climate", f"WITH y AS (SELECT id, {A.PERIOD_SQL} AS period, year, sum(aet) AS aet FROM climate GROUP BY ALL) SELECT id, period, median(aet) AS aet, arg_max(aet, year) - arg_min(aet, year) AS aet_delta FROM y WHERE period IS NOT NULL GROUP BY ALL")
def median_delta(spark, sf):
    yearly = A.climate(spark, sf).groupBy("id", "year").agg(F.sum("aet").alias("aet")).withColumn("period", A.period_of(F.col("year"))).where("period IS NOT NULL")
    return R.mean_and_delta(yearly, ["id", "period"], "year", "aet", median=True)


@query("areal_interp", "id:l density:d", "", """
WITH f AS (SELECT c_custkey % 50 AS id, c_nationkey AS m_code, count(*)::DOUBLE AS n FROM customer GROUP BY ALL), fr AS (SELECT id, m_code, n / sum(n) OVER (PARTITION BY id) AS frac FROM f),
d AS (SELECT c_nationkey AS m_code, sum(CAST(round(c_acctbal * 100) AS BIGINT)) / 100.0 / count(*) AS density FROM customer GROUP BY 1) SELECT id, sum(frac * density) AS density FROM fr JOIN d USING (m_code) GROUP BY id""")
def areal_interp(spark, sf):
    c = A.read(spark, sf, "customer")
    parts = c.groupBy((F.col("c_custkey") % 50).alias("id"), F.col("c_nationkey").alias("m_code")).agg(F.count("*").alias("n"))
    whole = parts.groupBy("id").agg(F.sum("n").alias("all"))
    density = c.groupBy(F.col("c_nationkey").alias("m_code")).agg((F.sum(F.round(F.col("c_acctbal") * 100).cast("long")) / 100.0 / F.count("*")).alias("density"))
    return parts.join(whole, "id").join(density, "m_code").groupBy("id").agg(F.sum(F.col("n") / F.col("all") * F.col("density")).alias("density"))


@query("fraction_pivot", "id:l BUILDING:d MACHINERY:d HOUSEHOLD:d total:d", "", "SELECT c_nationkey AS id, " + ", ".join(f"count(*) FILTER (c_mktsegment = '{s}')::DOUBLE / count(*) AS {s}" for s in ("BUILDING", "MACHINERY", "HOUSEHOLD")) + ", count(*) FILTER (c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD'))::DOUBLE / count(*) AS total FROM customer GROUP BY 1")
def fraction_pivot(spark, sf):
    kinds = ["BUILDING", "MACHINERY", "HOUSEHOLD"]
    c = A.read(spark, sf, "customer").select(F.col("c_nationkey").alias("id"), "c_mktsegment")
    share = c.groupBy("id", "c_mktsegment").agg(F.count("*").alias("n"))
    whole = c.groupBy("id").agg(F.count("*").alias("all"))
    parts = share.join(whole, "id").withColumn("frac", F.col("n") / F.col("all"))
    return R.pivot_sum(parts, ["id"], "c_mktsegment", kinds, "frac").withColumn("total", F.col("BUILDING") + F.col("MACHINERY") + F.col("HOUSEHOLD"))


@query("version_lookup", "year:l vintage:l n:l", "fires", "SELECT year, CASE year " + " ".join(f"WHEN {y} THEN {v}" for y, v in VINTAGES.items()) + " END AS vintage, count(*) AS n FROM fires GROUP BY ALL")
def version_lookup(spark, sf):
    return R.version_lookup(R.count_by(A.fires(spark, sf), ["year"], "n"), VINTAGES)


@query("cumulative_snapshot", "year:l id:l n:l", "fires", "SELECT y.year, id, count(*) AS n FROM fires f JOIN (SELECT DISTINCT year FROM fires) y ON f.year <= y.year GROUP BY ALL")
def cumulative_snapshot(spark, sf):
    counts = R.count_by(A.fires(spark, sf), ["id", "year"], "c").withColumnRenamed("year", "created")
    return R.snapshot(counts, "created", A.YEARS).groupBy("year", "id").agg(F.sum("c").alias("n"))


@query("semi_anti", "kind:s n:l", "", "SELECT 'with' AS kind, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'without', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def semi_anti(spark, sf):
    c, o = A.read(spark, sf, "customer"), A.read(spark, sf, "orders")
    same = c.c_custkey == o.o_custkey
    count = lambda how, kind: c.join(o, same, how).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count("left_semi", "with").unionByName(count("left_anti", "without"))


@query("first_wins_union", "px:l source:s value:l", "land", "SELECT px, source, value FROM (SELECT px, 'a' AS source, max(value) AS value, 0 AS k FROM land WHERE cls <= 25 AND year < 1998 GROUP BY px UNION ALL SELECT px, 'b', max(value), 1 FROM land GROUP BY px) QUALIFY row_number() OVER (PARTITION BY px ORDER BY k) = 1")
def first_wins_union(spark, sf):
    land = A.land_pixels(spark, sf)
    a = land.where("cls <= 25 AND year < 1998").groupBy("px").agg(F.max("value").alias("value")).withColumn("source", F.lit("a"))
    b = land.groupBy("px").agg(F.max("value").alias("value")).withColumn("source", F.lit("b"))
    return R.first_wins([a, b], ["px"])


@query("cell_assign", "order_id:l cell:l", "", "SELECT o.o_orderkey AS order_id, coalesce(b.cell, -99) AS cell FROM orders o LEFT JOIN (SELECT l_orderkey, arg_max(cell, (n, -cell)) AS cell FROM (SELECT l_orderkey, l_suppkey % 25 AS cell, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY ALL) GROUP BY 1) b ON b.l_orderkey = o.o_orderkey")
def cell_assign(spark, sf):
    pairs = A.read(spark, sf, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("order_id"), (F.col("l_suppkey") % 25).alias("cell"))
    return R.assign_most(pairs, "order_id", "cell", A.read(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id")))


@query("singleton_flag", "o_custkey:l o_orderkey:l single:s", "", "SELECT o_custkey, o_orderkey, CASE WHEN count(*) OVER (PARTITION BY o_custkey) = 1 THEN 'true' ELSE 'false' END AS single FROM orders")
def singleton_flag(spark, sf):
    return R.singletons(A.read(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"])


@query("size_histogram", "bin:l n:l", "fires", "SELECT least(greatest(units // 5 + 1, 1), 10) AS bin, count(*) AS n FROM fires GROUP BY 1")
def size_histogram(spark, sf):
    return A.fires(spark, sf).groupBy(F.least(F.width_bucket("units", F.lit(0), F.lit(50), F.lit(10)), F.lit(10)).alias("bin")).agg(F.count("*").alias("n"))


@query("corr_matrix", "a:s b:s r:d", "climate", "WITH x AS (SELECT prec, aet, pet, month::DOUBLE AS month FROM climate) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM x" for i, a in enumerate(("prec", "aet", "pet", "month")) for b in ("prec", "aet", "pet", "month")[i:]))
def corr_matrix(spark, sf):
    names = ("prec", "aet", "pet", "month")
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    c = A.climate(spark, sf).agg(*[F.corr(a, b).alias(f"{a}_{b}") for a, b in pairs])
    return c.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}_{b}").alias("r")) for a, b in pairs])))


@query("corr_stars", "a:s b:s n:l r:d p:d stars:s")
def corr_stars(spark, sf):
    """Correlations with two-sided p values and their marks."""
    return M.correlations(A.climate(spark, sf), ["prec", "aet", "pet", "month"])


@query("transforms", "id:l log_v:d sqrt_v:d log1_v:d logrev_v:d", "climate", "WITH y AS (SELECT id, sum(prec - aet) AS v, sum(prec) AS p FROM climate GROUP BY id) SELECT id, ln(p) AS log_v, sqrt(p) AS sqrt_v, ln(1 + p) AS log1_v, ln(v + abs((SELECT min(v) FROM y)) + 1) AS logrev_v FROM y")
def transforms(spark, sf):
    y = A.climate(spark, sf).groupBy("id").agg(F.sum(F.col("prec") - F.col("aet")).alias("v"), F.sum("prec").alias("p"))
    least = y.agg(F.min("v")).first()[0] or 0.0  # one number
    return y.select("id", F.log("p").alias("log_v"), F.sqrt("p").alias("sqrt_v"), F.log1p("p").alias("log1_v"), F.log(F.col("v") + abs(least) + 1).alias("logrev_v"))
