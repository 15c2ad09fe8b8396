"""Season measures of monthly series by key. Each takes rows (keys, month, value) and gives one row for each key.

One aggregation makes the series (an array of twelve sums, combined map-side); all measures are expressions on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderlake.functions import months as M

KEYS = ["id", "period"]


def series(df: DataFrame, keys=KEYS, month: str = "month", value: str = "units") -> DataFrame:
    return df.groupBy(*keys).agg(M.month_sums(month, value).alias("m"))


def with_peak(s: DataFrame) -> DataFrame:
    return s.withColumn("peak", M.peak_month(F.col("m"))).withColumn("rel", F.when(F.col("peak").isNotNull(), M.relabelled(F.col("m"), F.col("peak"))))


def peak(df: DataFrame, keys=KEYS, value: str = "units") -> DataFrame:
    """The month of the largest sum."""
    return series(df, keys, value=value).select(*keys, M.peak_month(F.col("m")).alias("peak_month"))


def quantiles_nearest(df: DataFrame, keys=KEYS, value: str = "units") -> DataFrame:
    """Months whose cumulative share, from the relabelled start, is nearest to 5, 50 and 95 per cent."""
    s = with_peak(series(df, keys, value=value)).withColumn("cs", M.cumulative_share(F.col("rel")))
    s = s.select(*keys, "peak", *[M.nearest(F.col("cs"), q).alias(f"r{q}") for q in (5, 50, 95)])
    return s.select(*keys, *[M.original(F.col(f"r{q}"), F.col("peak")).alias(n) for q, n in ((5, "q05_month"), (50, "median_month"), (95, "q95_month"))], (F.col("r95") - F.col("r5") + 1).alias("q_length"))


def variance(df: DataFrame, keys=KEYS) -> DataFrame:
    """Weighted mean, population variance and deviation of the relabelled month."""
    s = with_peak(series(df, keys))
    place = F.sequence(F.lit(1), F.lit(12))
    total = M.total(F.col("rel"))
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    s = s.withColumn("mean", add(F.zip_with("rel", place, lambda v, r: v * r)) / total)
    var = add(F.zip_with("rel", place, lambda v, r: v * (r - F.col("mean")) * (r - F.col("mean")))) / total
    return s.select(*keys, "mean", var.alias("var_month"), F.sqrt(var).alias("std_month"))


def quantiles_smoothed(df: DataFrame, keys=KEYS) -> DataFrame:
    """Quantiles 5, 50 and 95 per cent of the relabelled month by linear inverse of its distribution."""
    s = with_peak(series(df, keys)).withColumn("ecdf", M.cumulative_share(F.col("rel"), 1.0))
    s = s.select(*keys, "peak", *[M.inverse_ecdf(F.col("ecdf"), q).alias(n) for q, n in ((0.05, "a"), (0.5, "b"), (0.95, "c"))])
    back = lambda c: M.original(F.col(c), F.col("peak"))
    return s.select(*keys, back("a").alias("q05"), back("b").alias("q50"), back("c").alias("q95"), (F.col("c") - F.col("a")).alias("q_length"))


def ranking(df: DataFrame, keys=KEYS) -> DataFrame:
    """Season length by ranked months."""
    return series(df, keys).select(*keys, F.when(M.total(F.col("m")) > 0, M.ranked_length(F.col("m"))).alias("length_ranking_80"))


def concentration(df: DataFrame, keys=KEYS) -> DataFrame:
    """Concentration index and its month."""
    return series(df, keys).select(*keys, M.concentration(F.col("m")).alias("ci"), M.concentration_peak(F.col("m")).alias("peak_ci"))


def threshold_season(df: DataFrame, keys=KEYS, percent: float = 10.0) -> DataFrame:
    """First to last month with at least percent of the sum."""
    s = series(df, keys).withColumn("t", M.total(F.col("m")))
    hit = F.filter(F.sequence(F.lit(1), F.lit(12)), lambda i: F.element_at("m", i) * 100.0 / F.col("t") >= percent)
    s = s.withColumn("hit", F.when(F.col("t") > 0, hit))
    first, last = F.array_min("hit"), F.array_max("hit")
    return s.select(*keys, first.alias("first_month"), last.alias("last_month"), (last - first + 1).alias("length"))


def threshold_season_longrun(df: DataFrame, percent: float = 10.0) -> DataFrame:
    """Per cell and year, months with at least percent of the cell's average annual sum; null if none."""
    year = series(df, ["id", "year"]).withColumn("t", M.total(F.col("m")))
    mean = year.withColumn("avg_total", F.avg("t").over(Window.partitionBy("id")))
    hit = F.filter(F.sequence(F.lit(1), F.lit(12)), lambda i: F.element_at("m", i) * 100.0 / F.col("avg_total") >= percent)
    s = mean.withColumn("hit", F.when(F.size(hit) > 0, hit))
    first, last = F.array_min("hit"), F.array_max("hit")
    return s.select("id", "year", first.alias("first_month"), last.alias("last_month"), (last - first + 1).alias("length"))


def interquantile_dates(df: DataFrame, keys=("id", "year"), percent: float = 80.0) -> DataFrame:
    """Dates whose cumulative share is nearest to the tails of the middle percent; days between, inclusive."""
    keys = list(keys)
    day = df.groupBy(*keys, "date").agg(F.sum("units").alias("v"))
    w = Window.partitionBy(*keys)
    day = day.withColumn("share", 100.0 * F.sum("v").over(w.orderBy("date")) / F.sum("v").over(w))
    tail = (100.0 - percent) / 2
    pick = lambda q: F.min(F.struct(F.abs(F.col("share") - q).alias("gap"), F.col("date").alias("date")))["date"]
    out = day.groupBy(*keys).agg(pick(tail).alias("first_date"), pick(100.0 - tail).alias("last_date"))
    return out.withColumn("days", F.date_diff("last_date", "first_date") + 1)


def quantiles_by_count(df: DataFrame, keys=KEYS) -> DataFrame:
    """Quantiles of the relabelled months of single fires, nearest rank (halves to even)."""
    counted = df.withColumn("one", F.lit(1))
    s = with_peak(series(counted, keys, value="one"))
    n = M.total(F.col("m"))
    s = s.withColumn("run", M.running(F.col("rel")))

    def at(q: float):
        rank = F.bround(F.lit(q) * (n - 1)) + 1
        return F.size(F.filter("run", lambda x: x < rank)) + 1

    s = s.select(*keys, "peak", at(0.05).alias("a"), at(0.5).alias("b"), at(0.95).alias("c"))
    back = lambda c: M.original(F.col(c), F.col("peak"))
    return s.select(*keys, back("a").alias("q05"), back("b").alias("q50"), back("c").alias("q95"), (F.col("c") - F.col("a") + 1).alias("length"))


def upsert(left: DataFrame, right: DataFrame, keys=KEYS) -> DataFrame:
    """K3: columns of both, by key; new values of columns that both have win, rows of either side stay."""
    both = [c for c in right.columns if c in left.columns and c not in keys]
    renamed = right.withColumnsRenamed({c: f"_new_{c}" for c in both})
    out = left.join(renamed, list(keys), "full")
    return out.withColumns({c: F.coalesce(f"_new_{c}", c) for c in both}).drop(*[f"_new_{c}" for c in both])


def largest_fire_month(df: DataFrame, keys=KEYS) -> DataFrame:
    """Month of the largest fire (first month on ties) and month with most fires."""
    largest = df.groupBy(*keys).agg(F.max_by("month", F.struct("units", -F.col("month"))).alias("largest_fire_month"))
    most = series(df.withColumn("one", F.lit(1)), keys, value="one").select(*keys, M.peak_month(F.col("m")).alias("most_fires_month"))
    return largest.join(most, list(keys))


def fill_gaps(peaks: DataFrame) -> DataFrame:
    """A missing yearly peak is the whole part of the mean of its neighbours; the last takes the year before."""
    w = Window.partitionBy("id").orderBy("year")
    before, after = F.lag("peak_month").over(w), F.lead("peak_month").over(w)
    filled = F.coalesce("peak_month", F.floor((before + after) / 2), before)
    return peaks.select("id", "year", filled.alias("peak_month"), F.col("peak_month").isNull().cast("int").alias("was_missing"))


def fire_year(df: DataFrame, start: DataFrame, first_year: int) -> DataFrame:
    """Year and month counted from each cell's start month; rows before the first whole shift are null."""
    at = 12 * (F.col("year") - first_year) + F.col("month") - 1 - F.col("shift")
    out = df.join(start, "id").withColumn("at", at)
    known = F.col("at") >= 0
    return out.select("id", "year", "month", F.when(known, F.floor(F.col("at") / 12) + first_year).alias("fire_year"), F.when(known, F.col("at") % 12 + 1).alias("fire_month"))


def lowest_month(df: DataFrame, value: str, keys=("id",)) -> DataFrame:
    """The month with the lowest mean over the years, first on ties."""
    mean = df.groupBy(*keys, "month").agg(F.avg(value).alias("v"))
    return mean.groupBy(*keys).agg(F.min_by("month", F.struct(F.round("v", 9), "month")).alias("lowest_month"))
