"""Fire sizes, return intervals and pixel frequencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlake.functions.months import inverse_ecdf

QUANTILES = (0.05, 0.5, 0.95, 0.99, 1.0)


def size_quantiles(df: DataFrame, keys: Sequence[str], value: str = "area") -> DataFrame:
    """Linear quantiles."""
    q = df.groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(x) for x in QUANTILES])).alias("q"))
    return q.select(*keys, *[F.get("q", F.lit(i)).alias(f"q_{x}") for i, x in enumerate(QUANTILES)])


def power_law(df: DataFrame, keys: Sequence[str], value: str = "area", least: float = 0.03) -> DataFrame:
    """Continuous power law over values of least and over, in closed form; null where all equal least."""
    known = df.where(F.col(value) >= least)
    s = known.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.log(F.col(value) / least)).alias("s"))
    alpha = 1 + F.col("n") / F.when(F.col("s") > 0, F.col("s"))
    return s.select(*keys, alpha.alias("pwl_alpha"), ((alpha - 1) / F.sqrt("n")).alias("pwl_sigma"))


def return_interval(yearly: DataFrame, years_in_period, zero_fill: bool = False) -> DataFrame:
    """From burned and flammable area per (id, period, year); years without a row are left out, or count as 0."""
    share = F.col("area") / F.col("flammable")
    g = yearly.groupBy("id", "period").agg(F.sum("area").alias("area_T"), F.avg("flammable").alias("flammable"), (F.sum(share) if zero_fill else F.avg(share)).alias("mean"))
    n = years_in_period(F.col("period"))
    perc = F.col("mean") / n if zero_fill else F.col("mean")
    return g.select("id", "period", "area_T", "flammable", perc.alias("perc_ba"), (1 / perc).alias("fri"), (n * perc).alias("fri_freq"))


def pixel_frequency(px: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pixels of each key by the number of years they burned, without pixels that were ever not flammable."""
    each = px.groupBy(*keys, "px").agg(F.bool_and("flammable").alias("ok"), F.sum(F.col("burned").cast("long")).alias("frequency"))
    return each.where("ok").groupBy(*keys, "frequency").agg(F.count("*").alias("npixels"))


def _dense(freq: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """Shares of pixels up to each frequency from 0 to most; a frequency beyond most is an error."""
    sums = [F.coalesce(F.sum(F.when(F.col("frequency") <= k, F.col("npixels"))), F.lit(0)) for k in range(most + 1)]
    over = F.when(F.max("frequency") > most, F.raise_error(F.lit(f"a frequency is over {most}")).cast("array<bigint>"))
    g = freq.groupBy(*keys).agg(F.coalesce(over, F.array(*sums)).alias("run"))
    return g.withColumn("ecdf", F.transform("run", lambda x: x / F.element_at("run", -1)))


def frequency_nearest(freq: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """The least k from 0 to most whose ecdf is nearest to each quantile."""
    d = _dense(freq, keys, most)

    def pick(q: float):
        gaps = F.transform("ecdf", lambda x: F.abs(x - q))
        return (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int")

    return d.select(*keys, *[pick(q).alias(n) for q, n in ((0.05, "f05"), (0.5, "f50"), (0.95, "f95"), (0.99, "f99"))])


def frequency_smoothed(freq: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """Inverse linear interpolation of the ecdf; one value only gives that value."""
    d = _dense(freq, keys, most).join(freq.groupBy(*keys).agg(F.min("frequency").alias("lo"), F.max("frequency").alias("hi")), list(keys))
    pick = lambda q: F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("double")).otherwise(inverse_ecdf(F.col("ecdf"), q) - 1)
    return d.select(*keys, *[pick(q).alias(n) for q, n in ((0.05, "f05"), (0.5, "f50"), (0.95, "f95"), (0.99, "f99"))])


def frequency_summary(freq: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, 95th percentile and shares of pixels burned at least 1, 2 and 3 times, from the histogram."""
    n = F.sum("npixels")
    over = lambda k: F.coalesce(F.sum(F.when(F.col("frequency") >= k, F.col("npixels"))), F.lit(0)) / n
    return freq.groupBy(*keys).agg((F.sum(F.col("frequency") * F.col("npixels")) / n).alias("mean"), F.percentile("frequency", 0.95, F.col("npixels")).alias("q95"), over(1).alias("ge1"), over(2).alias("ge2"), over(3).alias("ge3"))
