"""Monthly climate series: rainy months, annual summaries, cumulative water deficit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlake.functions.months import wrap
from cinderlake.operators.relational import top_by


def rainy_months(df: DataFrame, n: int = 3) -> DataFrame:
    """The n months of a cell with the highest mean precipitation."""
    mean = df.groupBy("id", "month").agg(F.avg("prec").alias("mean_prec"))
    return top_by(mean, ["id"], [F.round("mean_prec", 9).desc(), F.col("month")], n)


def exclude_rainy(fires: DataFrame, rainy: DataFrame, keys=("id", "period")) -> DataFrame:
    """Counts and areas by month, 0 in the rainy months of the cell."""
    counts = fires.groupBy(*keys, "month").agg(F.count("*").alias("npolygons"), F.sum("units").alias("units"))
    marked = counts.join(rainy.select("id", "month", F.lit(True).alias("rainy")), ["id", "month"], "left")
    return marked.select(*keys, "month", *[F.when(F.col("rainy"), 0).otherwise(F.col(c)).alias(c) for c in ("npolygons", "units")])


def annual(df: DataFrame) -> DataFrame:
    """Yearly precipitation, means of the rest, and months with a deficit."""
    return df.groupBy("id", "year").agg(F.sum("prec").alias("prec"), F.avg("pet").alias("mean_pet"), F.avg("aet").alias("mean_aet"), F.count_if(F.col("prec") - F.col("pet") < 0).alias("ds_len"))


def dry_season(df: DataFrame, period: Column) -> DataFrame:
    """The same over months with a deficit, then means over the years of a period."""
    dry = F.col("prec") - F.col("pet") < 0
    yearly = df.groupBy("id", "year").agg(F.sum(F.when(dry, F.col("prec"))).alias("prec_ds"), F.avg(F.when(dry, F.col("pet"))).alias("pet_ds"))
    return yearly.withColumn("period", period).where("period IS NOT NULL").groupBy("id", "period").agg(F.avg("prec_ds").alias("mean_prec_ds"), F.avg("pet_ds").alias("mean_pet_ds"))


def wettest_month(df: DataFrame, single: bool = False) -> DataFrame:
    """The month with the highest mean precipitation, first on ties; single: that of the highest value of any one year, the earliest on ties."""
    if single:
        return df.groupBy("id").agg(F.max_by("month", F.struct(F.round("prec", 9), -F.col("year"), -F.col("month"))).alias("wettest"))
    mean = df.groupBy("id", "month").agg(F.avg("prec").alias("v"))
    return mean.groupBy("id").agg(F.max_by("month", F.struct(F.round("v", 9), -F.col("month"))).alias("wettest"))


def water_deficit(df: DataFrame, first_year: int, last_year: int, strict_last: bool = True, single: bool = False) -> DataFrame:
    """Deficit of each month of a climate year, which starts at the cell's wettest month (single: see there) with 0.

    The recurrence min(0, previous + P - |AET|) is S - max(S so far, 0 at the start) on running sums S, so it is a
    window, not a loop. Only complete climate years stay; with strict_last also not one that ends in the last month.
    """
    at = 12 * (F.col("year") - first_year) + F.col("month") - 1
    d = df.join(wettest_month(df, single), "id").withColumn("at", at - (F.col("wettest") - 1))
    d = d.where("at >= 0").withColumn("climate_year", F.floor(F.col("at") / 12) + first_year).withColumn("k", F.col("at") % 12)
    year = Window.partitionBy("id", "climate_year")
    so_far = year.orderBy("k")
    d = d.withColumn("months", F.count("*").over(year)).withColumn("last", F.max(at).over(year))
    d = d.where(f"months = 12 AND last {'<' if strict_last else '<='} {12 * (last_year - first_year + 1) - 1}")
    d = d.withColumn("step", F.when(F.col("k") == 0, 0.0).otherwise(F.col("prec") - F.abs("aet"))).withColumn("s", F.sum("step").over(so_far))
    return d.withColumn("cwd", F.col("s") - F.max("s").over(so_far)).select("id", "climate_year", "year", "month", "k", "prec", "aet", "cwd")


def max_deficit(cwd: DataFrame) -> DataFrame:
    """The lowest deficit of a climate year, its year and month (first on ties) and the months with P - AET < 0."""
    first = F.struct(F.round("cwd", 9), "k")
    return cwd.groupBy("id", "climate_year").agg(F.min("cwd").alias("mcwd"), F.min_by("year", first).alias("mcwd_year"), F.min_by("month", first).alias("mcwd_month"), F.count_if((F.col("prec") - F.col("aet") < 0) & (F.col("k") > 0)).alias("cwd_length"))


def relabelled_deficit(mcwd: DataFrame) -> DataFrame:
    """W20, yearly form: rows of max_deficit with peak_rel, the month counted so that the cell's mean peak comes to place 6."""
    mean = F.avg("mcwd_month").over(Window.partitionBy("id"))  # a cell's years
    return mcwd.withColumn("peak_rel", wrap(F.col("mcwd_month") + 6 - mean))


def max_deficit_by_period(mcwd: DataFrame, period: Column) -> DataFrame:
    """W20."""
    return mcwd.withColumn("period", period).where("period IS NOT NULL").groupBy("id", "period").agg(F.avg("mcwd").alias("mean_mcwd"), F.avg("mcwd_month").alias("mean_peak"), F.avg("cwd_length").alias("mean_length"))
