"""Readers and writers of yearly and monthly files, with Spark's own sources: globs, schemas and partition columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cinderlake.operators.relational import cell_filter, first_wins
from cinderlake.sources.adapters import period_of


def scan(spark: SparkSession, folder: str, extension: str, containing: Sequence[str] = (), recursive: bool = True) -> DataFrame:
    """Files (path, file, year, month from the name) of an extension whose name contains any of the words."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{extension}").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    out = files.withColumn("file", name).withColumn("year", year_in(F.col("file"))).withColumn("month", month_in(F.col("file")))
    for i, word in enumerate(containing):
        hit = F.contains("file", F.lit(word)) if i == 0 else hit | F.contains("file", F.lit(word))
    return out.where(hit) if containing else out


def year_in(name: Column) -> Column:
    """The four digits after an underscore, before a dash or dot."""
    found = F.regexp_extract(name, r"_(\d{4})[-.]", 1)
    return F.when(found != "", found.cast("int"))


def month_in(name: Column) -> Column:
    """The two digits after a dash, before a dot."""
    found = F.regexp_extract(name, r"-(\d{2})\.", 1)
    return F.when(found != "", found.cast("int"))


def work_order(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A CSV without header of as many string columns as named; other counts are an error, not a guess."""
    rows = spark.read.csv(path)
    if len(rows.columns) != len(columns):
        raise ValueError(f"{path} has {len(rows.columns)} columns, not {len(columns)}")
    return rows.toDF(*columns)


def read_years(spark: SparkSession, folder: str, schema: StructType | str, years: Sequence[int], columns: Sequence[str], least_area: float = 0.0, periods=None, grid: DataFrame | None = None, threshold: float = 0.0, include=(), exclude=()) -> DataFrame:
    """Rows of yearly partitions (year=YYYY) with the least area, their period, and the grid's filter.

    The year list prunes partitions; area and columns reach the scan.
    """
    rows = spark.read.schema(schema).parquet(folder).where(F.col("year").isin(list(years)) & (F.col("area") >= least_area)).select("year", *columns)
    if periods is not None:
        rows = rows.withColumn("period", period_of(F.col("year"), periods))
    return rows if grid is None else cell_filter(rows, grid, threshold, include, exclude)


def assert_same_years(a: DataFrame, b: DataFrame) -> None:
    """Both have the same years."""
    one, two = a.select("year").distinct(), b.select("year").distinct()
    if not one.exceptAll(two).unionByName(two.exceptAll(one)).isEmpty():
        raise ValueError("the inputs cover different years")


def align_months(a: DataFrame, b: DataFrame) -> DataFrame:
    """Files of a (scan()) with those of b of the same year and month; path_b is null where b has none."""
    return a.join(b.select("year", "month", F.col("path").alias("path_b")), ["year", "month"], "left")


def align_years(named: dict[str, DataFrame]) -> DataFrame:
    """Year and a path column for each named table of files; tables that do not cover the same years are an error."""
    (first, out), *rest = named.items()
    base, out = out, out.select("year", F.col("path").alias(first))
    for name, other in rest:
        assert_same_years(base, other)
        out = out.join(other.select("year", F.col("path").alias(name)), "year", "full")
    return out


def by_template(files: DataFrame, template: str) -> DataFrame:
    """Files (scan()) whose whole name follows a template such as '{year}{month}.{variable}.tif', with its fields as columns.
    year has four digits and month two; other fields are of letters, digits, '_' and '-'."""
    parts = re.split(r"\{(\w+)\}", template)
    kinds = {"year": r"(\d{4})", "month": r"(\d{2})"}
    pattern = "^" + "".join(kinds.get(x, r"([\w-]+)") if i % 2 else re.escape(x) for i, x in enumerate(parts)) + "$"
    found = {x: F.regexp_extract("file", pattern, i + 1) for i, x in enumerate(parts[1::2])}
    return files.where(F.col("file").rlike(pattern)).withColumns({x: c.cast("int") if x in kinds else c for x, c in found.items()})


def read_periods(spark: SparkSession, folder: str, schema: StructType | str, periods: Sequence[str], grid: DataFrame | None = None, threshold: float = 0.0, include=(), exclude=()) -> DataFrame:
    """Rows of period partitions (period=LABEL) of the labels wanted, with the grid's filter; other partitions are not read."""
    rows = spark.read.schema(schema).parquet(folder).where(F.col("period").isin(list(periods)))
    return rows if grid is None else cell_filter(rows, grid, threshold, include, exclude)


def explanatory(tables: Sequence[DataFrame], by_class: DataFrame, fixed: DataFrame, period: str, wanted: Sequence[str], kept_class: str = "natural", prefix: str = "cell_") -> DataFrame:
    """One row a cell: tables by (id, period), the kept class of by_class (class_val) with prefixed columns, and fixed by id, inner
    joined; the period's rows and the wanted columns only. Both are chosen before the joins, so they reach the scans."""
    own = by_class.where(F.col("class_val") == kept_class).drop("class_val")
    own = own.withColumnsRenamed({c: f"{prefix}{c}" for c in own.columns if c not in ("id", "period")})
    out = None
    for t in [*tables, own]:
        part = t.where(F.col("period") == period).select("id", *[c for c in t.columns if c in wanted])
        out = part if out is None else out.join(part, "id")
    return out.join(fixed.select("id", *[c for c in fixed.columns if c in wanted]), "id")


def write_mosaic(parts: Sequence[DataFrame], folder: str, keys: Sequence[str] = ("row", "col"), tile: int = 256) -> None:
    """K4: one raster of pixel tables, of which the first listed wins each pixel; written by bands of tile rows, which a rewrite
    replaces one by one."""
    merged = first_wins(parts, keys).withColumn("band", F.floor(F.col(keys[0]) / tile).cast("int"))
    merged.write.partitionBy("band").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(folder)


def masked(df: DataFrame, value: str, sentinel: float) -> DataFrame:
    """No-data values become null."""
    return df.withColumn(value, F.when(F.col(value) != sentinel, F.col(value)))


def in_bounds(df: DataFrame, minx: float, miny: float, maxx: float, maxy: float) -> DataFrame:
    """Features whose bounds meet a box; the comparisons are pushed to Parquet statistics."""
    return df.where((F.col("minx") <= maxx) & (F.col("maxx") >= minx) & (F.col("miny") <= maxy) & (F.col("maxy") >= miny))


def union_with_srid(parts: Sequence[DataFrame], srid: int = 4674) -> DataFrame:
    """The union by name of layers, with a default reference system."""
    out = None
    for part in parts:
        own = part if "srid" in part.columns else part.withColumn("srid", F.lit(None).cast("int"))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out.withColumn("srid", F.coalesce("srid", F.lit(srid)))


def write_years(df: DataFrame, folder: str, kind: str = "parquet", append: bool = False, by: str = "year") -> None:
    """K1, K2: one folder a year (or period); a rewrite replaces the years it holds only, so a rerun is harmless. A large
    year is split over several tasks and files."""
    writer = df.hint("rebalance", F.col(by)).write.partitionBy(by).option("header", "true").option("partitionOverwriteMode", "dynamic")
    writer.mode("append" if append else "overwrite").format(kind).save(folder)


def split_failures(df: DataFrame, ok: Column, reason: Column) -> tuple[DataFrame, DataFrame]:
    """K7: rows that pass, and a table of those that do not, with the reason; none is lost."""
    passed = F.coalesce(ok, F.lit(False))
    return df.where(passed), df.where(~passed).withColumn("reason", reason)
