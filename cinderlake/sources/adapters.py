"""Canonical tables from the driver's star schema (fires from line items, climate from orders, ...), with SQL twins.

Areas are carried as whole units of 0.01 km2, so sums are exact and ties are decided alike everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PERIODS = ((1995, 1996), (1997, 1998), (1999, 2000))
UNIT_KM2 = 0.01
MIN_UNITS = 3  # 0.03 km2
YEARS = tuple(range(1995, 2002))


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def period_of(year: Column, periods=PERIODS) -> Column:
    """Label of the closed interval that holds year; null outside all."""
    out = F.lit(None).cast("string")
    for lo, hi in periods:
        out = F.when(year.between(lo, hi), f"{lo}-{hi}").otherwise(out)
    return out


def fires(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "lineitem")
    return d.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("fire_id"), F.col("l_suppkey").alias("id"), F.year("l_shipdate").alias("year"),
        F.month("l_shipdate").alias("month"), F.to_date("l_shipdate").alias("date"), F.col("l_quantity").cast("long").alias("units"), F.col("l_partkey").alias("px"),
    )


def period_fires(spark: SparkSession, sf: str) -> DataFrame:
    """Fires of the least size and over, with their period; those outside all periods are gone."""
    f = fires(spark, sf).where(F.col("units") >= MIN_UNITS)
    return f.withColumn("period", period_of(F.col("year"))).where("period IS NOT NULL")


def grid(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "supplier")
    lo, hi = d.agg(F.min("s_acctbal"), F.max("s_acctbal")).first()  # two numbers
    k = F.col("s_suppkey")
    return d.select(k.alias("id"), F.floor((k - 1) / 10).alias("row"), ((k - 1) % 10).alias("col"), (100 * (F.col("s_acctbal") - F.lit(lo)) / F.lit(hi - lo)).alias("pct_area"))


def climate(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly series by cell; amounts in whole cents, divided once."""
    d = read(spark, sf, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    g = d.groupBy((F.col("o_custkey") % 50).alias("id"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    return g.agg((F.sum(cents) / 1e5).alias("prec"), (F.coalesce(F.sum(F.when(F.col("o_orderstatus") == "F", cents)), F.lit(0)) / 5e4).alias("aet"), (F.coalesce(F.sum(F.when(F.col("o_orderpriority") < "3", cents)), F.lit(0)) / 3e4).alias("pet"))


def land_pixels(spark: SparkSession, sf: str) -> DataFrame:
    d, p = read(spark, sf, "lineitem"), read(spark, sf, "part")
    joined = d.join(p, d.l_partkey == p.p_partkey)
    return joined.select(F.col("l_suppkey").alias("cell"), F.col("l_partkey").alias("px"), F.year("l_shipdate").alias("year"), F.col("p_size").alias("cls"), F.col("l_quantity").cast("long").alias("value"))


PERIOD_SQL = "CASE " + " ".join(f"WHEN year BETWEEN {a} AND {b} THEN '{a}-{b}'" for a, b in PERIODS) + " END"
#: Common table expressions of the twins, by name; each may use those before it.
CTES = {
    "fires": "SELECT l_orderkey || '-' || l_linenumber AS fire_id, l_suppkey AS id, year(l_shipdate) AS year, month(l_shipdate) AS month, CAST(l_shipdate AS DATE) AS date, CAST(l_quantity AS BIGINT) AS units, l_partkey AS px FROM lineitem",
    "pf": f"SELECT * FROM (SELECT *, {PERIOD_SQL} AS period FROM fires WHERE units >= {MIN_UNITS}) WHERE period IS NOT NULL",
    "months": "SELECT unnest(range(1, 13)) AS month",
    "cm": "SELECT id, period, month, CAST(sum(units) AS BIGINT) AS v, count(*) AS n FROM pf GROUP BY ALL",
    "dense": "SELECT k.id, k.period, months.month, coalesce(cm.v, 0) AS v, coalesce(cm.n, 0) AS n FROM (SELECT DISTINCT id, period FROM cm) k CROSS JOIN months LEFT JOIN cm ON cm.id = k.id AND cm.period = k.period AND cm.month = months.month",
    "pk": "SELECT id, period, month AS peak FROM dense QUALIFY row_number() OVER (PARTITION BY id, period ORDER BY v DESC, month) = 1",
    "rl": "SELECT id, period, peak, v, month, CASE WHEN month + 6 - peak > 12 THEN month - 6 - peak WHEN month + 6 - peak < 1 THEN month + 18 - peak ELSE month + 6 - peak END AS r FROM dense JOIN pk USING (id, period)",
    "cs": "SELECT *, sum(v) OVER (PARTITION BY id, period ORDER BY r)::DOUBLE AS run, sum(v) OVER (PARTITION BY id, period)::DOUBLE AS total FROM rl",
    "grid": "SELECT s_suppkey AS id, CAST(floor((s_suppkey - 1) / 10.0) AS BIGINT) AS row, (s_suppkey - 1) % 10 AS col, 100 * (s_acctbal - (SELECT min(s_acctbal) FROM supplier)) / (SELECT max(s_acctbal) - min(s_acctbal) FROM supplier) AS pct_area FROM supplier",
    "cents": "SELECT o_custkey % 50 AS id, year(o_orderdate) AS year, month(o_orderdate) AS month, CAST(round(o_totalprice * 100) AS BIGINT) AS c, o_orderstatus AS s, o_orderpriority AS p FROM orders",
    "climate": "SELECT id, year, month, sum(c) / 1e5 AS prec, coalesce(sum(c) FILTER (s = 'F'), 0) / 5e4 AS aet, coalesce(sum(c) FILTER (p < '3'), 0) / 3e4 AS pet FROM cents GROUP BY ALL",
    "land": "SELECT l_suppkey AS cell, l_partkey AS px, year(l_shipdate) AS year, p_size AS cls, CAST(l_quantity AS BIGINT) AS value FROM lineitem JOIN part ON l_partkey = p_partkey",
}
NEEDS = {"pf": ["fires"], "cm": ["pf"], "dense": ["cm", "months"], "pk": ["dense"], "rl": ["dense", "pk"], "cs": ["rl"], "climate": ["cents"]}


def with_tables(body: str, *names: str) -> str:
    """body behind the common table expressions it names."""
    done: list[str] = []

    def add(name: str) -> None:
        for x in NEEDS.get(name, []):
            add(x)
        if name not in done:
            done.append(name)

    for name in names:
        add(name)
    own = body.strip()
    head = ", ".join(f"{n} AS ({CTES[n]})" for n in done)
    for start in ("WITH RECURSIVE ", "WITH "):
        if own.startswith(start):
            return f"{start}{head}, {own[len(start):]}"
    return f"WITH {head} {own}"
