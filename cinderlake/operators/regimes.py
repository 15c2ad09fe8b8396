"""The full input of the regime classification: all variables for each cell and period, gaps filled in order of dependence."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlake.functions.storage import materialise
from cinderlake.operators.graph import fill_rounds

VARIABLES = ("number_fires", "burned_area", "size_q50", "size_q99", "frequency_q99s", "flammable", "fri", "fri_freq", "season_q50s")


def circular_mean(value: str, circle: float = 12.0) -> Column:
    """Direction, in (0, circle], of the mean unit vector of an aggregate's values; null where they cancel out."""
    turn = 2 * math.pi / circle
    s, c = F.avg(F.sin(F.col(value) * turn)), F.avg(F.cos(F.col(value) * turn))
    angle = F.atan2(s, c) / turn
    return F.when(F.hypot(s, c) > 1e-9, F.when(angle > 0, angle).otherwise(angle + circle))


def circular_fill(values: DataFrame, edges: DataFrame, value: str, circle: float = 12.0) -> DataFrame:
    """G15 on a circle: missing values become the direction of their neighbours' mean unit vector, in rounds over the values
    before the round, until none changes. Neighbours that cancel out give none. Results lie in (0, circle]."""
    return fill_rounds(values, edges, [value], lambda c: circular_mean(c, circle))


def regime_table(variables: DataFrame, cells: DataFrame, edges: DataFrame, periods: Sequence[str], least: float = 0.03) -> DataFrame:
    """M1: id, period, VARIABLES, imputed, burned_area_n and number_fires_n of every cell in every period.

    variables (id, period, VARIABLES) holds what is known; cells (id); edges (src, dst) of neighbours. Cells without a row get
    one fire of the least size and frequency 0; their fuel and return interval come from neighbours, in rounds. So does, on the
    circle of months, the season of cells with one fire, which means nothing; all are filled in the same rounds. What is
    divided by fuel comes last.
    """
    every = F.explode(F.array(*[F.lit(p) for p in periods])).alias("period")
    keys = ["id", "period"]
    base = cells.select("id", every).join(variables.select(*keys, *VARIABLES), keys, "left")
    known = materialise(base.withColumn("imputed", F.col("number_fires").isNull().cast("int")), "regimes")
    filled_near = ("flammable", "fri", "fri_freq", "season_q50s")
    some = known.withColumn("season_q50s", F.when(F.col("number_fires") > 1, F.col("season_q50s")))
    near = fill_rounds(some, materialise(edges.select("src", "dst"), "regime-edges"), filled_near, lambda c: circular_mean(c) if c == "season_q50s" else F.avg(c), ["period"])
    out = known.drop(*filled_near).join(near, keys)
    filled = {"number_fires": 1, "burned_area": least, "size_q50": least, "size_q99": least, "frequency_q99s": 0.0}
    out = out.withColumns({c: F.coalesce(c, F.lit(x)) for c, x in filled.items()})
    shares = {f"{c}_n": F.try_divide(F.col(c), F.nullif("flammable", F.lit(0.0))) for c in ("burned_area", "number_fires")}
    return out.withColumns(shares).select(*keys, *VARIABLES, "imputed", *shares)
