"""Operator 1, mixing sources to target weights: hierarchical budgets over a domain - language - source tree.

Budgets go down the tree. Among siblings a parent's budget is filled like water: each child gets its weight's share,
but no more than its subtree can supply (tokens times max_epochs); what it cannot supply goes to its siblings, by
weight, and only what no sibling can take is missing at the ancestor, whose own siblings then take it. Each leaf
repeats its documents for whole epochs and takes the rest as the token-prefix of one more epoch: documents in the
order of md5(seed | epoch | doc_id) while the tokens before them are fewer than the rest. That prefix is found by
two histograms over leading digits of the key and an ordered sum in the one bin that holds the border, so no task
orders a whole leaf.

Tokens are words between ASCII white space. Defined results: a null text has no tokens; null languages and sources
are the leaf ''; rows with one doc_id in one leaf are one document (all its rows are selected together); weights of
names not listed are 1 and weights below 0 count as 0. An empty table selects nothing. Extra columns are ignored by
select_mixture() and kept by mix().
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderlake.llm.common import fresh, materialise, table

LEAF = ["domain", "lang", "source"]
#: Production parameters.
WEIGHTS = {"domain": {"d0": 0.4, "d1": 0.3, "d2": 0.2, "d3": 0.1}, "lang": {"en": 0.4, "fr": 0.2, "de": 0.2, "es": 0.2}, "source": {}}
MAX_EPOCHS, SEED = 2, 17


def domain_of(source: Column) -> Column:
    """The domain of a source: its number modulo 4; sources without a number are domain 'other'."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]{1,9})$", 1)
    return F.when(number == "", "other").otherwise(F.concat(F.lit("d"), (number.cast("long") % 4).cast("string")))


def n_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def leaf_columns(docs: DataFrame) -> list[Column]:
    return [domain_of(docs["source"]).alias("domain"), F.coalesce(docs["lang"], F.lit("")).alias("lang"), F.coalesce(docs["source"], F.lit("")).alias("source")]


def _weight(level: str, weights: Mapping[str, float]) -> Column:
    out = F.lit(1.0)
    for name, w in weights.items():
        out = F.when(F.col(level) == name, F.lit(max(0.0, float(w)))).otherwise(out)
    return out


def _fill(children: DataFrame, parent: list[str]) -> DataFrame:
    """budget of each child, from its parent's budget, its own weight and cap."""
    ratio = F.coalesce(F.try_divide("cap", "weight"), F.lit(float("inf")))
    child = (set(LEAF) & set(children.columns)) - set(parent)
    by = Window.partitionBy(*parent)
    order = by.orderBy("ratio", *sorted(child))
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("parent_budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.nullif(F.sum("weight").over(rest), F.lit(0.0))
    known = children.withColumn("ratio", ratio).withColumn("level", level)
    known = known.withColumn("water", F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(by))
    budget = F.when(F.col("weight") == 0, 0.0).otherwise(F.least("cap", F.coalesce(F.col("water") * F.col("weight"), F.col("cap"))))
    return known.withColumn("budget", F.round(F.greatest(budget, F.lit(0.0)), 6)).drop("ratio", "level", "water", "parent_budget")


def budgets(supply: DataFrame, weights: Mapping[str, Mapping[str, float]], total: float | None, max_epochs: int) -> DataFrame:
    """domain, lang, source, supply, budget from the tokens of each leaf; total: tokens wanted, None for all there are."""
    leaves = supply.withColumn("cap", F.when(_weights_of_path(weights) > 0, F.col("supply") * float(max_epochs)).otherwise(0.0))
    wanted = float((supply.agg(F.sum("supply")).first()[0] or 0) if total is None else total)  # one number
    out = None
    for depth in (1, 2, 3):
        names = LEAF[:depth]
        nodes = leaves.groupBy(*names).agg(F.sum("cap").alias("cap"), F.sum("supply").alias("supply")).withColumn("weight", F.when(F.col("cap") > 0, _weight(names[-1], weights.get(names[-1], {}))).otherwise(0.0))
        if out is None:
            nodes = nodes.withColumn("parent_budget", F.lit(wanted))
        else:
            nodes = nodes.join(out.select(*names[:-1], F.col("budget").alias("parent_budget")), names[:-1])
        out = _fill(nodes, names[:-1])
    return out.select(*LEAF, "supply", "budget")


def _weights_of_path(weights: Mapping[str, Mapping[str, float]]) -> Column:
    out = F.lit(1.0)
    for level in LEAF:
        out = out * _weight(level, weights.get(level, {}))
    return out


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def select_mixture(docs: DataFrame, weights=WEIGHTS, total: float | None = None, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, epoch: a row for each time a document is used."""
    rows = docs.select("doc_id", *leaf_columns(docs), n_tokens(F.col("text")).alias("n_tokens"))
    rows = materialise(rows.groupBy("doc_id", *LEAF).agg(F.sum("n_tokens").alias("n_tokens")), "tokens")
    supply = rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("supply"))
    plan = budgets(supply, weights, total, max_epochs)
    tokens = F.floor("budget").cast("long")
    whole = F.coalesce(F.floor(F.try_divide(tokens, F.col("supply"))), F.lit(0)).cast("long")
    plan = materialise(plan.select(*LEAF, tokens.alias("leaf_tokens"), whole.alias("whole"), (tokens - whole * F.col("supply")).alias("rest")), "plan")
    planned = rows.join(plan, LEAF)
    full = planned.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)))
    part = planned.where("rest > 0").withColumn("epoch", F.col("whole")).withColumn("key", order_key(seed, F.col("epoch"), F.col("doc_id")))
    part = part.withColumn("bin1", F.substring("key", 1, 2)).withColumn("bin2", F.substring("key", 3, 2))
    # Bins before the border are taken whole; the border bin is split again, and then ordered. What is written on the way is small
    # (bins, and the rows of one bin in 256) and keeps the last plan short, which the driver has to hold with all its tasks.
    bins = part.groupBy(*LEAF, "rest", "bin1").agg(F.sum("n_tokens").alias("size"))
    bins = bins.withColumn("ahead", F.sum("size").over(Window.partitionBy(*LEAF).orderBy("bin1")) - F.col("size")).where("ahead < rest").select(*LEAF, "bin1", "ahead", (F.col("ahead") + F.col("size") <= F.col("rest")).alias("inside"))
    bins = materialise(bins, "bins")
    near = part.join(bins, [*LEAF, "bin1"])
    border = materialise(near.where("NOT inside"), "border")
    fine = border.groupBy(*LEAF, "rest", "ahead", "bin2").agg(F.sum("n_tokens").alias("size"))
    fine = fine.withColumn("ahead2", F.col("ahead") + F.sum("size").over(Window.partitionBy(*LEAF).orderBy("bin2")) - F.col("size")).where("ahead2 < rest").select(*LEAF, "bin2", "ahead2", (F.col("ahead2") + F.col("size") <= F.col("rest")).alias("inside2"))
    border = border.join(materialise(fine, "fine"), [*LEAF, "bin2"])
    ordered = border.where("NOT inside2").withColumn("before", F.col("ahead2") + F.sum("n_tokens").over(Window.partitionBy(*LEAF).orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")).where("before < rest")
    names = ["doc_id", *LEAF, "n_tokens", "epoch"]
    return full.select(names).unionByName(near.where("inside").select(names)).unionByName(border.where("inside2").select(names)).unionByName(ordered.select(names))


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of docs that the mixture uses, once for each epoch, with a column mix_epoch (_mix_epoch where docs has one)."""
    epoch = fresh(docs, "mix_epoch")
    names = [fresh(docs, n) for n in ("_mix_id", *(f"_mix_{c}" for c in LEAF))]
    chosen = select_mixture(docs, **parameters)
    chosen = chosen.select(*[F.col(c).alias(n) for c, n in zip(["doc_id", *LEAF], names, strict=True)], F.col("epoch").alias(epoch))
    same = docs["doc_id"].eqNullSafe(chosen[names[0]])
    for name, own in zip(names[1:], leaf_columns(docs), strict=True):
        same = same & (own == chosen[name])
    return docs.join(chosen, same).drop(*names)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_mixture(table(spark, sf_dir, "documents"))


def _fill_sql(level: str, names: str, parent: str, source: str, weight: str) -> str:
    join = f"JOIN {source} p USING ({parent})" if parent else f"CROSS JOIN {source} p"
    by = f"PARTITION BY {parent}" if parent else ""
    return f"""
{level}_n AS (SELECT n.*, p.budget AS parent_budget, CASE WHEN weight > 0 THEN cap / weight ELSE 'infinity'::DOUBLE END AS ratio
  FROM (SELECT {names}, sum(cap) AS cap, sum(supply) AS supply, CASE WHEN sum(cap) > 0 THEN {weight} ELSE 0.0::DOUBLE END AS weight FROM leaves GROUP BY {names}) n {join}),
{level}_l AS (SELECT *, (parent_budget - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / nullif(sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS lev
  FROM {level}_n WINDOW w AS ({by} ORDER BY ratio, {names.split(", ")[-1]})),
{level} AS (SELECT {names}, supply, round(greatest(CASE WHEN weight = 0 THEN 0.0 ELSE least(cap, coalesce(max(CASE WHEN ratio > lev THEN lev END) OVER ({by}) * weight, cap)) END, 0.0), 6) AS budget FROM {level}_l)"""


OP1_SQL = rf"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) = '' THEN 'other'
              ELSE 'd' || CAST(CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS BIGINT) % 4 AS VARCHAR) END AS domain,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents
), leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS DOUBLE) AS supply, CAST(sum(n_tokens) AS DOUBLE) * {MAX_EPOCHS} AS cap FROM docs GROUP BY ALL),
root AS (SELECT CAST(sum(supply) AS DOUBLE) AS budget FROM leaves),{_fill_sql("l1", "domain", "", "root", "CAST(CASE domain WHEN 'd0' THEN 0.4 WHEN 'd1' THEN 0.3 WHEN 'd2' THEN 0.2 WHEN 'd3' THEN 0.1 ELSE 1.0 END AS DOUBLE)")},{_fill_sql("l2", "domain, lang", "domain", "l1", "CAST(CASE lang WHEN 'en' THEN 0.4 WHEN 'fr' THEN 0.2 WHEN 'de' THEN 0.2 WHEN 'es' THEN 0.2 ELSE 1.0 END AS DOUBLE)")},{_fill_sql("l3", "domain, lang, source", "domain, lang", "l2", "1.0::DOUBLE")},
plan AS (SELECT domain, lang, source, CAST(floor(floor(budget) / nullif(supply, 0)) AS BIGINT) AS whole,
         CAST(floor(budget) AS BIGINT) - CAST(floor(floor(budget) / nullif(supply, 0)) AS BIGINT) * CAST(supply AS BIGINT) AS rest FROM l3),
planned AS (SELECT docs.*, whole, rest FROM docs JOIN plan USING (domain, lang, source)),
part AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{SEED}|' || whole || '|' || doc_id), doc_id ROWS UNBOUNDED PRECEDING) - n_tokens AS before FROM planned WHERE rest > 0)
SELECT doc_id, domain, lang, source, n_tokens, unnest(range(0, whole)) AS epoch FROM planned WHERE whole > 0
UNION ALL SELECT doc_id, domain, lang, source, n_tokens, whole AS epoch FROM part WHERE before < rest
"""
