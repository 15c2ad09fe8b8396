"""Operator 3, chat formatting: one string and its loss spans per conversation, in Spark expressions only.

Template: <|begin|>, then for each run of adjacent turns of one role <|role:NAME|>, the texts of the run with
<|sep|> between them, <|end|>. Inside texts, the start of a control string (<|, <s>, </s>, [INST], [/INST]) gets one
backslash more than it has between its first character and the rest; reading back takes one away. So marks are
never met inside a text, and any text, role (URL-encoded) and turn border can be read back from the output.

Defined results: a null text or role counts as empty; turns are ordered by (turn, role, text), nulls first, so ties
and repeated rows have one order and are all kept; a conversation with a null conv_id is formatted like others; an
empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlake.llm.common import table

BEGIN, SEP, END = "<|begin|>", "<|sep|>", "<|end|>"
CHUNK = 64
#: First character, backslashes, rest of a control string.
CONTROL = r"(<|\[)(\\*)(\||/?s>|/?INST\])"
ESCAPED = r"(<|\[)\\(\\*)(\||/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def format_conversations(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted and loss_spans (start, from 1, and length in code points of each text of loss_role)."""
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def piece(x: Column, i: Column) -> Column:
        before, after = F.get("turns", i - 1)["role"], F.get("turns", i + 1)["role"]
        opens = ~x["role"].eqNullSafe(before)
        return F.struct(
            F.when(opens, F.concat(F.lit("<|role:"), F.url_encode(x["role"]), F.lit("|>"))).otherwise(F.lit(SEP)).alias("head"),
            escape(x["text"]).alias("body"),
            F.when(x["role"].eqNullSafe(after), F.lit("")).otherwise(F.lit(END)).alias("tail"),
            (x["role"] == loss_role).alias("loss"),
        )

    pieces = grouped.select("conv_id", F.transform("turns", piece).alias("pieces"))
    # Runs of one role merge here: their pieces have no mark but SEP between them.
    text = F.concat(F.lit(BEGIN), F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], p["tail"])), ""))
    sizes = F.transform("pieces", lambda p: F.struct(F.length(p["head"]).alias("head"), F.length(p["body"]).alias("body"), F.length(p["tail"]).alias("tail"), p["loss"].alias("loss")))

    # Starts are running sums. CHUNK pieces at a time, so that no array grows by one element for each turn of a long conversation.
    total = lambda p: (p["head"] + p["body"] + p["tail"]).cast("long")
    spans_type = "array<struct<start:bigint,length:bigint>>"
    zero = F.lit(0).cast("long")
    chunked = pieces.select("conv_id", text.alias("formatted"), F.transform(F.sequence(F.lit(0), F.floor((F.size("pieces") - 1) / CHUNK).cast("int")), lambda c: F.slice(sizes, c * CHUNK + 1, CHUNK)).alias("chunks"))
    lengths = F.transform("chunks", lambda c: F.aggregate(c, zero, lambda acc, p: acc + total(p)))
    starts = F.aggregate(
        lengths,
        F.struct(F.lit(len(BEGIN) + 1).cast("long").alias("at"), F.array().cast("array<bigint>").alias("all")),
        lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["all"], acc["at"]).alias("all")),
        lambda acc: acc["all"],
    )

    def step(acc: Column, p: Column) -> Column:
        span = F.struct((acc["at"] + p["head"]).alias("start"), p["body"].cast("long").alias("length"))
        return F.struct((acc["at"] + total(p)).alias("at"), F.when(p["loss"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    def spans(chunk: Column, at: Column) -> Column:
        return F.aggregate(chunk, F.struct(at.alias("at"), F.array().cast(spans_type).alias("spans")), step, lambda acc: acc["spans"])

    return chunked.select("conv_id", "formatted", F.flatten(F.zip_with("chunks", starts, spans)).alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted string, as they were before runs were merged."""
    body = F.substring(formatted, F.lit(len(BEGIN) + 1), F.length(formatted))
    blocks = F.filter(F.split(body, r"<\|end\|>", -1), lambda b: b != "")
    head = r"^<\|role:([^|]*)\|>"

    def turns(block: Column) -> Column:
        role = F.url_decode(F.regexp_extract(block, head, 1))
        texts = F.split(F.regexp_replace(block, head, ""), r"<\|sep\|>", -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def masked(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int"), s["length"].cast("int")))), "")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    out = format_conversations(rows.unionByName(probe))
    read = out.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), masked(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", line), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP3_SQL = r"""
WITH rows0 AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, lag(role) OVER w IS DISTINCT FROM role AS opens, lead(role) OVER w IS DISTINCT FROM role AS closes,
         length(regexp_replace(text, '(<|\[)(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')) AS body
  FROM rows0 WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(9 + sum(body + CASE WHEN opens THEN 9 + length(role) ELSE 7 END + CASE WHEN closes THEN 7 ELSE 0 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
