"""Operator 10, benchmark decontamination: sparse suffix arrays over shards of the training texts.

Each shard (a bounded number of words of one input split) keeps the runs of words that all occur in the benchmark;
any passage shared with it lies inside such a run. Over those runs a suffix array is made by prefix doubling, and
every test suffix (from each word of each item that starts a window) is binary-searched in it. The range found gives
all verbatim occurrences and their locations; forward comparison from there gives the longest match.

The benchmark is broadcast in blocks of at most BLOCK_WORDS words (and the words of one item more). A benchmark of one block
takes one pass without a shuffle. Beyond that, blocks are searched one after another, each in its own pass, so that driver and
executors hold one block at a time; what they find is joined by row.

Defined results: null or wordless texts have no words, no hits and the digest of an empty list. Null items, and items
without words, match nothing; items with the same id count once in n_items. Repeated rows each get their own result.
An empty benchmark hits nothing. Extra columns are ignored; clean_documents() keeps them, and keeps or drops each row
by its own text, so rows that share an id or have none do not touch each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlake.llm.common import materialise, table

WINDOW = 10
SHARD_WORDS = 1 << 20
BLOCK_WORDS = 1 << 21
#: Bytes of words (digits, letters, all from 0x80) in lower case, all others to a space.
_WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


class TestBlock:
    """Word ids of some benchmark items, and the suffixes of theirs that start a window."""

    __test__ = False

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.items = [i for i, _ in items]
        self.vocab: dict[bytes, int] = {}
        ids, owner, left = [], [], []
        for k, (_, words) in enumerate(items):
            n = len(words)
            ids += [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words] + [0]
            owner += [k] * (n + 1)
            left += range(n, -1, -1)
        self.ids, self.owner, self.left = np.array(ids, np.int32), np.array(owner, np.int32), np.array(left, np.int32)
        length = np.bincount(self.owner, self.left > 0).astype(np.int32) if len(ids) else np.zeros(0, np.int32)
        need = np.minimum(length, window)[self.owner] if len(ids) else self.left
        self.starts = np.flatnonzero((self.left >= need) & (self.left > 0))
        self.need = need[self.starts]
        self.shortest = int(self.need.min()) if len(self.need) else 0


def blocks_of(rows: Iterator, window: int) -> Iterator[TestBlock]:
    items, size = [], 0
    for item_id, text in rows:
        if words := words_of(text):
            items.append(("" if item_id is None else str(item_id), words))
            size += len(words)
        if size >= BLOCK_WORDS:
            yield TestBlock(items, window)
            items, size = [], 0
    if items:
        yield TestBlock(items, window)


def suffix_array(ids: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ids, by prefix doubling."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    k = 1
    while n and k < n and rank.max() < n - 1:
        behind = np.zeros(n, np.int64)
        behind[:-k] = rank[k:] + 1
        rank = np.unique(rank * (n + 1) + behind, return_inverse=True)[1].astype(np.int64)
        k *= 2
    return np.argsort(rank, kind="stable")


def search(ids: np.ndarray, order: np.ndarray, test: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each test suffix, the range in order of the suffixes that begin with its first size words."""
    at = np.arange(size)
    text = np.concatenate([ids, np.zeros(size, ids.dtype)])
    want = test[starts[:, None] + at]

    def bound(right: bool) -> np.ndarray:
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), len(order), np.int64)
        while (lo < hi).any():
            open_ = lo < hi
            mid = (lo + hi) >> 1
            have = text[order[np.minimum(mid, len(order) - 1)][:, None] + at]
            differs = have != want
            first = differs.argmax(1)
            row = np.arange(len(starts))
            less = np.where(differs.any(1), have[row, first] < want[row, first], right)
            lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        return lo

    return bound(False), bound(True)


def shard_matches(docs: list[list[bytes]], block: TestBlock) -> tuple[list[np.ndarray], list[dict[int, tuple[int, int]]]]:
    """For each document: words that lie inside an occurrence of a window, and by item the place and length of its longest match.

    A window's occurrences are one range of the suffix array. Where the test suffix one word on matches one word on, the
    match is one longer than that one, so suffixes are gone through from the last to the first and each is extended at once.
    """
    hits, found = [np.zeros(0, np.int64)] * len(docs), [{} for _ in docs]
    get = block.vocab.get
    parts, home, offset = [], [], []
    for d, words in enumerate(docs if len(block.starts) else []):
        own = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (own > 0).astype(np.int8), [0]])))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            if b - a >= block.shortest:
                parts += [own[a:b], np.zeros(1, np.int32)]
                home.append(np.full(b - a + 1, d, np.int64))
                offset.append(np.arange(a, b + 1))
    if not parts:
        return hits, found
    ids, home, offset = np.concatenate(parts), np.concatenate(home), np.concatenate(offset)
    order = suffix_array(ids)
    cover = np.zeros(len(ids) + 1, np.int64)
    for size in np.unique(block.need).tolist():
        starts = block.starts[block.need == size]
        lo, hi = search(ids, order, block.ids, starts, size)
        length, from_ = np.zeros(len(ids) + 1, np.int64), np.full(len(ids) + 1, -1, np.int64)
        for k in np.flatnonzero(hi > lo)[::-1]:
            s, at = int(starts[k]), np.sort(order[lo[k] : hi[k]])
            longest = np.where((from_[at + 1] == s + 1) & (block.owner[s] == block.owner[s + 1]), length[at + 1] + 1, size)
            length[at], from_[at] = longest, s
            cover[at] += 1
            cover[at + size] -= 1
            first = np.flatnonzero(np.concatenate([[True], home[at[1:]] != home[at[:-1]]]))
            most = np.maximum.reduceat(longest, first)
            item = int(block.owner[s])
            for d, n, a, z in zip(home[at[first]].tolist(), most.tolist(), first.tolist(), [*first[1:].tolist(), len(at)], strict=True):
                if n >= found[d].get(item, (0, 0))[1]:
                    found[d][item] = (int(offset[at[a + int(longest[a:z].argmax())]]), n)
    inside = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
    cut = np.flatnonzero(np.diff(home[inside])) + 1
    for own in np.split(inside, cut) if len(inside) else []:
        hits[home[own[0]]] = offset[own]
    return hits, found


MATCHES = "array<struct<item_id:string,first_word:bigint,n_words:bigint>>"
PART = f"n_words bigint, hits array<bigint>, matches {MATCHES}"


def _searched(batches: Iterator[pa.RecordBatch], text_at: int, block: TestBlock | None, result) -> Iterator[pa.RecordBatch]:
    """result(rows, words, hits, found) of each shard of the batches' rows."""
    rows, held, size = [], [], 0

    def shard() -> pa.RecordBatch:
        hits, found = shard_matches(held, block) if block else ([np.zeros(0, np.int64)] * len(held), [{} for _ in held])
        return result(pa.Table.from_batches(rows).combine_chunks().to_batches()[0], held, hits, found)

    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            part = batch.slice(i, 500)
            rows.append(part)
            for text in part.column(text_at):
                held.append(words_of(text.as_py()))
                size += len(held[-1])
            if size >= SHARD_WORDS or len(held) >= 50_000:
                yield shard()
                rows, held, size = [], [], 0
    if held:
        yield shard()


def _search_block(docs: DataFrame, block: TestBlock | None, keys: str) -> DataFrame:
    """The columns keys of docs (all but the last, text), with n_words, hits and matches."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    at = len(docs.columns) - 1

    def result(rows: pa.RecordBatch, words: list, hits: list, found: list) -> pa.RecordBatch:
        items = shared.value.items if shared.value else []
        merged: list[dict] = []
        for own in found:  # items of one id count once
            best: dict = {}
            for k, m in own.items():
                if m[1] > best.get(items[k], (0, 0))[1]:
                    best[items[k]] = m
            merged.append(best)
        matches = [[{"item_id": i, "first_word": m[i][0], "n_words": m[i][1]} for i in sorted(m)] for m in merged]
        return pa.RecordBatch.from_arrays(
            [
                *rows.columns[:at],
                pa.array([len(w) for w in words], pa.int64()),
                pa.array([h.tolist() for h in hits], pa.list_(pa.int64())),
                pa.array(matches, pa.list_(pa.struct([("item_id", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())]))),
            ],
            names=[*rows.schema.names[:at], "n_words", "hits", "matches"],
        )

    return docs.mapInArrow(lambda batches: _searched(batches, at, shared.value, result), f"{keys}, {PART}")


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """For each row of docs: its words, words inside benchmark windows, sorted item ids, longest matches found."""
    blocks = blocks_of(benchmark.select("item_id", "text").toLocalIterator(), window)
    first, second = next(blocks, None), next(blocks, None)
    if second is None:
        whole = _search_block(docs.select(F.col("doc_id").cast("long"), "text"), first, "doc_id bigint")
    else:  # block by block: each is searched, written and let go before the next
        rows = materialise(docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), "text"), "rows")
        parts = [materialise(_search_block(rows, b, "doc_id bigint, row bigint").where("size(hits) > 0"), "block") for b in chain((first, second), blocks)]
        hit = reduce(DataFrame.unionByName, parts).groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"), F.flatten(F.collect_list("matches")).alias("all"))
        of = lambda i: F.array_max(F.transform(F.filter("all", lambda m: m["item_id"] == i), lambda m: F.struct(m["n_words"], m["first_word"])))
        best = F.transform(F.array_sort(F.array_distinct(F.transform("all", lambda m: m["item_id"]))), lambda i: F.struct(i.alias("item_id"), of(i)["first_word"].alias("first_word"), of(i)["n_words"].alias("n_words")))
        counted = _search_block(rows, None, "doc_id bigint, row bigint").select("doc_id", "row", "n_words")
        none = F.array().cast(MATCHES)
        whole = counted.join(hit.select("row", "hits", best.alias("matches")), "row", "left").select("doc_id", "n_words", F.coalesce("hits", F.array().cast("array<bigint>")).alias("hits"), F.coalesce("matches", none).alias("matches"))
    return whole.select("doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.transform("matches", lambda m: m["item_id"]).alias("items"), "matches")


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs that hold no benchmark window, with all columns. Every row is judged by its own text, whatever its id,
    in the task that reads it; each block of the benchmark is one such pass."""
    at = docs.columns.index("text")
    out = docs

    def result(rows: pa.RecordBatch, words: list, hits: list, found: list) -> pa.RecordBatch:
        return rows.filter(pa.array([not len(h) for h in hits], pa.bool_()))

    blocks = blocks_of(benchmark.select("item_id", "text").toLocalIterator(), window)
    for k, block in enumerate(blocks):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        out = materialise(out, "clean") if k else out
        out = out.mapInArrow(lambda batches, shared=shared: _searched(batches, at, shared.value, result), docs.schema)
    return out


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - least(len(w), 10) + 2, 1))) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)
), m AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw USING (k, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
