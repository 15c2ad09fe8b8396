"""Operator 12, periodic run detection: a harmonic grid of periods and points, prefix hashes, binary searches in NumPy.

A run is a stretch of words that repeats with smallest period q, is at least max(LEAST, TIMES * q) long, and cannot be extended.

1. Grid. For each period q up to n / TIMES the points 0, s, 2s, ... with s = (TIMES - 1) q: a run holds TIMES q words at least, so
   some point j has j and j + q inside it. That is a harmonic sum of pairs (q, j), n ln n / (TIMES - 1) of them. The documents
   of a batch lie in one array, with a word of its own after each, so all their pairs are worked on together.
2. Extension. Pairs whose words at j and j + q differ go. For all others the longest common extensions to both sides are found
   at once, by binary searches over prefix hashes (a polynomial modulo the prime 2^31 - 1 with a base drawn at random).
3. Repeats. One stretch is found with its period and with multiples of it, from many points: the least period stays.
4. Words. Each stretch is compared word by word at its period, and periods found with it must be multiples. Equal words have
   equal hashes, so a stretch that holds is maximal too; should one not hold, the batch is worked again with another base.

Texts longer than PIECE words are worked on alone, pairs in chunks of CHUNK, so memory is bounded by the longest text.

Defined results: null, empty and blank texts have no words and no runs; their collapsed text is ''. Repeated rows come out
each. An empty table gives no rows. Extra columns are ignored. A null id counts as '' where the query plants periods.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlake.llm.common import WHITE, table

LEAST, TIMES = 6, 4
PRIME = np.uint64((1 << 31) - 1)
PIECE, CHUNK = 200_000, 1 << 20


class Prefix:
    """Prefix hashes of an array of word numbers."""

    def __init__(self, words: np.ndarray, draw: np.random.Generator):
        n = len(words)
        value = draw.integers(1, int(PRIME), int(words.max()) + 1, np.uint64)[words]
        self.power = np.ones(n + 1, np.uint64)
        base, have = np.uint64(draw.integers(1 << 20, int(PRIME) - 1)), 1
        while have <= n:  # twice as many powers each time
            step = self.power[have - 1] * base % PRIME
            more = min(have, n + 1 - have)
            self.power[have : have + more] = self.power[:more] * step % PRIME
            have += more
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(value * self.power[:n] % PRIME, out=self.sums[1:])
        self.sums %= PRIME

    def equal(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the hashes of size words from i and from j (i <= j) are equal."""
        a = (self.sums[i + size] + PRIME - self.sums[i]) * self.power[j - i] % PRIME
        return a == (self.sums[j + size] + PRIME - self.sums[j]) % PRIME

    def extension(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """Longest size up to most with equal hashes; back: of the words before i and j."""
        low, high = np.zeros(len(i), np.int64), most + 1  # equal at low, not equal at high
        while (open_ := high - low > 1).any():
            mid = (low + high) // 2
            ok = self.equal(i - mid, j - mid, mid) if back else self.equal(i, j, mid)
            low, high = np.where(open_ & ok, mid, low), np.where(open_ & ~ok, mid, high)
        return low


def ragged(sizes: np.ndarray) -> np.ndarray:
    """0 .. size - 1 for each size, one after the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def grid(starts: np.ndarray, sizes: np.ndarray, times: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Document, period and point (from the document's start) of all pairs, some CHUNK at a time."""
    periods = sizes // times
    doc, q = np.repeat(np.arange(len(sizes)), periods), ragged(periods) + 1
    points = -(-(sizes[doc] - q) // ((times - 1) * q))
    upto = np.cumsum(points)
    cuts = np.searchsorted(upto, np.arange(CHUNK, upto[-1] + CHUNK, CHUNK)) + 1 if len(upto) else []
    for a, z in zip([0, *cuts], [*cuts, len(doc)], strict=True):
        z = min(int(z), len(doc))
        if a < z:
            n = points[a:z]
            period = np.repeat(q[a:z], n)
            yield np.repeat(doc[a:z], n), period, ragged(n) * (times - 1) * period


def candidates(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: int, times: int, prefix: Prefix) -> np.ndarray:
    """Rows of first word, end, period (positions in words), distinct."""
    kept = [np.zeros((0, 3), np.int64)]
    for doc, q, point in grid(starts, sizes, times):
        i = starts[doc] + point
        same = words[i] == words[i + q]
        doc, q, i = doc[same], q[same], i[same]
        ahead = prefix.extension(i, i + q, starts[doc] + sizes[doc] - i - q, False)
        behind = prefix.extension(i, i + q, i - starts[doc], True)
        first, end = i - behind, i + q + ahead
        long = end - first >= np.maximum(least, times * q)
        found = np.stack([first, end, q], 1)[long]
        if len(found):  # of a stretch found with multiples of its period: the least, and one that is no multiple if there is any
            found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
            new = np.ones(len(found), bool)
            new[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
            smallest = found[new, 2][np.cumsum(new) - 1]
            kept.append(found[new | (found[:, 2] % smallest != 0)])
    return np.unique(np.concatenate(kept), axis=0)


def verified(words: np.ndarray, found: np.ndarray) -> np.ndarray | None:
    """Stretches with their least period, or None where one does not hold word by word."""
    if not len(found):
        return found
    new = np.ones(len(found), bool)  # found is in order of first, end, period
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
    smallest = found[new, 2][np.cumsum(new) - 1]
    if (found[:, 2] % smallest).any():
        return None
    out = found[new]
    for a in range(0, len(out), 1000):
        first, end, q = out[a : a + 1000].T
        at = np.repeat(first, end - q - first) + ragged(end - q - first)
        if (words[at] != words[at + np.repeat(q, end - q - first)]).any():
            return None
    return out


def runs_of(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: int = LEAST, times: int = TIMES, seed: int = 0) -> np.ndarray:
    """First word, end and period of all runs in all documents, ordered; words holds each document and a word of its own after it."""
    draw = np.random.default_rng(seed)
    while len(words):
        out = verified(words, candidates(words, starts, sizes, least, times, Prefix(words, draw)))
        if out is not None:
            return out[np.lexsort((out[:, 2], out[:, 0]))]
    return np.zeros((0, 3), np.int64)


def _worked(texts: list[list[bytes]], least: int, times: int) -> Iterator[tuple[np.ndarray, bytes]]:
    """Runs (start, length, period) and collapsed text of each list of words."""
    numbers: dict[bytes, int] = {}
    flat = [numbers.setdefault(w, len(numbers)) for ws in texts for w in ws]
    sizes = np.array([len(ws) for ws in texts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    words = np.full(int(sizes.sum()) + len(sizes), -1, np.int64)
    words[np.repeat(starts, sizes) + ragged(sizes)] = flat
    words[starts + sizes] = len(numbers) + np.arange(len(sizes))
    found = runs_of(words, starts, sizes, least, times)
    drops = np.zeros(len(words) + 1, np.int64)
    np.add.at(drops, found[:, 0] + found[:, 2], 1)
    np.add.at(drops, found[:, 1], -1)
    kept = np.cumsum(drops)[:-1] == 0
    cuts = np.searchsorted(found[:, 0], np.append(starts, len(words) + 1))
    for k, ws in enumerate(texts):
        mine = found[cuts[k] : cuts[k + 1]]
        if not len(mine):
            yield mine, b" ".join(ws)
            continue
        keep = kept[starts[k] : starts[k] + sizes[k]]
        yield np.stack([mine[:, 0] - starts[k], mine[:, 1] - mine[:, 0], mine[:, 2]], 1), b" ".join([ws[i] for i in np.flatnonzero(keep).tolist()])


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs (structs start, length, period, by start and period) and collapsed, the words that stay, joined by
    spaces: of each run the first period stays. times: repeats asked for, 3 or more."""
    if times < 3 or least < 1:
        raise ValueError("times must be at least 3, least at least 1")
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def pieces(texts: list[bytes | None]) -> Iterator[list[list[bytes]]]:
        piece, held = [], 0
        for t in texts:
            ws = (t or b"").split()
            if piece and held + len(ws) > PIECE:
                yield piece
                piece, held = [], 0
            piece.append(ws)
            held += len(ws)
        if piece:
            yield piece

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part, done = batch.slice(at, 1000), 0
                for texts in pieces(part.column(1).cast(pa.binary()).to_pylist()):
                    out = list(_worked(texts, least, times))
                    flat = np.concatenate([r for r, _ in out])
                    offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) for r, _ in out])]), pa.int32())
                    runs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(kind)))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).slice(done, len(out)), pa.array([len(ws) for ws in texts], pa.int64()), runs, pa.array([x for _, x in out], pa.binary()).cast(pa.string())],
                        names=["doc_id", "n_words", "runs", "collapsed"],
                    )
                    done += len(out)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where rows whose crc32 of the id is divisible by 10 get a periodic end: word i >= a is word a + (i - a) % p."""
    words: Column = F.filter(F.split(F.coalesce("text", F.lit("")), WHITE), lambda w: w != "")
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), F.floor(h / 10).alias("g"))
    n = F.size("w").cast("long")
    a = F.col("g") % n
    p = 1 + F.floor((n - a) / (3 + F.col("g") % 8))
    rows = rows.select("doc_id", "text", "w", n.alias("n"), F.when(n > 0, a).alias("a"), F.when(n > 0, p).alias("p"))
    at = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")))
    whole = F.array_join(F.transform(at, lambda i: F.get("w", i.cast("int"))), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, whole).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(table(spark, sf_dir, "documents")))
    by_length = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    digest = F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256)
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), by_length.alias("best"), digest.alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(F.lit(1000) * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


#: Pairs of equal words q apart, in islands without a gap; the least q of each stretch. crc32 is worked out bit by bit.
OP12_SQL = r"""
WITH h AS (
  SELECT doc_id, text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: ascii(c)::BIGINT)),
    lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x // 2, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295::BIGINT) AS h
  FROM documents
), o AS (SELECT doc_id, h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM h),
g AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS periodic, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a, (h // 10) % 8 AS e FROM o),
p AS (SELECT *, 1 + (n - a) // (3 + e) AS p FROM g),
words AS (
  SELECT doc_id, n, i, CASE WHEN periodic AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS w
  FROM (SELECT *, unnest(range(n)) AS i FROM p)
), pairs AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs),
stretches AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS size FROM islands GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT doc_id, s, size, min(q) AS q FROM stretches GROUP BY doc_id, s, size),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, s, q) AS place FROM runs),
digests AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || size || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
    max(s) FILTER (place = 1) AS "start", max(size) FILTER (place = 1) AS length, max(q) FILTER (place = 1) AS period
  FROM ranked GROUP BY doc_id
), gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + size)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT o.doc_id, coalesce(n_runs, 0) AS n_runs, "start", length, period, 1000 * length // period AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM o LEFT JOIN digests USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
