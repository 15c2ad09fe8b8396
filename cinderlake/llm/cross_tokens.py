"""Operator 11, cross-tokenizer alignment: distinct segments are tokenised and aligned once, documents composed from them.

A is a byte-level BPE (a tokenizers file), B a sentencepiece model; a text is read as space + text by A and as text by B, which
adds the space. Byte offsets where tokens of both end cut a document into groups; tokens whose bytes overlap are linked.

1. Segments. space + text is cut before each white-space run that starts with a space, after any character behind which neither
   vocabulary has a token that goes on with a space (read off both vocabularies; no merge can reach across such a place, and A's
   pre-tokenisation has a border there); white space at the end stays. Each segment starts with a space, so B gets it without one.
2. Frequent segments. Segments are counted over all documents (those seen once in a task's window are left out; what is frequent
   only decides the way, not the result). The most frequent (HOT bytes at most, by a histogram of counts) are aligned in one job
   and sent to all tasks. All other segments, of every row, are dealt out by the segment itself: rows of one
   segment lie together, so each is aligned once, and its alignment goes back to the texts that hold it.
3. Composition. A text is put together from its segments' alignments, in order: counts, groups, and which segments and links.
4. Counts of id pairs are documents that hold them linked, summed in tasks and then by Spark; the highest of each A id follows.
   The most frequent pairs (PAIRS at most) are sent to all tasks; documents that hold others get those counts by a join.

Texts are told apart by two 64-bit hashes, so repeated texts share what is joined back. Vocabulary files are read on the driver
and sent once; the paths are parameters.

Defined results: null and empty texts, and texts whose tokens' joined bytes differ from space + text (U+2581 in a text, say), have
no tokens: zeros, and '' as groups. Repeated rows come out and are counted each. Ids are carried only. An empty table gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlake.functions.storage import discard, materialise
from cinderlake.llm.common import table

TOKENIZER_A = "/opt/tokenizers/byte_bpe_50k.json"
TOKENIZER_B = "/opt/tokenizers/piece_bpe_32k.model"
HOT, PAIRS = 12 << 20, 1 << 20
LONGEST, EACH = 1024, 48  # bytes of a frequent segment; bytes counted for each beside its own
FLUSH = 300_000
SPACE = "▁"
#: White space before a space: only then, or at the ends, is a text more than words with one space before each.
RUNS = re.compile("[\\s\x1c-\x1f] ")
ASCII_RUNS = [f"{c} " for c in " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"]
MARKS = str.maketrans(",;|", "   ")
SEGMENT = re.compile(r" \s*\S*(?:[^\S ]\s*\S*)*")
_LOADED: dict[tuple[int, int], Aligner] = {}


def byte_alphabet() -> dict[str, int]:
    """Characters of a byte-level vocabulary: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


class Aligner:
    """Both tokenizers, the bytes of their tokens, and segments that no merge reaches across."""

    def __init__(self, a: str, b: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        way = json.loads(a)["pre_tokenizer"]
        if (way["type"], way.get("use_regex", True), way["add_prefix_space"]) != ("ByteLevel", True, False):
            raise ValueError("A must be a byte-level tokenizer with its own pattern and no added space")
        self.a, self.b = Tokenizer.from_str(a), sentencepiece.SentencePieceProcessor(model_proto=b)
        self.a.encode_special_tokens = True
        of = byte_alphabet()
        special = {t["id"] for t in json.loads(a)["added_tokens"]}
        self.a_bytes = {i: t.encode() if i in special else bytes(of[c] for c in t) for t, i in self.a.get_vocab().items()}
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        self.a_sizes = np.array([len(self.a_bytes[i]) for i in range(len(self.a_bytes))], np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        #: Bytes behind which a token of A or B goes on with a space; no segment ends after these.
        self.joined = {t[k] for t in [*self.a_bytes.values(), *self.b_bytes] for k in range(len(t) - 1) if t[k + 1] == 32 and t[k] != 32}
        self.beyond_ascii = min(self.joined, default=255) > 127
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << 20:
            raise ValueError("vocabularies of 2^20 tokens at most")

    def segments(self, text: str) -> list[str]:
        """Segments of space + text, each without the space it starts with; text is not empty."""
        ascii_ = text.isascii()
        if text[0] == " " or text[-1] == " " or (any(r in text for r in ASCII_RUNS) if ascii_ else RUNS.search(text)):
            found = [s[1:] for s in SEGMENT.findall(f" {text}")]
            if len(found) > 1 and (not found[-1] or found[-1].isspace()):  # B has no tokens for an empty text, so a last space is no segment
                found[-2:] = [" ".join(found[-2:])]
        else:
            found = text.split(" ")
        if ascii_ and self.beyond_ascii or not any(bytes([x, 32]) in text.encode() for x in self.joined):
            return found
        out = found[:1]
        for s in found[1:]:
            if out[-1].encode()[-1:] and out[-1].encode()[-1] in self.joined:
                out[-1] += f" {s}"
            else:
                out.append(s)
        return out

    def tokens(self, whole: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of A and of B for a text that starts with a space; None where their bytes differ from it."""
        a, b = self.a.encode(whole, add_special_tokens=False).ids, self.b.encode(whole[1:])
        raw = whole.encode()
        if b"".join([self.a_bytes[x] for x in a]) != raw or b"".join([self.b_bytes[x] for x in b]) != raw:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def align(self, segments: list[str]) -> Iterator[str | None]:
        """Groups of each segment as text, None where the bytes differ. Many are encoded as one text: no merge reaches across."""
        part = []
        for k, s in enumerate(segments):
            part.append(s)
            if len(part) == 1000 or k + 1 == len(segments) or s[-1:].isspace():  # nothing may follow white space at a text's end
                yield from self._aligned(part)
                part = []

    def _aligned(self, part: list[str]) -> list[str | None]:
        found = self.tokens(" " + " ".join(part))
        if found is None:
            half = len(part) // 2
            return [*self._aligned(part[:half]), *self._aligned(part[half:])] if half else [None]
        a, b = found
        ends_a, ends_b = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        cuts_a, cuts_b = np.searchsorted(ends_a, both) + 1, np.searchsorted(ends_b, both) + 1
        x, y = list(map(str, a.tolist())), list(map(str, b.tolist()))
        groups, p, q = [], 0, 0
        for i, j in zip(cuts_a.tolist(), cuts_b.tolist(), strict=True):
            groups.append(f"{x[p]}|{y[q]}" if i == p + 1 and j == q + 1 else f"{','.join(x[p:i])}|{','.join(y[q:j])}")
            p, q = i, j
        of = np.searchsorted(both, np.cumsum([len(s.encode()) + 1 for s in part])) + 1
        return [";".join(groups[i:j]) for i, j in zip([0, *of.tolist()], of.tolist(), strict=False)]

    def read(self, texts: list[str]) -> Aligned:
        """What groups as text say, of all texts at once; '' has no tokens."""
        some = [t for t in texts if t]
        which = np.array([k for k, t in enumerate(texts) if t], np.int64)
        whole = np.frombuffer(";".join(some).encode(), np.uint8)
        marks = whole[(whole < 48) | (whole > 57)]
        ids = np.array(";".join(some).translate(MARKS).split(), np.int64)
        bars, semis = (np.concatenate([[0], np.cumsum(marks == m)]) for m in b"|;")
        if not some:
            bars = semis = np.zeros(0, np.int64)
        on_a = bars == semis
        groups = np.array([t.count(";") + 1 for t in some], np.int64)
        of_group = np.repeat(which, groups)
        a, b, of_a, of_b = ids[on_a], ids[~on_a], of_group[semis[on_a]], of_group[semis[~on_a]]
        ends_a, ends_b = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        every = np.union1d(ends_a, ends_b)
        at_a, at_b = np.searchsorted(ends_a, every), np.searchsorted(ends_b, every)
        n = len(texts)
        counts = np.stack([np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n), np.bincount(of_group, minlength=n)], 1)
        return Aligned(counts.astype(np.int64), a[at_a] << 20 | b[at_b], of_a[at_a])


@dataclass
class Aligned:
    """Of many segments: tokens of A and B and groups (a row each), all links, and the segment of each link (in order)."""

    counts: np.ndarray
    links: np.ndarray
    of: np.ndarray


def aligner(files) -> Aligner:
    """The Aligner of this Python worker, made once for each pair of files."""
    a, b = files.value
    key = (hash(a), hash(b))
    if key not in _LOADED:
        _LOADED[key] = Aligner(a, b)
    return _LOADED[key]


def _lists(flat: np.ndarray, rows: np.ndarray, n: int, kind: pa.DataType) -> pa.ListArray:
    """A list for each of n rows, from values and their rows (in order)."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


def segment_counts(docs: DataFrame, files) -> DataFrame:
    """segment, n: occurrences over all rows, without those that are alone in their task's window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, counts = aligner(files).segments, Counter()

        def out() -> pa.RecordBatch:
            several = {s: n for s, n in counts.items() if n > 1}
            return pa.RecordBatch.from_arrays([pa.array(list(several), pa.string()), pa.array(list(several.values()), pa.int64())], names=["segment", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    counts.update(cut(text))
                    if len(counts) > FLUSH:
                        yield out()
                        counts.clear()
        yield out()

    return docs.select("text").mapInArrow(run, "segment string, n bigint").groupBy("segment").agg(F.sum("n").alias("n"))


def frequent(counted: DataFrame, cost: Column, most: int) -> DataFrame:
    """Rows of counted with the highest n, whose costs sum to most at most: all above one class of a histogram of n."""
    size_class = F.floor(F.log2("n") * 16)
    left, least = most, None
    for c, costs in sorted(counted.groupBy(size_class.alias("c")).agg(F.sum(cost)).collect(), reverse=True):  # some 1,000 rows at most
        if costs > left:
            break
        left, least = left - costs, c
    return counted.where(F.lit(False)) if least is None else counted.where(size_class >= least)


class Frequent:
    """Alignments of frequent segments, as sent to tasks."""

    def __init__(self, counted: DataFrame, files, most: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                groups = list(aligner(files).align(batch.column(0).to_pylist()))
                made = aligner(files).read([g or "" for g in groups])
                counts = [pa.array(c) for c in made.counts.T]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(groups, pa.string()), *counts, _lists(made.links, made.of, len(groups), pa.int64())], names=["segment", "groups", "n_a", "n_b", "n_groups", "links"])

        bytes_ = F.octet_length("segment")
        hot = frequent(counted.where(bytes_ <= LONGEST), bytes_ + EACH, most)
        got = hot.select("segment").mapInArrow(run, "segment string, groups string, n_a bigint, n_b bigint, n_groups bigint, links array<bigint>").toArrow()
        self.numbers = {s: k for k, s in enumerate(got.column("segment").to_pylist())}
        self.groups = got.column("groups").to_pylist()
        self.counts = np.stack([got.column(c).to_numpy() for c in ("n_a", "n_b", "n_groups")], 1).astype(np.int64)
        links = got.column("links").combine_chunks()
        self.flat = links.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.sizes = np.diff(links.offsets.to_numpy()).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def links(self, numbers: np.ndarray) -> np.ndarray:
        """Links of segments, one after the other."""
        sizes = self.sizes[numbers]
        return self.flat[np.repeat(self.starts[numbers], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)]


def with_key(docs: DataFrame) -> DataFrame:
    """doc_id, text and two hashes of the text."""
    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(11), "text").alias("k2"))


def other_segments(docs: DataFrame, files, hot) -> DataFrame:
    """k1, k2, i, groups of the segments of each text that are not frequent, numbered as they first occur in it."""

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, known = aligner(files).segments, hot.value.numbers
        for whole in batches:
            seen = set()
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                at, numbers, found = [], [], []
                for row, (text, k1, k2) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                    if text and (k1, k2) not in seen:
                        seen.add((k1, k2))
                        own = list(dict.fromkeys([s for s in cut(text) if s not in known]))
                        at += [row] * len(own)
                        numbers += range(len(own))
                        found += own
                if found:
                    rows = pa.array(at)
                    yield pa.RecordBatch.from_arrays([batch.column(2).take(rows), batch.column(3).take(rows), pa.array(numbers, pa.int32()), pa.array(found, pa.string())], names=["k1", "k2", "i", "segment"])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_groups, last_row = None, None, None
        for batch in batches:
            k1, k2, segments = (batch.column(c).to_pylist() for c in (0, 1, 3))
            fresh = list(dict.fromkeys(segments))
            if fresh and fresh[0] == last:
                fresh = fresh[1:]
            aligned = dict(zip(fresh, aligner(files).align(fresh), strict=True))
            aligned.setdefault(last, last_groups)
            keep = []
            for row, now in enumerate(zip(segments, k1, k2, strict=True)):
                if now != last_row:  # rows of repeated texts lie together too
                    keep.append(row)
                last_row = now
            if segments:
                last, last_groups = segments[-1], aligned[segments[-1]]
            part = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([aligned[segments[row]] for row in keep], pa.string())], names=["k1", "k2", "i", "groups"])

    rows = docs.mapInArrow(rare, "k1 bigint, k2 bigint, i int, segment string").repartition("segment").sortWithinPartitions("segment", "k1", "k2")
    return rows.mapInArrow(once, "k1 bigint, k2 bigint, i int, groups string")


COMPOSED = "doc_id bigint, k1 bigint, k2 bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, numbers array<int>, times array<int>, links array<bigint>"


def compose(docs: DataFrame, files, hot, digest: bool) -> DataFrame:
    """COMPOSED rows: counts and groups of each text; its frequent segments by number, how often each, and all other links."""
    by_text = other_segments(docs, files, hot).groupBy("k1", "k2").agg(F.collect_list(F.concat_ws(":", "i", "groups")).alias("others"))
    names = [f.split()[0] for f in COMPOSED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, read = aligner(files).segments, aligner(files).read
        known, texts, frequent_counts, sizes = hot.value.numbers.get, hot.value.groups, hot.value.counts, hot.value.sizes
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                part = whole.slice(at, 500)
                groups, numbers, others, n = [], [], [], part.num_rows
                sizes_in, sizes_out = np.zeros(n, np.int64), np.zeros(n, np.int64)
                for row, (text, more) in enumerate(zip(part.column(1).to_pylist(), part.column(4).to_pylist(), strict=True)):
                    own = list(map(known, segments := cut(text))) if text else []
                    outside = []
                    if more:
                        rest = dict(x.partition(":")[::2] for x in more)
                        place: dict[str, str] = {}
                        gone = [k for k, number in enumerate(own) if number is None]
                        # a segment without groups (null) comes as its number alone
                        outside = [rest[place.setdefault(segments[k], str(len(place)))] for k in gone]
                        pieces = [texts[k] if k is not None else "" for k in own]
                        for k, g in zip(gone, outside, strict=True):
                            pieces[k] = g or None
                        own = [k for k in own if k is not None]
                    else:
                        pieces = [texts[k] for k in own]
                    if None in pieces:
                        pieces, own, outside = [], [], []
                    joined = ";".join(pieces)
                    groups.append(sha256(joined.encode()).hexdigest() if digest and joined else joined)
                    numbers += own
                    others += outside
                    sizes_in[row], sizes_out[row] = len(own), len(outside)
                of_number, of_other, numbers = np.repeat(np.arange(n), sizes_in), np.repeat(np.arange(n), sizes_out), np.array(numbers, np.int64)
                made = read(others)
                keys, times = np.unique(of_number << 32 | numbers, return_counts=True)
                rows, numbers = keys >> 32, keys & 0xFFFFFFFF
                counts = np.zeros((n, 4), np.int64)
                np.add.at(counts, rows, np.concatenate([frequent_counts[numbers], sizes[numbers, None]], 1) * times[:, None])
                np.add.at(counts[:, :3], of_other, made.counts)
                of_link = of_other[made.of]
                counts[:, 3] += np.bincount(of_link, minlength=n)
                lists = [_lists(x, r, n, kind) for x, r, kind in ((numbers, rows, pa.int32()), (times, rows, pa.int32()), (made.links, of_link, pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), *map(pa.array, counts.T), pa.array(groups, pa.string()), *lists], names=names)

    return docs.join(by_text, ["k1", "k2"], "left").select("doc_id", "text", "k1", "k2", "others").mapInArrow(run, COMPOSED)


def _read_lists(batch: pa.RecordBatch) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Row, number and times of frequent segments; row and link of all others (columns numbers, times, links)."""
    numbers, times, links = batch.columns
    rows = [np.repeat(np.arange(batch.num_rows), np.diff(c.offsets.to_numpy())) for c in (numbers, links)]
    k, n, other = (c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (numbers, times, links))
    return (rows[0], k, n), (rows[1], other)


def pair_counts(composed: DataFrame, hot) -> DataFrame:
    """pair (A id << 20 | B id), n (documents that hold it linked), best (none of its A id has more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["pair", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                (row, number, _), (other_row, other) = _read_lists(batch.slice(at, 200))
                rows = np.concatenate([np.repeat(row, hot.value.sizes[number]), other_row])
                held = np.unique(np.concatenate([hot.value.links(number), other]) << 8 | rows)  # 200 rows, so 8 bits
                ids, n = np.unique(held >> 8, return_counts=True)
                counts.update(dict(zip(ids.tolist(), n.tolist(), strict=True)))
                if len(counts) > FLUSH:
                    yield out()
                    counts.clear()
        yield out()

    counted = composed.select("numbers", "times", "links").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    counted = materialise(counted.withColumn("a", F.shiftright("pair", 20)), "pairs")
    highest = counted.groupBy("a").agg(F.max("n").alias("highest"))  # a row for each id of A's vocabulary at most
    return counted.join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def link_sums(composed: DataFrame, pairs: DataFrame, hot, most: int) -> DataFrame:
    """composed rows with n_best and count_sum over their links."""
    spark = composed.sparkSession
    got = frequent(pairs, F.lit(1), most).toArrow().sort_by("pair")
    table_ = spark.sparkContext.broadcast((got.column("pair").to_numpy(), got.column("n").to_numpy(), got.column("best").to_numpy(zero_copy_only=False).astype(np.int64)))
    carried = ["doc_id", "k1", "k2", "n_a", "n_b", "n_groups", "n_links", "groups"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, bests = (np.append(x, -1) for x in table_.value)

        def looked_up(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            place = np.searchsorted(ids[:-1], pair)
            found = ids[place] == pair
            return np.where(found, bests[place], 0), np.where(found, counts[place], 0), ~found

        frequent_ = hot.value
        of = np.repeat(np.arange(len(frequent_.sizes)), frequent_.sizes)
        best, count, unknown = (np.bincount(of, x, len(frequent_.sizes)).astype(np.int64) for x in looked_up(frequent_.flat))
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                n = batch.num_rows
                (row, number, times), (other_row, other) = _read_lists(batch.select(["numbers", "times", "links"]))
                other_best, other_count, other_unknown = looked_up(other)
                sums = [(np.bincount(row, x[number] * times, n) + np.bincount(other_row, y, n)).astype(np.int64) for x, y in ((best, other_best), (count, other_count))]
                some = unknown[number] > 0
                sizes = frequent_.sizes[number[some]]
                pair = frequent_.links(number[some])
                left = looked_up(pair)[2]
                rows = np.concatenate([np.repeat(row[some], sizes)[left], other_row[other_unknown]])
                by = np.argsort(rows, kind="stable")
                pair = np.concatenate([pair[left], other[other_unknown]])[by]
                often = np.concatenate([np.repeat(times[some], sizes)[left], np.ones(int(other_unknown.sum()), np.int64)])[by]
                lists = [_lists(x, rows[by], n, pa.int64()) for x in (pair, often)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), *map(pa.array, sums), *lists], names=[*carried, "n_best", "count_sum", "pair", "times"])

    schema = ", ".join(COMPOSED.split(", ")[:8]) + ", n_best bigint, count_sum bigint, pair array<bigint>, times array<bigint>"
    out = composed.mapInArrow(run, schema)
    if got.num_rows == pairs.count():
        return out.drop("pair", "times")
    rest = out.where(F.size("pair") > 0).dropDuplicates(["k1", "k2"]).select("k1", "k2", F.explode(F.arrays_zip("pair", "times")).alias("x"))
    found = rest.select("k1", "k2", F.col("x.pair").alias("pair"), F.col("x.times").alias("times")).join(pairs, "pair")
    found = found.groupBy("k1", "k2").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    both = out.join(found, ["k1", "k2"], "left")
    return both.withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}).drop("pair", "times", "more_best", "more_sum")


def cross_align(docs: DataFrame, a: str = TOKENIZER_A, b: str = TOKENIZER_B, digest: bool = False, hot: int = HOT, pairs: int = PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups of each row; groups as `a1,a2|b1;a3|b2,b3`, or with
    digest its sha256 ('' without tokens). hot, pairs: bounds of what is sent to all tasks; results do not depend on them."""
    sent = docs.sparkSession.sparkContext.broadcast
    files = sent((Path(a).read_text(), Path(b).read_bytes()))
    counted = materialise(segment_counts(docs, files), "segments", compression="zstd")
    known = sent(Frequent(counted, files, hot))
    discard(counted)
    composed = materialise(compose(with_key(docs), files, known, digest), "composed", compression="zstd")
    counts = pair_counts(composed, known)
    return link_sums(composed, counts, known, pairs).drop("k1", "k2")


def op11_cross_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_align(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("groups", "groups_sha256")
