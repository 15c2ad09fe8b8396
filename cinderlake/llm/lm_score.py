"""Operator 2, LM scoring: logistic context mixing over the bits of a text.

A text is cut into segments, each a run of white space and the token after it; the last is the white space left and an
end. Joined, they are the text. An item is a segment with the last CARRY bytes of the text before it. The bits of a segment's
bytes are predicted by hashed contexts: the last 1, 2, 3 and 5 bytes (which reach over the white space into the token before),
the segment so far, and the segment so far with the bytes carried. The end of a token is coded too, as a mark (a byte that
UTF-8 never has), so no segment is the beginning of another and probabilities over texts add up to 1 at most. A segment's
probability depends on its item alone, so each distinct item is worked out once per task, whatever its count.

Training, on the rows whose crc32(doc_id) mod 7 is not 2, in Spark jobs over all of them:
1. Count items (map-side counters, then a shuffle by their tokens) and from them tokens; both grow with the corpus.
2. Each task adds the bits of its items to tables of zeros and ones by hashed context, in lines of 16 slots for four bits;
   their size follows the bytes of distinct items up to MOST_LINES. Tables are cut into blocks, compressed, and added up by
   block. The sum is broadcast.
3. Mixing: stretched predictions are added with weights that a gate chooses (the longest context seen and the bit's
   place). Every task learns weights online, batch after batch, with each item's own occurrence left out of the
   counts, and a table that refines the mixed probability by gate; weights are averaged over tasks by bits, tables are added.
4. Tokens: beside the bits' probability stands the exact share of the token among all training tokens, times that of its form
   (white space before it and capitals, after the end of a sentence or not). The two are mixed by SHARE. These counts are never
   hashed and grow with the corpus, so what the tables lose to collisions in a large corpus is held here.

Scoring is one pass over whole texts. Exact counts of frequent tokens (at most FREQUENT) are broadcast, the rest goes through
a join, for the score and for the base score alike.

Defined results: null texts count as empty (an end only). Repeated rows are scored each; a null id is in the training
part. Without training rows, scores come from even bits. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count, islice
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlake.llm.common import crc_mod, materialise, table

CARRY = 2
ORDERS = (1, 2, 3, 5, 0, -1)  # 0: the segment so far, -1: and the bytes carried
MOST_LINES = (13, 15, 17, 17, 18, 18)  # base-2 logarithms
BLOCK = 4096
FREQUENT = 200_000
COUNTER_KEYS, PARTS = 700_000, 512
CHUNK_BYTES = 12_000
HELD = 250_000
RATE, PRIOR, BUCKETS, LIMIT = 0.02, 0.2, 33, 8.0
SHARE = 0.5
END, END_TOKEN = b"\x00", b"\xff\xff"
GATES = (len(ORDERS) + 1) * 8
MARK, SPACES = b"\xff", b" \t\n\x0b\x0c\r"
START = MARK * CARRY
_SEGMENT = re.compile(rb"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")
#: Where a token starts with the byte that stands for an end, a mark tells it from one.
_LIKE_END = re.compile(rb"(?<![^\t-\r ])\x00")
_LAST = re.compile(rb"[\t-\r ]*\x00")

_NIBBLE = np.stack([np.arange(256) >> 4, np.arange(256) & 15], 1)
#: Of each byte: its bits and their places in a line, by half and bit.
BITS = ((_NIBBLE[:, :, None] >> (3 - np.arange(4))) & 1).astype(np.uint8)
_PLACE = ((1 << np.arange(4)) | (_NIBBLE[:, :, None] >> (4 - np.arange(4)))).astype(np.int64)
_HALF = ((np.arange(16, dtype=np.uint32) + np.uint32(1)) * np.uint32(0x85EBCA6B))[np.arange(256) >> 4]
_POWERS = np.ones(1 << 12, np.uint64)
for _i in range(1, len(_POWERS)):
    _POWERS[_i] = (int(_POWERS[_i - 1]) * 0x100000001B3) % 2**64


def segments(raw: bytes) -> list[bytes]:
    if END in raw:
        raw = _LIKE_END.sub(MARK + END, raw)
    found = _SEGMENT.findall(raw)
    if found and raw[-1] in SPACES:
        found[-1] += END
    else:
        found.append(END)
    return found


def items_of(raw: bytes) -> list[bytes]:
    """The segments, each behind the last bytes of the text before it."""
    found = segments(raw)
    tails = [x[-CARRY:] for x in found]
    tails[0] = (START + found[0])[-CARRY:]
    return [START + found[0], *map(bytes.__add__, tails, islice(found, 1, None))]


def coded(item: bytes) -> bytes:
    """The symbols that are predicted: a token's item ends with a mark, the last one of a text with END."""
    return item if item[-1] == 0 and _LAST.fullmatch(item, CARRY) else item + MARK


def token_of(item: bytes) -> bytes:
    """The lower-case token of an item; END_TOKEN for the last."""
    token = item[CARRY:].lstrip(SPACES)
    return END_TOKEN if token == END else token.lstrip(MARK).lower()


#: Forms of a token: after a sentence's end or not, white space of a kind, lower case or a capital first. Others have none.
FORMS = 12


def form_of(item: bytes) -> int:
    body = item[CARRY:]
    token = body.lstrip(SPACES)
    white = body[: len(body) - len(token)]
    kind = {b"": 0, b" ": 1, b"\n": 2}.get(white, -1)
    if kind < 0 or token[:1] == MARK:
        return -1
    low = token.lower()
    if token == low:
        capital = 0
    elif token[:1] != low[:1] and token[1:] == low[1:]:
        capital = 1
    else:
        return -1
    return (6 if item[CARRY - 1 : CARRY] in (b".", b"!", b"?", MARK) else 0) + kind * 2 + capital


def chunks(items: list[bytes]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, x in enumerate(items):
        if size and size + len(x) > CHUNK_BYTES:
            yield start, i
            start, size = i, 0
        size += len(x)
    if len(items) > start:
        yield start, len(items)


def lines(items: list[bytes], bits: tuple[int, ...]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Coded bytes of all items (without those carried), for each order the slots by (byte, half, bit), and where each item starts."""
    b = np.frombuffer(b"".join(items), np.uint8)
    sizes = np.fromiter(map(len, items), np.int64, len(items))
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(b)) - np.repeat(starts, sizes)
    charged = np.flatnonzero(place >= CARRY)
    ctx = np.zeros(len(b), np.uint32)
    found: dict[int, np.ndarray] = {}
    for k in range(1, max(ORDERS) + 1):
        back = np.zeros(len(b), np.uint32)
        back[k:] = b[:-k]
        ctx = np.where(place >= k, (ctx + back + np.uint32(1)) * np.uint32(0x01000193), ctx + np.uint32(0x3779))
        if k in ORDERS:
            found[k] = ctx[charged]
    sums = np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _POWERS[place & (len(_POWERS) - 1)])
    before = np.concatenate([[np.uint64(0)], sums])
    here, far = before[charged], place[charged].astype(np.uint64)
    counts = sizes - CARRY
    for order, first in ((0, starts + CARRY), (-1, starts)):
        prefix = here - np.repeat(before[first], counts)
        prefix = (prefix ^ (prefix >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + far
        found[order] = (prefix >> np.uint64(32)).astype(np.uint32)
    b = b[charged]
    places, half, out = _PLACE[b], _HALF[b], []
    for order, size in zip(ORDERS, bits, strict=True):
        h = found[order] * np.uint32(0xCC9E2D51)
        h ^= h >> np.uint32(15)
        both = np.stack([h * np.uint32(0x9E3779B1), (h ^ half) * np.uint32(0x9E3779B1)], 1)
        both ^= both >> np.uint32(16)
        both *= np.uint32(0x85EBCA6B)
        out.append(((both >> np.uint32(32 - size)).astype(np.int64) << 4)[:, :, None] + places)
    return b, out, np.cumsum(counts) - counts


class Mixer:
    """Predictions of all orders to one probability for each bit."""

    def __init__(self):
        self.weights = np.full((len(ORDERS), GATES // 4, 4), 0.35, np.float32)
        self.seen = np.full((len(ORDERS), GATES // 4, 4), 1.0, np.float32)
        self.refine = np.zeros((2, GATES * BUCKETS))

    @staticmethod
    def gates(inputs: list[np.ndarray]) -> np.ndarray:
        """By byte and half: the longest context seen, and the half."""
        top = np.zeros(inputs[0].shape[:2], np.intp)
        for k, x in enumerate(inputs, 1):
            np.putmask(top, x[:, :, 0] != 0, k)
        return top * 2 + np.arange(2)

    def mix(self, inputs: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        mixed = self.weights[0].take(gate, 0)
        mixed *= inputs[0]
        for k, x in enumerate(inputs[1:], 1):
            w = self.weights[k].take(gate, 0)
            w *= x
            mixed += w
        return mixed

    @staticmethod
    def bucket(gate: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        at = ((np.clip(mixed, -LIMIT, LIMIT) + np.float32(LIMIT)) * np.float32((BUCKETS - 1) / (2 * LIMIT)) + np.float32(0.5)).astype(np.intp)
        at += ((gate * 4)[:, :, None] + np.arange(4)) * BUCKETS
        return at

    def learn(self, inputs: list[np.ndarray], bits: np.ndarray, counts: np.ndarray) -> None:
        gate = self.gates(inputs)
        mixed = self.mix(inputs, gate)
        weight = np.broadcast_to(counts[:, None, None], bits.shape)
        error = weight * (bits - 1 / (1 + np.exp(-mixed)))
        flat = ((gate * 4)[:, :, None] + np.arange(4)).ravel()
        total = np.maximum(np.bincount(flat, weight.ravel(), GATES), 1e-9)
        for k, x in enumerate(inputs):
            grad = (np.bincount(flat, (error * x).ravel(), GATES) / total).reshape(-1, 4)
            self.seen[k] += grad * grad
            self.weights[k] += RATE * 8 * grad / np.sqrt(self.seen[k])
        at = self.bucket(gate, mixed).ravel()
        self.refine[0] += np.bincount(at, (weight * bits).ravel(), GATES * BUCKETS)
        self.refine[1] += np.bincount(at, weight.ravel(), GATES * BUCKETS)


class Model:
    """Frozen tables, weights and refinement; log10 probabilities of items by their bits, and shares of forms."""

    def __init__(self, bits: tuple[int, ...], counts: list[np.ndarray], mixer: Mixer, forms: np.ndarray, n_tokens: int):
        self.bits, self.mixer = bits, mixer
        self.stretch = [stretched(c[0::2], c[1::2]) for c in counts]
        centres = np.tile(np.linspace(-LIMIT, LIMIT, BUCKETS), GATES)
        self.refined = ((mixer.refine[0] + 4 / (1 + np.exp(-centres))) / (mixer.refine[1] + 4)).astype(np.float32)
        half = forms.reshape(2, FORMS // 2)
        shares = half / np.maximum(half.sum(1, keepdims=True), 1)
        #: log10 of what a token's count is multiplied by, relative to the bits' part; of items without a form nothing is added.
        self.forms = np.log10(np.maximum(np.append(shares.ravel(), 0.0), 1e-300) * SHARE / (1 - SHARE) / max(1, n_tokens))
        self.rest = math.log10(1 - SHARE) if n_tokens else 0.0

    def log10(self, items: list[bytes]) -> np.ndarray:
        return self.coded_log10([coded(x) for x in items])

    def coded_log10(self, items: list[bytes]) -> np.ndarray:
        out = []
        for a, z in chunks(items):
            b, found, starts = lines(items[a:z], self.bits)
            inputs = [t.take(s) for t, s in zip(self.stretch, found, strict=True)]
            gate = self.mixer.gates(inputs)
            mixed = self.mixer.mix(inputs, gate)
            p = (np.float32(1) / (np.float32(1) + np.exp(-mixed)) + self.refined.take(self.mixer.bucket(gate, mixed))) * np.float32(0.5)
            p = np.clip(np.abs(p - (1 - BITS[b]).astype(np.float32)), np.float32(1e-6), np.float32(1 - 1e-6))
            out.append(np.add.reduceat(np.log(p).sum((1, 2), dtype=np.float64), starts) / math.log(10))
        return np.concatenate(out) if out else np.zeros(0)

    def gains(self, items: list[bytes], scores: np.ndarray) -> np.ndarray:
        """log10 of the factor that a token's count has beside the bits' probability."""
        return self.forms[np.fromiter(map(form_of, items), np.int64, len(items))] - scores


def stretched(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log-odds of a one; exactly 0 only where nothing was seen."""
    one, zero = ones.astype(np.float32), zeros.astype(np.float32)
    x = np.log((one + np.float32(PRIOR)) / (zero + np.float32(PRIOR)))
    x[x == 0] = np.float32(1e-6)
    return x * (one + zero > 0)


class Lookup:
    """Numbers of items, and by number: the log10 probability, the token's log10(count + 1) where it is frequent, and otherwise
    the token and its gain, to be joined. The first `kept` numbers stay; beyond HELD more, forget() drops the others."""

    def __init__(self, model: Model, frequent: dict[bytes, int]):
        self.model, self.frequent, self.kept = model, frequent, 0
        self.number: dict[bytes, int] = defaultdict(count().__next__)
        self.scores, self.logs, self.gains, self.tokens = np.zeros(0), np.zeros(0), np.zeros(0, np.float32), []

    def work_out(self) -> None:
        """Fill in the items numbered since the last call."""
        fresh = len(self.number) - len(self.tokens)
        if not fresh:
            return
        new = list(islice(reversed(self.number), fresh))[::-1]
        tokens = [token_of(x) for x in new]
        n = np.fromiter((self.frequent.get(w, 0) for w in tokens), np.float64, len(tokens))
        bits = self.model.log10(new)
        gains = self.model.gains(new, bits)
        scores = bits + self.model.rest + np.where(n > 0, np.log10(1 + n * 10.0 ** np.minimum(gains, 290)), 0.0)
        self.scores = np.concatenate([self.scores, scores])
        self.logs = np.concatenate([self.logs, np.log10(n + 1)])
        self.gains = np.concatenate([self.gains, gains.astype(np.float32)])
        self.tokens.extend(None if known else w for w, known in zip(tokens, n, strict=True))

    def keep(self, items: list[bytes], scores: np.ndarray, logs: np.ndarray, gains: np.ndarray, tokens: list[bytes | None]) -> Lookup:
        """Start from items that were worked out before."""
        self.number = defaultdict(count(len(items)).__next__, zip(items, range(len(items)), strict=True))
        self.scores, self.logs, self.gains, self.tokens, self.kept = scores, logs, gains, list(tokens), len(items)
        return self

    def held(self) -> tuple:
        return list(self.number), self.scores, self.logs, self.gains, self.tokens

    def forget(self) -> None:
        if len(self.tokens) > self.kept + HELD:
            k = self.kept
            self.keep(list(islice(self.number, k)), self.scores[:k], self.logs[:k], self.gains[:k], self.tokens[:k])


BLOB = "blob binary, sizes binary, ns binary"


def pack(items: list[bytes], ns: list[int]) -> tuple[bytes, bytes, bytes]:
    """Items one after another, their lengths and their counts."""
    return b"".join(items), np.fromiter(map(len, items), np.int32, len(items)).tobytes(), np.array(ns, np.int64).tobytes()


def unpack(blob: bytes, sizes: bytes, ns: bytes) -> tuple[list[bytes], np.ndarray]:
    ends = np.cumsum(np.frombuffer(sizes, np.int32), dtype=np.int64).tolist()
    return [blob[a:z] for a, z in zip([0, *ends[:-1]], ends, strict=True)] if ends else [], np.frombuffer(ns, np.int64)


def _packed(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    kinds = [pa.int32()] * (len(names) - 3) + [pa.binary()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def corpus_counts(training: DataFrame) -> DataFrame:
    """kind (0 item, 1 token, 2 form) and packed keys with counts, over the texts of training; each item and token is in one place.

    Tasks count items in bounded counters; what they hold goes to PARTS parts by a hash of the token, as packed bytes
    for each part, and the tasks that get a part add its counters up. A token END_TOKEN stands for each text's end.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            items: list[list[bytes]] = [[] for _ in range(PARTS)]
            for x in c:
                items[crc32(token_of(x)) % PARTS].append(x)
            rows = [(part, *pack(own, [c[x] for x in own])) for part, own in enumerate(items) if own]
            c.clear()
            for i in range(0, len(rows), 64):
                yield _packed(rows[i : i + 64], ["part", "blob", "sizes", "ns"])

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                for text in batch.column(0).slice(at, 200).cast(pa.binary()).to_pylist():
                    c.update(items_of(text or b""))
                if len(c) > COUNTER_KEYS:
                    yield from flush()
        yield from flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        get = held.get
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                items, ns = unpack(row["blob"], row["sizes"], row["ns"])
                for x, n in zip(items, ns.tolist(), strict=True):
                    held[x] = get(x, 0) + n
        tokens: dict[bytes, int] = {}
        for x, n in held.items():
            token = token_of(x)
            tokens[token] = tokens.get(token, 0) + n
        forms = Counter()
        for x, n in held.items():
            forms[b"%d" % form_of(x)] += n
        for kind, found in enumerate((held, tokens, forms)):
            keys, values = list(found), list(found.values())
            for i in range(0, len(keys), 5_000):
                yield _packed([(kind, *pack(keys[i : i + 5_000], values[i : i + 5_000]))], ["kind", "blob", "sizes", "ns"])

    return training.select("text").mapInArrow(tally, f"part int, {BLOB}").repartition("part").mapInArrow(add, f"kind int, {BLOB}")


def token_rows(counted: DataFrame, kind: int = 1) -> DataFrame:
    """item, n of each token, or of the forms of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                items, ns = unpack(row["blob"], row["sizes"], row["ns"])
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.binary()), pa.array(ns)], names=["item", "n"])

    return counted.where(F.col("kind") == kind).select("blob", "sizes", "ns").mapInArrow(run, "item binary, n bigint")


def _batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            items, n = unpack(row["blob"], row["sizes"], row["ns"])
            for a, z in chunks(items):
                yield items[a:z], n[a:z]


def table_bits(counted: DataFrame) -> tuple[int, ...]:
    """Lines of each order's table: a thirty-second of the bytes of distinct items, MOST_LINES at most."""
    size = counted.where("kind = 0").agg(F.coalesce(F.sum(F.octet_length("blob")), F.lit(0))).first()[0]
    return tuple(max(8, min(most, int(size // 32).bit_length())) for most in MOST_LINES)


def bit_counts(counted: DataFrame, bits: tuple[int, ...]) -> list[np.ndarray]:
    """Zeros and ones of each slot, side by side, of each order: tables of bounded size, added up by blocks in Spark."""
    sizes = [32 << k for k in bits]
    ends = np.cumsum([n // BLOCK for n in sizes])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(n, np.int64) for n in sizes]
        for held, n in _batches_of(batches):
            items = [coded(x) for x in held]
            b, found, _ = lines(items, bits)
            each = np.repeat(np.repeat(n, [len(x) - CARRY for x in items]), 8)
            ones = BITS[b].ravel()
            for t, s in zip(total, found, strict=True):
                np.add.at(t, s.ravel() * 2 + ones, each)
        pack = zstandard.ZstdCompressor(level=1).compress
        for k, t in enumerate(total):
            part = t.reshape(-1, BLOCK)
            used = np.flatnonzero(part.any(1))
            for i in range(0, len(used), 500):
                yield pa.RecordBatch.from_arrays([pa.array(used[i : i + 500] + ends[k] - len(part)), pa.array([pack(part[j].tobytes()) for j in used[i : i + 500]], pa.binary())], names=["block", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block = np.frombuffer(unpack(counts), np.int64)
                if k in total:
                    total[k] += block
                else:
                    total[k] = block.copy()
        keys = sorted(total)
        small = []
        for k in keys:  # counts beyond 2^30 are halved with the other of their slot until they fit
            pair = total[k].reshape(-1, 2)
            over = np.maximum(0, np.ceil(np.log2(np.maximum(pair.max(1), 1)) - 30)).astype(np.int64)
            small.append(pack((pair >> over[:, None]).astype(np.int32).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(small, pa.binary())], names=["block", "counts"])

    schema = "block bigint, counts binary"
    summed = counted.where("kind = 0").select("blob", "sizes", "ns").mapInArrow(add, schema).repartition(24, "block").mapInArrow(merge, schema).toArrow()
    out = np.zeros((int(ends[-1]), BLOCK), np.int32)
    unpack = zstandard.ZstdDecompressor().decompress
    for k, counts in zip(summed.column(0).to_pylist(), summed.column(1).to_pylist(), strict=True):
        out[k] = np.frombuffer(unpack(counts), np.int32)
    return [t.ravel() for t in np.split(out, ends[:-1])]


def train_mixer(counted: DataFrame, bits: tuple[int, ...], counts: list[np.ndarray]) -> Mixer:
    shared = counted.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, done, tables = Mixer(), 0.0, shared.value
        for held, n in _batches_of(batches):
            items = [coded(x) for x in held]
            b, found, _ = lines(items, bits)
            ones = BITS[b].astype(np.int8)
            inputs = [stretched(t.take(s * 2) - (1 - ones), t.take(s * 2 + 1) - ones) for t, s in zip(tables, found, strict=True)]
            weight = np.repeat(n, [len(x) - CARRY for x in items]).astype(np.float64)
            mixer.learn(inputs, ones, weight)
            done += float(weight.sum())
        w, at = mixer.weights.ravel(), np.flatnonzero(mixer.refine[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array([0] * len(w) + [1] * len(at), pa.int32()), pa.array([*range(len(w)), *at], pa.int64()), pa.array(np.concatenate([w * done, mixer.refine[0][at]]), pa.float64()), pa.array(np.concatenate([np.full(len(w), done), mixer.refine[1][at]]), pa.float64())],
            names=["kind", "place", "a", "b"],
        )

    parts = counted.where("kind = 0").select("blob", "sizes", "ns").mapInArrow(run, "kind int, place bigint, a double, b double")
    mixer = Mixer()
    found = parts.groupBy("kind", "place").agg(F.sum("a"), F.sum("b")).collect()  # GATES * (orders + BUCKETS) rows at most
    shared.unpersist()
    for kind, place, a, b in found:
        if kind == 0 and b > 0:
            mixer.weights.ravel()[place] = a / b
        elif kind == 1:
            mixer.refine[:, place] = a, b
    return mixer


def frequent_tokens(tokens: DataFrame) -> tuple[dict[bytes, int], int]:
    """Counts of the most frequent tokens, at most FREQUENT, and the least among them."""
    least = _least(tokens.groupBy(F.least("n", F.lit(100_000)).alias("n")).agg(F.count("*").alias("k")).collect())
    found = tokens.where(F.col("n") >= least).select("item", "n").toArrow()
    return dict(zip(found.column("item").to_pylist(), found.column("n").to_pylist(), strict=True)), least


def frequent_items(counted: DataFrame) -> list[bytes]:
    """At most about FREQUENT frequent items: each packed row sends its share of the most frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for items, n in _batches_of(batches):
            top = np.flatnonzero(n >= least)
            yield pa.RecordBatch.from_arrays([pa.array([items[i] for i in top], pa.binary())], names=["item"])

    packed = counted.where("kind = 0").select("blob", "sizes", "ns")
    sizes = packed.mapInArrow(_histogram, "n bigint, k bigint").groupBy("n").agg(F.sum("k").alias("k")).collect()  # 100,000 rows at most
    least = _least(sizes)
    return packed.mapInArrow(run, "item binary").toArrow().column("item").to_pylist()


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    for _, n in _batches_of(batches):
        values, counts = np.unique(np.minimum(n, 100_000), return_counts=True)
        total.update(dict(zip(values.tolist(), counts.tolist(), strict=True)))
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["n", "k"])


def _least(sizes) -> int:
    """The least count n such that at most FREQUENT items have it or more."""
    held, least = 0, 100_001
    for n, k in sorted(sizes, reverse=True):
        if held + k > FREQUENT:
            break
        held, least = held + k, n
    return least


def score(docs: DataFrame, counted: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits, bits_per_byte of each row of docs."""
    context = docs.sparkSession.sparkContext
    tokens = materialise(token_rows(counted), "tokens")
    total, distinct = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    known, least = frequent_tokens(tokens)
    lookup = Lookup(model, known)
    for item in frequent_items(counted):
        lookup.number[item]
    lookup.work_out()
    shared, frequent, ready = context.broadcast(model), context.broadcast(known), context.broadcast(lookup.held())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(shared.value, frequent.value).keep(*ready.value)
        uid = TaskContext.get().partitionId() << 36
        for batch in batches:
            for i in range(0, batch.num_rows, 400):
                part = batch.slice(i, 400)
                lookup.forget()
                number, numbers, lengths, sizes = lookup.number.__getitem__, array("q"), [], []
                for text in part.column(1).cast(pa.binary()).to_pylist():
                    found = items_of(text or b"")
                    numbers.extend(map(number, found))
                    lengths.append(len(found))
                    sizes.append(len(text or b""))
                lookup.work_out()
                at = np.frombuffer(numbers, np.int64)
                starts = np.cumsum(lengths) - lengths
                scores, logs = np.add.reduceat(lookup.scores[at], starts), lookup.logs[at]
                rare_at = np.flatnonzero(logs == 0)
                counts = np.bincount(np.searchsorted(starts, rare_at, side="right") - 1, minlength=len(lengths))
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                rare = pa.StructArray.from_arrays([pa.array([lookup.tokens[k] for k in at[rare_at]], pa.binary()), pa.array(lookup.gains[at[rare_at]], pa.float32())], names=["item", "gain"])
                ids = np.arange(len(lengths)) + uid
                uid += len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), part.column(0), part.column(2), pa.array(sizes, pa.int64()), pa.array(lengths, pa.int64()), pa.array(np.array(lengths) - counts), pa.array(np.add.reduceat(logs, starts)), pa.array(scores), pa.ListArray.from_arrays(offsets, rare)],
                    names=["uid", "doc_id", "held_out", "n_bytes", "n_tokens", "seen", "sums", "bits_score", "rare"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), "text", (crc_mod("doc_id", 7) == 2).alias("held_out"))
    scored = materialise(rows.mapInArrow(run, "uid bigint, doc_id bigint, held_out boolean, n_bytes bigint, n_tokens bigint, seen bigint, sums double, bits_score double, rare array<struct<item:binary,gain:float>>"), "scored")
    rare = scored.select("uid", F.explode("rare").alias("rare")).select("uid", "rare.*").join(tokens.where(F.col("n") < least).select("item", "n"), "item")
    gained = F.log10(1 + F.col("n") * F.pow(F.lit(10.0), F.least(F.col("gain").cast("double"), F.lit(290.0))))
    rest = materialise(rare.groupBy("uid").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1.0)).alias("rest"), F.sum(gained).alias("gained")), "rare")
    whole = scored.drop("rare").join(rest, "uid", "left")
    score = F.col("bits_score") + F.coalesce("gained", F.lit(0.0))
    bits = -score * F.lit(math.log2(10))
    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("seen") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("sums") + F.coalesce("rest", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(total + distinct + 1))).alias("base_score"),
        score.alias("score"),
        "n_bytes",
        bits.alias("bits"),
        F.try_divide(bits, F.col("n_bytes")).alias("bits_per_byte"),
    )


def train(docs: DataFrame) -> tuple[DataFrame, Model]:
    training = docs.select("doc_id", "text").where(crc_mod("doc_id", 7) != 2)
    counted = materialise(corpus_counts(training), "corpus")
    bits = table_bits(counted)
    counts = bit_counts(counted, bits)
    forms = np.zeros(FORMS + 1, np.int64)
    for item, n in token_rows(counted, 2).groupBy("item").agg(F.sum("n")).collect():  # FORMS + 1 rows
        forms[int(item)] = n
    return counted, Model(bits, counts, train_mixer(counted, bits, counts), forms[:FORMS], int(forms.sum()))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, *train(docs))
