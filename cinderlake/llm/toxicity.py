"""Operator 7, toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's vector is the sum of hashed rows for the word and for its first 3, 4 and 5 bytes, so unseen endings of known
stems count. Filters of widths 1, 2 and 3 run over all words of a text, each keeps its maximum, and a logistic layer
joins them. All of it starts from small random numbers, half of the filters speaking for and half against, and is trained
by Adagrad.

Fit and calibration use different rows. With f the remainder of crc32(doc_id) by 5 (0 is held out):
* Fit, f = 1, 2, 3: a bounded sample, at most SAMPLE labelled rows of each class (in the order of a hash of doc_id) and
  SAMPLE_BYTES of text, for EPOCHS rounds, or more until STEPS batches were learned from.
* Calibration, f = 4: all labelled rows are scored in Spark, and counted by guessed language, label and score in bins. Each
  language with LEAST rows of both classes gets the threshold with most right decisions; the others share one from all rows. With fewer than LEAST toxic rows in all, the rows of the fit are added.

The language is guessed from the text itself (common words), never read. The threshold of a text's language is taken off
its logit, so score >= 0.5 is the decision. All rows are scored over whole texts, in one pass without a shuffle.

Defined results: null and empty texts get the score of a text without words. Labels other than 0 and 1 and null ids
are not learned from; contradicting labels of one id count as 1. Repeated rows are scored each. Without labels of both
classes the score is the share of class 1, (n1 + 1) / (n0 + n1 + 2), capped below one half if class 1 is unseen. An
empty table gives no rows. Extra columns are ignored, and kept by drop_toxic().
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cinderlake.llm.common import crc_mod, table
from cinderlake.llm.decontaminate import words_of

SAMPLE, SAMPLE_BYTES = 8_000, 32_000_000
ROWS, DIM, FILTERS, WIDTHS = 1 << 18, 8, 8, (1, 2, 3)
EPOCHS, STEPS, BATCH, RATE, SEED = 6, 400, 64, 0.1, 5
LEAST, BIN, BINS = 20, 0.02, 2_000
COMMON_WORDS = 2_000
FEATURES = 4


def features_of(word: bytes) -> list[int]:
    parts = (word, b"\x01" + word[:3], b"\x02" + word[:4], b"\x03" + word[:5])
    return [xxhash.xxh3_64_intdigest(p) % ROWS for p in parts]


class Batch:
    """Words of some texts: features of the distinct words, a word number for each position, a start for each text."""

    def __init__(self, ids: np.ndarray, features: np.ndarray, sizes: np.ndarray):
        self.ids, self.features = ids, features
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    @staticmethod
    def of_words(texts: list[list[bytes]], cache: dict[bytes, list[int]]) -> Batch:
        if len(cache) > 150_000:
            cache.clear()
        seen: dict[bytes, int] = {}
        ids = [seen.setdefault(w, len(seen)) for t in texts for w in (t or [b""])]
        features = np.array([cache.get(w) or cache.setdefault(w, features_of(w)) for w in seen], np.int64).reshape(-1, FEATURES)
        return Batch(np.array(ids, np.int64), features, np.array([max(1, len(t)) for t in texts]))

    @staticmethod
    def of_numbers(texts: list[np.ndarray], features: np.ndarray) -> Batch:
        seen, ids = np.unique(np.concatenate(texts), return_inverse=True)
        return Batch(ids.astype(np.int64), features[seen].astype(np.int64), np.array([len(t) for t in texts]))


class Texts:
    """Labelled texts as word numbers (a text without words has one, of the empty word)."""

    def __init__(self):
        self.vocabulary: dict[bytes, int] = {b"": 0}
        self.texts: list[np.ndarray] = []
        self.langs: list[str | None] = []
        self.labels: list[int] = []

    def add(self, text: str | None, lang: str | None, label: int) -> None:
        number, vocabulary = self.vocabulary.setdefault, self.vocabulary
        self.texts.append(np.array([number(w, len(vocabulary)) for w in words_of(text) or [b""]], np.int32))
        self.langs.append(lang)
        self.labels.append(label)

    def features(self) -> np.ndarray:
        out = np.zeros((len(self.vocabulary), FEATURES), np.int32)
        for i, w in enumerate(self.vocabulary):
            out[i] = features_of(w)
        return out


class Network:
    def __init__(self, prior: float):
        draw = np.random.default_rng(SEED)
        self.rows = draw.normal(0, 0.05, (ROWS, DIM)).astype(np.float32)
        self.filters = [draw.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        side = np.where(np.arange(len(WIDTHS) * FILTERS) % 2, -1, 1)
        self.out = (np.abs(draw.normal(0, 0.3, len(side))) * side).astype(np.float32)
        self.bias = np.float32(prior)
        self.grads: dict[str, np.ndarray] = {}

    def pooled(self, b: Batch) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Maximum of each filter for each text, the words' vectors, and the responses by position."""
        words = self.rows[b.features].sum(1)
        last = np.repeat(b.starts[1:], np.diff(b.starts))
        at = np.arange(len(b.ids))
        pools, responses = [], []
        for w, f in zip(WIDTHS, self.filters, strict=True):
            r = (words @ f[0])[b.ids]
            for k in range(1, w):
                part = (words @ f[k])[b.ids[k:]]
                part[(at[k:] >= last[:-k])] = 0  # a text's end: nothing beyond it
                r[:-k] += part
            pools.append(np.maximum.reduceat(r, b.starts[:-1], axis=0))
            responses.append(r)
        return np.concatenate(pools, 1), words, responses

    def logits(self, b: Batch) -> np.ndarray:
        return np.maximum(self.pooled(b)[0], 0) @ self.out + self.bias

    def _step(self, name: str, value: np.ndarray, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        seen = self.grads.setdefault(name, np.full(value.shape, 1e-2, np.float32))
        if rows is None:
            seen += grad * grad
            value -= RATE * grad / np.sqrt(seen)
        else:
            seen[rows] += grad * grad
            value[rows] -= RATE * grad / np.sqrt(seen[rows])

    def learn(self, b: Batch, y: np.ndarray) -> None:
        pools, words, responses = self.pooled(b)
        hidden = np.maximum(pools, 0)
        p = 1 / (1 + np.exp(-(hidden @ self.out + self.bias)))
        error = ((p - y) / len(y)).astype(np.float32)
        back = error[:, None] * self.out * (pools > 0)
        touched, grads = [], []
        text = np.repeat(np.arange(len(y)), np.diff(b.starts))
        for k, (w, f, r) in enumerate(zip(WIDTHS, self.filters, responses, strict=True)):
            g = np.zeros_like(f)
            at, which = np.nonzero(r == pools[text, k * FILTERS : (k + 1) * FILTERS])
            tops = np.full((FILTERS, len(y)), len(r))
            np.minimum.at(tops, (which, text[at]), at)  # the first place of each maximum
            for j in range(FILTERS):
                top, delta = tops[j], back[:, k * FILTERS + j]
                for i in range(w):
                    inside = top + i < b.starts[1:]
                    where, d = b.ids[top[inside] + i], delta[inside]
                    g[i, :, j] += d @ words[where]
                    touched.append(b.features[where].ravel())
                    grads.append(np.repeat(d[:, None] * f[i, :, j], FEATURES, 0))
            self._step(f"filter{k}", f, g)
        self._step("out", self.out, (error @ hidden).astype(np.float32))
        self.bias -= np.float32(RATE * error.sum())
        rows, inverse = np.unique(np.concatenate(touched), return_inverse=True)
        total = np.zeros((len(rows), DIM), np.float32)
        np.add.at(total, inverse, np.concatenate(grads))
        self._step("rows", self.rows, total, rows)


class Languages:
    """Guesses a text's language from common words: multinomial scores over COMMON_WORDS words of the sample."""

    def __init__(self, sample: Texts):
        self.names = sorted({x for x in sample.langs if x is not None}) or ["und"]
        words = [*sample.vocabulary]
        counts = np.zeros((len(words), len(self.names)), np.int64)
        for t, lang in zip(sample.texts, sample.langs, strict=True):
            if lang is not None:
                np.add.at(counts, (t, self.names.index(lang)), 1)
        total = counts.sum(1)
        total[0] = 0
        common = sorted(np.argsort(-total, kind="stable")[: COMMON_WORDS * 2].tolist(), key=lambda i: (-total[i], words[i]))
        common = [i for i in common if total[i]][:COMMON_WORDS]
        self.words = {words[i]: k for k, i in enumerate(common)}
        held = np.concatenate([counts[common] + 1.0, np.ones((1, len(self.names)))])
        self.scores = np.log(held / held.sum(0))
        self.scores[-1] = 0

    def guess(self, texts: list[list[bytes]]) -> np.ndarray:
        rest = len(self.words)
        ids = np.array([self.words.get(w, rest) for t in texts for w in (t or [b""])], np.int64)
        starts = np.concatenate([[0], np.cumsum([max(1, len(t)) for t in texts])])[:-1]
        return np.add.reduceat(self.scores[ids], starts.astype(np.int64), axis=0).argmax(1)


class Classifier:
    def __init__(self, sample: Texts):
        labels = np.array(sample.labels, np.float32)
        ones = int((labels == 1).sum())
        self.share = min((ones + 1) / (len(labels) + 2), 1.0 if ones else 0.49)
        self.network = None
        if 0 < ones < len(labels):
            self._train(sample, labels)

    def _train(self, sample: Texts, y: np.ndarray) -> None:
        features, ones = sample.features(), float(y.sum())
        self.network = Network(np.log(ones / (len(y) - ones)) - 1)
        order = np.random.default_rng(SEED)
        for _ in range(max(EPOCHS, -(-STEPS // -(-len(y) // BATCH)))):
            by = order.permutation(len(y))
            for i in range(0, len(by), BATCH):
                part = by[i : i + BATCH]
                self.network.learn(Batch.of_numbers([sample.texts[j] for j in part], features), y[part])
        self.network.grads = {}
        self.languages = Languages(sample)
        self.thresholds = np.zeros(len(self.languages.names))
        words = np.array([*sample.vocabulary], object)
        fitted = np.zeros((len(self.thresholds), 2, BINS), np.int64)
        for i in range(0, len(y), 500):
            part = sample.texts[i : i + 500]
            logits = self.network.logits(Batch.of_numbers(part, features))
            np.add.at(fitted, (self.languages.guess([words[t].tolist() for t in part]), y[i : i + 500].astype(int), binned(logits)), 1)
        self.fitted = fitted

    def calibrate(self, counts: np.ndarray) -> None:
        """counts: rows by guessed language, label and bin of the logit."""
        if counts.sum((0, 2))[1] < LEAST or counts.sum((0, 2))[0] < LEAST:
            counts = counts + self.fitted
        everywhere = best_threshold(counts.sum(0))
        self.thresholds = np.array([best_threshold(c) if c.sum(1).min() >= LEAST else everywhere for c in counts])
        self.fitted = None

    def logits(self, texts: list[str | None], cache: dict) -> tuple[np.ndarray, np.ndarray]:
        """Logits and guessed languages."""
        docs = [words_of(t) for t in texts]
        return self.network.logits(Batch.of_words(docs, cache)).astype(np.float64), self.languages.guess(docs)

    def scores(self, texts: list[str | None], cache: dict) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.share)
        logits, langs = self.logits(texts, cache)
        return 1 / (1 + np.exp(-np.clip(logits - self.thresholds[langs], -40, 40)))


def binned(logits: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(logits / BIN) + BINS // 2, 0, BINS - 1).astype(np.int64)


def best_threshold(counts: np.ndarray) -> float:
    """The border between bins with most right decisions; of several, the middle of the longest stretch without rows between.
    counts: rows by label and bin."""
    right = np.concatenate([[0], np.cumsum(counts[0])]) + np.concatenate([np.cumsum(counts[1][::-1])[::-1], [0]])
    best = right == right.max()
    edges = np.flatnonzero(np.diff(np.concatenate([[0], best.astype(np.int8), [0]])))
    a, z = max(zip(edges[::2], edges[1::2], strict=True), key=lambda e: e[1] - e[0])
    return float((a + z - 1) / 2 - BINS // 2) * BIN


def _labelled(labels: DataFrame) -> DataFrame:
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    return known.groupBy("doc_id").agg(F.max("toxic").alias("_toxic")).withColumn("_fold", crc_mod("doc_id", 5))


def fitted(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Learned in a task, so the sample's texts never come to the driver, from a bounded sample of labelled texts, f = 1, 2, 3:
    at most SAMPLE ids a class are broadcast. Both classes come side by side, by the places of their ids in the order of
    the hash, so SAMPLE_BYTES cuts both alike."""
    known = _labelled(labels).where("_fold IN (1, 2, 3)")
    order = F.xxhash64("doc_id")
    ids = known.where("_toxic = 1").orderBy(order, "doc_id").limit(SAMPLE).unionByName(known.where("_toxic = 0").orderBy(order, "doc_id").limit(SAMPLE))
    ids = ids.select(F.col("doc_id").alias("_id"), "_toxic", F.row_number().over(Window.partitionBy("_toxic").orderBy(order, "doc_id")).alias("_place"))  # 2 x SAMPLE rows
    sizes = {r[0]: r[1] for r in ids.groupBy("_toxic").agg(F.count("*")).collect()}
    share = F.col("_place") / F.when(F.col("_toxic") == 1, max(1, sizes.get(1, 0))).otherwise(max(1, sizes.get(0, 0)))
    rows = docs.select("doc_id", "text", "lang").join(F.broadcast(ids.withColumn("_share", share)), F.col("doc_id") == F.col("_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = Texts(), 0
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                for row in zip(*batch.slice(i, 500).to_pydict().values(), strict=True):
                    if size <= SAMPLE_BYTES and len(out.labels) < 2 * SAMPLE:
                        out.add(*row)
                        size += len(row[0] or "")
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Classifier(out))], pa.binary())], names=["model"])

    ordered = rows.repartition(1).sortWithinPartitions("_share", "doc_id", "text").select("text", "lang", "_toxic")
    found = ordered.mapInArrow(run, "model binary").collect()  # one model of fixed size
    return pickle.loads(found[0][0]) if found else Classifier(Texts())


def calibration_counts(docs: DataFrame, labels: DataFrame, model: Classifier) -> np.ndarray:
    """All labelled rows with f = 4 by guessed language, label and bin. Texts stay where they are; ids meet their labels."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                logits, langs = shared.value.logits(part.column(1).to_pylist(), cache)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.int64()), pa.array(binned(logits))], names=["doc_id", "lang", "bin"])

    scored = docs.where(F.col("doc_id").isNotNull() & (crc_mod("doc_id", 5) == 4)).select("doc_id", "text")
    scored = scored.mapInArrow(run, StructType([scored.schema["doc_id"], StructField("lang", LongType()), StructField("bin", LongType())]))
    found = scored.join(_labelled(labels).where("_fold = 4"), "doc_id").groupBy("lang", "_toxic", "bin").agg(F.count("*"))
    out = np.zeros((len(model.thresholds), 2, BINS), np.int64)
    for lang, toxic, bin_, n in found.collect():  # languages of the sample x 2 x BINS rows at most
        out[lang, toxic, bin_] = n
    return out


def train(docs: DataFrame, labels: DataFrame) -> Classifier:
    model = fitted(docs, labels)
    if model.network is not None:
        model.calibrate(calibration_counts(docs, labels, model))
    return model


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, held_out, score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(shared.value.scores(part.column(1).to_pylist(), cache))], names=["doc_id", "held_out", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text", (crc_mod("doc_id", 5) == 0).alias("held_out")).mapInArrow(run, "doc_id bigint, held_out boolean, score double")


def drop_toxic(docs: DataFrame, model: Classifier) -> DataFrame:
    """The rows of docs that score below one half, with all columns; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                yield part.filter(pa.array(shared.value.scores(part.column(at).to_pylist(), cache) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
