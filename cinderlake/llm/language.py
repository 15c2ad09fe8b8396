"""Operator 5, language ID: a blended-spectrum string kernel, Nystroem landmarks, one-versus-rest ridge regression.

The kernel of two texts is the number of byte n-grams (n = 2, 3, 4, hashed to DIM places each) present in both, over
the root of the product of their own numbers, averaged over n. Landmarks are training texts; a text's features are
its kernel values to them times the inverse root of the landmarks' own kernel matrix, and one ridge regression per
language is solved on those. Scoring is two matrix products per batch of texts, over whole texts, without a shuffle.

Training reads only text and lang of rows with a language whose crc32(doc_id) mod 5 is not 0, and of those a bounded
sample: PER_LANGUAGE rows a language by a hash of doc_id (SAMPLE_ROWS over all), SAMPLE_BYTES of text.

Defined results: null texts and texts without a letter are 'und' with score 0; so are all texts if no language can be
learned. Where only one language is known it is predicted with score 1. Ties go to the language first in order.
Repeated rows are predicted each; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlake.llm.common import crc_mod, table

GRAMS, DIM = (2, 3, 4), 4096
PER_LANGUAGE, SAMPLE_ROWS, SAMPLE_BYTES = 1_000, 20_000, 64_000_000
LANDMARKS, RIDGE, SHARPNESS = 256, 1e-3, 6.0
_LETTER = re.compile(r"[^\W\d_]")
#: Letters in lower case and all bytes from 0x80; the rest is a space.
_LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256)).lower()


def presence(texts: list[str], out: np.ndarray | None = None) -> np.ndarray:
    """0/1 rows of the n-grams present in each text, one block of DIM for each n, each block scaled by its root count."""
    x = np.zeros((len(texts), len(GRAMS) * DIM), np.float32) if out is None else out[: len(texts)]
    x[:] = 0
    for row, text in zip(x, texts, strict=True):
        plain = b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_LETTERS).split())
        b = np.frombuffer(b" " + plain + b" ", np.uint8).astype(np.uint32)
        for k, n in enumerate(GRAMS):
            if len(b) < n:
                continue
            code = b[: len(b) - n + 1].copy()
            for i in range(1, n):
                code *= np.uint32(257)
                code += b[i : len(b) - n + 1 + i]
            code *= np.uint32(0x9E3779B1)
            row[k * DIM + (code >> np.uint32(20))] = 1
    for k in range(len(GRAMS)):
        part = x[:, k * DIM : (k + 1) * DIM]
        part /= np.sqrt(np.maximum(part.sum(1, keepdims=True), 1) * len(GRAMS))
    return x


class KernelRidge:
    def __init__(self, texts: list[str], langs: list[str]):
        self.names = sorted(set(langs))
        if len(self.names) < 2:
            return
        own = np.array([self.names.index(x) for x in langs])
        each = max(2, LANDMARKS // len(self.names))
        marks = np.concatenate([np.flatnonzero(own == k)[:each] for k in range(len(self.names))])
        self.marks = presence([texts[i] for i in marks])
        values, vectors = np.linalg.eigh((self.marks @ self.marks.T).astype(np.float64))
        keep = values > 1e-6 * values[-1]
        root = vectors[:, keep] / np.sqrt(values[keep])
        features = np.concatenate([presence(texts[i : i + 256]) @ self.marks.T for i in range(0, len(texts), 256)]).astype(np.float64) @ root
        target = np.where(own[:, None] == np.arange(len(self.names)), 1.0, -1.0)
        self.offset = target.mean(0)
        weigh = (len(own) / len(self.names) / np.bincount(own, minlength=len(self.names)))[own][:, None]  # languages count alike
        gram = features.T @ (weigh * features) + RIDGE * len(own) * np.eye(features.shape[1])
        self.weights = (root @ np.linalg.solve(gram, features.T @ (weigh * (target - self.offset)))).astype(np.float32)
        self.offset = self.offset.astype(np.float32)

    def predict(self, texts: list[str | None], buffer: np.ndarray) -> tuple[list[str], np.ndarray]:
        known = np.array([bool(t and _LETTER.search(t)) for t in texts], bool)
        if not self.names:
            return ["und"] * len(texts), np.zeros(len(texts))
        if len(self.names) == 1:
            return [self.names[0] if k else "und" for k in known], known.astype(float)
        raw = ((presence(texts, buffer) @ self.marks.T) @ self.weights + self.offset).astype(np.float64)
        share = np.exp(SHARPNESS * (raw - raw.max(1, keepdims=True)))
        best = raw.argmax(1)
        return [self.names[k] if ok else "und" for k, ok in zip(best, known, strict=True)], np.where(known, share.max(1) / share.sum(1), 0.0)


def training_rows(docs: DataFrame) -> tuple[list[str], list[str]]:
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", 5) != 0))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.count("*")).orderBy(F.desc("count(1)"), "lang").limit(SAMPLE_ROWS // 10).collect()}
    if not counts:
        return [], []
    each = max(10, min(PER_LANGUAGE, SAMPLE_ROWS // len(counts)))
    wanted = docs.sparkSession.createDataFrame([(lang, min(1.0, 1.3 * each / n)) for lang, n in counts.items()], "_lang string, _share double")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1e6
    some = rows.join(F.broadcast(wanted), F.col("lang") == F.col("_lang")).where(place < F.col("_share")).select(place.alias("_place"), "doc_id", "text", "lang")
    texts, langs, held, size = [], [], dict.fromkeys(counts, 0), 0
    for row in some.orderBy("_place", "doc_id", "text").toLocalIterator():
        if held[row[3]] < each and size < SAMPLE_BYTES:
            held[row[3]] += 1
            size += len(row[2])
            texts.append(row[2])
            langs.append(row[3])
    return texts, langs


def predict(docs: DataFrame, model: KernelRidge) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer = np.zeros((256, len(GRAMS) * DIM), np.float32)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                lang, score = shared.value.predict(part.column(1).to_pylist(), buffer)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", (crc_mod("doc_id", 5) == 0).alias("held_out"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, KernelRidge(*training_rows(docs)))
