"""Operator 8, token counts: tokens of whole documents attributed to their sections by offsets.

Each document is encoded once. Byte lengths of the tokens give their spans, section borders give others, and an
interval join by binary search within the document counts tokens for each section. A token across a border goes by
the rule: 'start' (where its first byte lies), 'end' (its last byte), 'majority' (most of its bytes, the earlier
section on ties) or 'fraction' (shares by bytes). Under each rule the sections' counts sum to the document's tokens.

Sections are lines; a line's feed belongs to it. The vocabulary is a file of token ranks, read on the driver and
broadcast (one file of known size), so executors need no local copy; TOKENIZER is only the default path.

Defined results: a null or empty text has one empty section without tokens. Repeated rows are counted each. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlake.llm.common import table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public pre-tokenisation pattern of this vocabulary, a fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("start", "end", "majority", "fraction")


class Encoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)

    def ends(self, text: str) -> np.ndarray:
        """Byte offsets where the tokens of text end."""
        return np.cumsum(self.sizes[self.encoding.encode_ordinary_batch([text], num_threads=1)[0]]) if text else np.zeros(0, np.int64)


def read_ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


def line_borders(raw: bytes) -> np.ndarray:
    """Byte offsets of section borders, from 0 to the length."""
    feeds = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return np.unique(np.concatenate([[0], feeds, [len(raw)]])) if raw else np.array([0, 0])


def attribute(ends: np.ndarray, borders: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens for each section, and for each section the tokens that lie in it only in part."""
    n = len(borders) - 1
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    first = np.searchsorted(borders, starts, side="right") - 1
    last = np.searchsorted(borders, ends - 1, side="right") - 1
    crossing = np.zeros(n, np.int64)
    across = np.flatnonzero(last > first)
    for i in across:
        crossing[first[i] : last[i] + 1] += 1
    if rule == "start":
        return np.bincount(first, minlength=n).astype(float), crossing
    if rule == "end":
        return np.bincount(last, minlength=n).astype(float), crossing
    counts = np.bincount(first[last == first], minlength=n).astype(float)
    for i in across:
        cuts = np.concatenate([[starts[i]], borders[first[i] + 1 : last[i] + 1], [ends[i]]])
        bytes_in = np.diff(cuts)
        if rule == "fraction":
            counts[first[i] : last[i] + 1] += bytes_in / bytes_in.sum()
        else:
            counts[first[i] + bytes_in.argmax()] += 1
    return counts, crossing


def section_tokens(docs: DataFrame, rule: str = "start", tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, section, start_char, end_char, n_tokens, n_crossing for each section of each row."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sizes, columns = [], [[], [], [], [], []]
                for text in part.column(1).to_pylist():
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    borders = line_borders(raw)
                    counts, crossing = attribute(encoder.ends(text or ""), borders, rule)
                    b = np.frombuffer(raw, np.uint8)
                    chars = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])[borders]
                    sizes.append(len(counts))
                    for column, value in zip(columns, (np.arange(len(counts)), chars[:-1], chars[1:], counts, crossing), strict=True):
                        column.append(value)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                flat = [pa.array(np.concatenate(c)) if c else pa.array([], pa.int64()) for c in columns]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), *flat], names=["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, section bigint, start_char bigint, end_char bigint, n_tokens double, n_crossing bigint")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(table(spark, sf_dir, "documents")).withColumn("n_tokens", F.col("n_tokens").cast("long"))
