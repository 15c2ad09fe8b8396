"""Alignment of two tokenizers against whole documents encoded one by one."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from hashlib import sha256
from pathlib import Path

import pytest

from cinderlake.llm import cross_tokens, registry


@pytest.fixture(scope="module")
def both():
    return cross_tokens.Aligner(Path(cross_tokens.TOKENIZER_A).read_text(), Path(cross_tokens.TOKENIZER_B).read_bytes())


def spans(pieces):
    at = 0
    for p in pieces:
        yield at, at + len(p)
        at += len(p)


def plain(both, texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each text, each encoded whole; overlaps by their spans."""
    made = []
    for text in texts:
        if not text:
            made.append(None)
            continue
        a, b = both.a.encode(f" {text}", add_special_tokens=False).ids, both.b.encode(text)
        bytes_a, bytes_b = [both.a_bytes[x] for x in a], [both.b_bytes[x] for x in b]
        if b"".join(bytes_a) != f" {text}".encode() or b"".join(bytes_b) != f" {text}".encode():
            made.append(None)
            continue
        on_a, on_b = list(spans(bytes_a)), list(spans(bytes_b))
        links, j = [], 0
        for i, (s, e) in enumerate(on_a):
            while on_b[j][1] <= s:
                j += 1
            links += [(a[i], b[k]) for k in range(j, len(b)) if on_b[k][0] < e] if len(b) < 60 else [(a[i], b[k]) for k in range(j, min(len(b), j + e - s)) if on_b[k][0] < e]
        ends = sorted({e for _, e in on_a} & {e for _, e in on_b})
        of = lambda ids, at, lo, hi: ",".join(str(x) for x, (s, _) in zip(ids, at, strict=True) if lo <= s < hi)
        if len(a) > 400:  # the same, in one walk
            groups, x, y = [], 0, 0
            for hi in ends:
                p, q = x, y
                while x < len(a) and on_a[x][0] < hi:
                    x += 1
                while y < len(b) and on_b[y][0] < hi:
                    y += 1
                groups.append(f"{','.join(map(str, a[p:x]))}|{','.join(map(str, b[q:y]))}")
        else:
            groups = [f"{of(a, on_a, lo, hi)}|{of(b, on_b, lo, hi)}" for lo, hi in zip([0, *ends], ends, strict=False)]
        made.append((len(a), len(b), len(groups), links, ";".join(groups)))
    count = Counter(p for m in made if m for p in set(m[3]))
    highest = defaultdict(int)
    for (x, _), n in count.items():
        highest[x] = max(highest[x], n)
    return [(m[0], m[1], m[2], len(m[3]), sum(count[p] == highest[p[0]] for p in m[3]), sum(count[p] for p in m[3]), m[4]) if m else (0, 0, 0, 0, 0, 0, "") for m in made]


def rows_of(df):
    return sorted(tuple(str(x) for x in (r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups"])) for r in df.collect())


def test_tokens_that_go_on_with_a_space(both):
    assert both.joined == {0xA0}  # no-break spaces, so "à la" stays together too


def test_segments_hold_the_text(both):
    for text in ("a b  c\n d \n\n e", "   ", "x", " x ", "é  y  z", "a\t b\x1c c"):
        found = both.segments(text)
        assert " ".join(found) == text and all(found)
    assert both.segments("a b  c\n d  e") == ["a", "b", " c\n d", " e"]
    assert both.segments("voilà la mer") == ["voilà la", "mer"]
    assert both.segments("a b ") == ["a", "b "] and both.segments(" a\x85 b") == [" a\x85 b"]


def strange(draw, n):
    bits = ["the", "don't", "we'll", " ", "  ", "\n", "\n\n", "\t", "\r\n", "1984", "3.14", "été", "straße", "日本語", "😀", "é", " ", " ", "​", "<s>", "</s>", "<0x41>", "<|endoftext|>", "<unk>", "\x00", "\x1c", "﻿", "ﬁ", "...", "!?", "-", "_", "Ünïcode", "aaaaaaaa", "ИВАН", "A"]
    return ["".join(draw.choices(bits, k=draw.randrange(1, 30))) for _ in range(n)]


@pytest.mark.parametrize(("hot", "pairs"), [(cross_tokens.HOT, cross_tokens.PAIRS), (1500, 40), (0, 0)])
def test_strange_texts(spark, both, hot, pairs):
    draw = random.Random(7)
    texts = [None, "", " ", "   ", "\n", "x", " x", "x ", "x▁ y", "a ▁ b", *strange(draw, 250)]
    texts += texts[:60]
    rows = [(i % 200 if i % 7 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "1 AS groups", "'k' AS k1", "2 AS segment", "3 AS n_a")
    want = sorted(tuple(str(x) for x in (i, *m)) for (i, _), m in zip(rows, plain(both, texts), strict=True))
    assert rows_of(cross_tokens.cross_align(docs, hot=hot, pairs=pairs)) == want


def test_query_against_whole_documents(spark, data, both):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in registry.queries()["op11_cross_tokens"](spark, data).collect()}
    want = {i: (*m[:-1], m[-1] and sha256(m[-1].encode()).hexdigest()) for (i, _), m in zip(docs, plain(both, [t for _, t in docs]), strict=True)}
    assert got == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert cross_tokens.cross_align(docs).count() == 0
