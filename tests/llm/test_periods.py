"""Periodic runs: grid and hashes against all periods tried word by word; defined results."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cinderlake.llm import periods


def plain(words, least=6, times=4):
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(words, runs):
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    return [w for i, w in enumerate(words) if i not in gone]


def worked(texts):
    return [([tuple(r) for r in runs.tolist()], text.split()) for runs, text in periods._worked(texts, 6, 4)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60), min_size=1, max_size=4))
def test_against_plain(texts):
    for words, (runs, text) in zip(texts, worked(texts), strict=True):
        assert runs == plain(words) and text == collapsed(words, runs)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from([b"a", b"b"]), min_size=1, max_size=4), st.integers(1, 9)), max_size=6))
def test_planted_repeats(parts):
    words = [w for unit, times in parts for w in unit * times]
    ((runs, text),) = worked([words])
    assert runs == plain(words) and text == collapsed(words, runs)


def test_one_word_many_times_and_thue_morse():
    (runs, text), (none, whole) = worked([[b"x"] * 50_000, [b"ab"[bin(i).count("1") % 2 : bin(i).count("1") % 2 + 1] for i in range(4096)]])
    assert runs == [(0, 50_000, 1)] and text == [b"x"]
    assert none == [] and len(whole) == 4096  # a word without cubes, on which sums modulo 2^64 collide


def test_a_stretch_that_does_not_hold_is_found_out():
    words = np.array([0, 1, 0, 1, 0, 1, 0, 2])
    assert periods.verified(words, np.array([[0, 8, 2]])) is None
    assert periods.verified(words, np.array([[0, 7, 2], [0, 7, 3]])) is None
    assert periods.verified(words, np.array([[0, 7, 2]])).tolist() == [[0, 7, 2]]


def test_hashes_that_collide_are_worked_again(monkeypatch):
    draw, real = random.Random(3), periods.Prefix.equal
    words = [draw.choice([b"a", b"b", b"c"]) for _ in range(200)] + [b"p", b"q", b"r"] * 9
    bad = [40]

    def often_equal(self, i, j, size):
        bad[0] -= 1
        return real(self, i, j, size) | (bad[0] > 0) & (size < 40)

    monkeypatch.setattr(periods.Prefix, "equal", often_equal)
    ((runs, _),) = worked([words])
    assert runs == plain(words)


def test_chunks_of_pairs(monkeypatch):
    monkeypatch.setattr(periods, "CHUNK", 7)
    draw = random.Random(5)
    texts = [[draw.choice([b"a", b"b"]) for _ in range(n)] for n in (0, 90, 1, 40)]
    assert [r for r, _ in worked(texts)] == [plain(ws) for ws in texts]


def test_nulls_blanks_repeats_and_other_numbers(spark, monkeypatch):
    monkeypatch.setattr(periods, "PIECE", 20)
    rows = [(1, "a b " * 4), (1, "a b " * 4), (2, None), (3, " \n"), (None, "x " * 6), (4, "é ü\té ü é\x0bü é ü  z"), (5, "x x x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'y' AS runs", "'z' AS n_words")
    got = sorted((str(r["doc_id"]), r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periods.periodic_runs(docs).collect())
    assert got == sorted([("1", 8, [(0, 8, 2)], "a b"), ("1", 8, [(0, 8, 2)], "a b"), ("2", 0, [], ""), ("3", 0, [], ""), ("None", 6, [(0, 6, 1)], "x"), ("4", 9, [(0, 8, 2)], "é ü z"), ("5", 3, [], "x x x")])
    assert periods.periodic_runs(docs.limit(0)).count() == 0
    cubes = periods.periodic_runs(docs, least=3, times=3).where("doc_id = 5").first()
    assert [tuple(x) for x in cubes["runs"]] == [(0, 3, 1)] and cubes["collapsed"] == "x"
    with pytest.raises(ValueError):
        periods.periodic_runs(docs, times=2)


def test_planted_words(spark):
    from zlib import crc32

    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(i % 23)) or None) for i in range(300)] + [(None, "a b c d e f g h")], "doc_id long, text string")
    for r in periods.planted(docs).collect():
        i = r["doc_id"]
        words = [f"w{k}" for k in range(i % 23)] if i is not None else "a b c d e f g h".split()
        h = crc32(str(i).encode() if i is not None else b"")
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        assert (r["text"] or "").split() == words
