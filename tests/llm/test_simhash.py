"""Golay keys, fingerprints, and components of fingerprints against all pairs."""

from __future__ import annotations

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from cinderlake.llm import registry, simhash


def plain_fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(prints):
    """Least index reachable, by all pairs."""
    values = sorted(set(prints))
    parent = {v: v for v in values}

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    array = np.array(values, np.uint64)
    for i, v in enumerate(values):
        apart = np.unpackbits((array[i + 1 :] ^ array[i]).view(np.uint8).reshape(-1, 8), axis=1).sum(1)
        for j in np.flatnonzero(apart <= 2):
            a, b = top(v), top(values[i + 1 + j])
            parent[max(a, b)] = min(a, b)
    return [top(v) for v in prints]


def test_golay_indices():
    golay = simhash.Golay()
    words = np.arange(1 << 23, dtype=np.int64)[:: (1 << 23) // 5000]
    near = golay.indices(words)
    assert set((near >= 0).sum(1)) == {1, 6}
    codes = np.array([i << 11 | simhash.remainder(i << 11) for i in range(4096)])
    for w, found in zip(words[:200], near[:200], strict=True):
        assert {c >> 11 for c in codes.tolist() if bin(c ^ int(w)).count("1") <= 4} == set(found[found >= 0].tolist())


def test_any_two_errors_share_a_key():
    golay, draw = simhash.Golay(), random.Random(1)
    for x in [0, (1 << 64) - 1, *(draw.getrandbits(64) for _ in range(4))]:
        others = [x ^ (1 << a) ^ (1 << b if b != a else 0) for a in range(64) for b in range(a, 64)]
        keys, rows = simhash.keys_of(golay, np.array([x, *others], np.uint64))
        mine = keys[rows == 0]
        assert set(rows[np.isin(keys, mine)].tolist()) == set(range(len(others) + 1)) and len(mine) <= 18


def test_fingerprints(spark):
    draw = random.Random(2)
    texts = [None, "", " \t", "One", "a b", "A B\nc", "é É ü " * 3, *(" ".join(draw.choices("abcdefgh", k=n)) for n in (2, 3, 4, 50, 70_000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("fp", F.lit("x"))
    got = {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in simhash.fingerprints(docs).collect()}
    assert got == {i: plain_fingerprint(t) for i, t in enumerate(texts)}


def close(draw, n):
    out = []
    for _ in range(n):
        base = draw.getrandbits(64)
        out.append(base)
        for _ in range(draw.randrange(6)):
            base ^= 1 << draw.randrange(64) ^ (draw.randrange(2) and 1 << draw.randrange(64))
            out.append(base & (1 << 64) - 1)
    return out


def test_components_of_fingerprints(spark):
    draw = random.Random(3)
    crowded = [draw.getrandbits(64)] * 1
    crowded += [crowded[0] ^ sum(1 << draw.randrange(64) for _ in range(draw.randrange(1, 4))) & (1 << 64) - 1 for _ in range(600)]
    prints = [0, 1, (1 << 64) - 1, *close(draw, 300), *(x & (1 << 64) - 1 for x in crowded)]
    want = plain_groups(prints)
    distinct = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in set(prints)], "fp long")
    for crowd in (4, 64, 10_000):
        labels = {r["node"] & (1 << 64) - 1: r["label"] for r in simhash.components(simhash.links(distinct, crowd)).collect()}
        got = [labels.get(x, x - (1 << 64) if x >> 63 else x) for x in prints]
        pair = {}
        for g, w in zip(got, want, strict=True):
            assert pair.setdefault(w, g) == g
        assert len(set(got)) == len(set(want))


def test_query_against_all_pairs(spark, data):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in registry.queries()["op13_simhash_neardup"](spark, data).collect()}
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect())
    prints = [plain_fingerprint(t) for _, t in docs]
    least = {}
    groups = plain_groups(prints)
    for (i, _), g in zip(docs, groups, strict=True):
        least.setdefault(g, i)
    assert got == {i: (f"{x:016x}", least[g]) for (i, _), x, g in zip(docs, prints, groups, strict=True)}
    assert len(set(least.values())) < len(docs)


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(3, None), (2, ""), (2, ""), (None, " "), (None, "only this one text"), (7, "a b c d"), (5, "A  b c d"), (None, "a b c d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS component_id", "'x' AS fingerprint", "2 AS least")
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in simhash.near_duplicates(docs).collect())
    assert got == sorted([("3", "2"), ("2", "2"), ("2", "2"), ("None", "2"), ("None", "None"), ("7", "5"), ("5", "5"), ("None", "5")])
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
