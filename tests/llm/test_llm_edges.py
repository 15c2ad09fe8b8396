"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator."""

from __future__ import annotations

import random
from collections import Counter
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cinderlake.llm import chat, decontaminate, exact_dedup, html_text, jaccard_join, language, lm_score, mixing, token_counts, toxicity
from cinderlake.llm.common import Filter

WORDS = [f"w{i}" for i in range(60)]
LONG = " ".join(random.Random(4).choices(WORDS, k=30_000))
ROWS = [
    (0, "b a\tc", "en", "src0"), (1, "b  a c", "en", "src0"), (2, None, None, None), (3, "", "en", "src1"), (4, " \n", "fr", "src1"), (5, LONG, "en", "src2"),
    (5, LONG, "en", "src2"), (None, "b a c", None, "x"), (None, "only here", "fr", None), (7, "only here too, a b c d e f g h i j", "fr", "src9"), (8, "1234 567", "en", "src2"),
]
CLASHING = ("node", "digest", "label", "n", "score", "row", "key", "epoch", "domain", "_hit_doc_id", "held_out", "size")


def frame(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumn("n_chars", F.length("text").cast("long")).withColumns({c: F.lit("x") for c in CLASHING})


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, i % 2) for i in range(9)] + [(1, 0, 1), (None, 1, 1), (3, None, None), (4, 1, 7)], "doc_id long, quality int, toxic int")


# exact dedup
def test_exact_groups(docs, none):
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(docs).collect())
    assert got == Counter([(0, 0, 3, True), (1, 0, 3, False), (2, 2, 2, True), (3, 2, 2, False), (4, 4, 1, True), (5, 5, 2, True), (5, 5, 2, True), (None, 0, 3, False), (None, None, 1, True), (7, 7, 1, True), (8, 8, 1, True)])
    assert exact_dedup.exact_groups(none).count() == 0


def test_filter_passes_all_its_keys(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("k"))
    held = Filter(keys, "k")
    assert held.passing(keys, "k").count() == 5000
    others = spark.range(10_000, 30_000).select(F.xxhash64("id").alias("k"), F.lit(1).alias("_bucket"))
    assert held.passing(others, "k").count() < 0.1 * 20_000 and held.passing(others, "k").columns == ["k", "_bucket"]
    assert Filter(keys.limit(0), "k").passing(others, "k").count() == 0


def test_exact_groups_tell_texts_of_one_digest_apart(docs):
    weak = lambda norm: F.substring(exact_dedup.text_digest(norm), 1, 1).bitwiseAND(F.lit(1)) if False else F.unhex(F.lpad(F.hex(F.length(norm) % 3), 2, "0"))
    key = lambda df: Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in df.collect())
    assert key(exact_dedup.exact_groups(docs, weak)) == key(exact_dedup.exact_groups(docs))


def test_drop_copies(docs, none):
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter([0, 2, 4, 5, None, 7, 8])
    assert exact_dedup.drop_copies(none).count() == 0


# Jaccard join
def brute_groups(rows, k, t):
    sets = []
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets.append((i, {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()))
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= t * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least: dict = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(s), least.get(find(i)) if s else d) for i, (d, s) in enumerate(sets))


def near_copies(seed: int, n: int, size: int, most: int) -> list:
    draw = random.Random(seed)
    base = [draw.choice(WORDS) for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(draw.randrange(most)):
            w[draw.randrange(size)] = draw.choice(WORDS + ["new%d" % draw.randrange(10**6)])
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("k", "t"), [(3, 90), (5, 80), (1, 60)])
def test_groups_of_near_copies(spark, docs, k, t):
    texts = [*near_copies(1, 40, 80, 6), *near_copies(2, 25, 30, 4), *near_copies(3, 12, 8, 3), *near_copies(5, 30, 6, 3)]
    line = " ".join(WORDS[:12])
    texts += [f"{' '.join(random.Random(i).choices(WORDS, k=10))} {line}" for i in range(40)]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(100 + i, x) for i, x in enumerate(texts)]
    got = jaccard_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), k, t)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute_groups(rows, k, t)


@pytest.mark.parametrize(("k", "t"), [(3, 90), (5, 80), (2, 50)])
def test_one_frequent_shingle_links(spark, k, t):
    texts = [" ".join(["ha"] * n) for n in range(k, k + 25)] + [" ".join(["ho"] * n) for n in range(k, k + 25)] + [f"{'ha ' * k}{i}" for i in range(25)]
    rows = list(enumerate(texts))
    got = jaccard_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), k, t)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute_groups(rows, k, t)


def test_blocks_do_not_change_groups(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    monkeypatch.setattr(jaccard_join, "RARE", 2)
    rows = list(enumerate([*near_copies(7, 40, 60, 7), *near_copies(8, 20, 25, 4)]))
    got = jaccard_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute_groups(rows, 3, 90)


@settings(max_examples=60, deadline=None)
@given(st.integers(5, 60), st.integers(0, 8), st.sampled_from([70, 80, 90]), st.integers(0, 10**6))
def test_linked_sets_share_a_key(n, edits, t, seed):
    draw = random.Random(seed)
    universe = [int(x) for x in np.random.default_rng(seed).integers(1, 2**62, 200)]
    x = draw.sample(universe, n)
    y = draw.sample(x, max(1, n - edits)) + draw.sample([u for u in universe if u not in x], draw.randrange(edits + 1))
    if 100 * len(set(x) & set(y)) < t * len(set(x) | set(y)):
        return
    df = {u: draw.choice([2, 3, 16, 17, 40, 5000]) for u in universe}

    def keys(s):
        s = sorted(set(s), key=lambda u: (df[u], u))
        return set(jaccard_join.keys_of(len(s), 0, np.array(s, np.uint64), np.array([df[u] for u in s]), t).tolist())

    assert keys(x) & keys(y)


def test_one_of_each(docs, none):
    out = jaccard_join.one_of_each(docs)
    assert out.columns == docs.columns and Counter(r["doc_id"] for r in out.collect()) == Counter([0, 2, 3, 4, 5, None, 7, 8])
    assert jaccard_join.one_of_each(none).count() == 0 and jaccard_join.similar_groups(none, 3, 90).count() == 0


def test_one_of_each_tells_rows_of_one_id_apart(spark):
    unique = [" ".join(f"u{j}x{i}" for i in range(12)) for j in range(5)]
    copy = " ".join(f"c{i}" for i in range(40))
    near = copy.replace("c39", "d39")
    rows = [(1, copy), (5, near), (5, unique[0]), (5, unique[1]), (None, unique[2]), (None, unique[3]), (None, copy), (7, unique[4]), (7, unique[4]), (8, ""), (8, None), (None, " ")]
    df = frame(spark, [(i, x, "en", "s") for i, x in rows]).withColumn("text_no", F.monotonically_increasing_id())
    out = jaccard_join.one_of_each(df)
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert out.columns == df.columns and got == Counter(dict.fromkeys([(1, copy), (5, unique[0]), (5, unique[1]), (None, unique[2]), (None, unique[3]), (7, unique[4]), (8, ""), (8, None), (None, " ")], 1))
    alone = frame(spark, [(None, copy, "en", "s"), (None, near, "en", "s"), (None, near, "en", "s")])
    assert jaccard_join.one_of_each(alone).count() == 1


def test_sequences_of_one_hash_are_told_apart(spark, monkeypatch):
    class Weak(jaccard_join.Shingler):  # the first hash of every sequence is one of three
        @staticmethod
        def hashes(words):
            node, check = jaccard_join.Shingler.hashes(words)
            return node % 3, check

    rows = list(enumerate([*near_copies(1, 20, 60, 5), *near_copies(2, 10, 20, 3), "a b", "a c", ""]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "Shingler", Weak)
    got = jaccard_join.similar_groups(df, 3, 90)
    want = brute_groups(rows, 3, 90)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == want
    assert {r["doc_id"] for r in jaccard_join.one_of_each(df, 3, 90).collect()} == {c for _, _, c in want}


# decontamination
@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "A, b c"), (2, " ".join(WORDS[:14])), (3, None), (4, "..."), (5, "here TOO"), (5, "1234"), (None, "567")], "item_id long, text string")


def brute_hits(text, items, window=10):
    w = decontaminate.words_of(text)
    hit, found = set(), set()
    for i, t in items:
        b = decontaminate.words_of(t)
        n = min(len(b), window)
        for s in range(len(b) - n + 1 if b else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == b[s : s + n]:
                    hit |= set(range(p, p + n))
                    found.add("" if i is None else str(i))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize(("shard", "block"), [(1 << 20, 1 << 21), (5, 3)])
def test_matches(spark, docs, benchmark, monkeypatch, shard, block):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard)
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    rows = [*ROWS, (20, f"x {' '.join(WORDS[2:14])} y {' '.join(WORDS[:10])} w10 w11 w13", "en", "s")]
    items = [tuple(r) for r in benchmark.collect()]
    got = decontaminate.find_matches(frame(spark, rows), benchmark).collect()
    want = Counter((r[0], *map(str, brute_hits(r[1], items))) for r in rows)
    assert Counter((r["doc_id"], str(r["n_words"]), str(r["n_hit"]), str(r["items"])) for r in got) == want
    longest = [m for r in got if r["doc_id"] == 20 for m in r["matches"] if m["item_id"] == "2"][0]
    assert (longest["first_word"], longest["n_words"]) == (1, 12) or longest["n_words"] == 12


def test_clean_documents(docs, none, benchmark, spark):
    kept = decontaminate.clean_documents(docs, benchmark)
    assert kept.columns == docs.columns and 7 not in {r["doc_id"] for r in kept.collect()}
    assert decontaminate.clean_documents(none, benchmark).count() == 0
    assert decontaminate.find_matches(docs, benchmark.limit(0)).where("n_hit > 0").count() == 0


def test_clean_documents_judges_each_row(spark, benchmark, monkeypatch):
    rows = [(None, f"x {' '.join(WORDS[:10])}"), (None, "clean one"), (3, f"{' '.join(WORDS[2:12])} y"), (3, "clean two"), (3, "clean two"), (4, None), (4, "1234")]
    for block in (1 << 21, 3):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
        out = decontaminate.clean_documents(frame(spark, [(i, x, "en", "s") for i, x in rows]), benchmark)
        assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter([(None, "clean one"), (3, "clean two"), (3, "clean two"), (4, None)])


def test_long_verbatim_matches_take_time_in_proportion():
    draw = random.Random(2)
    words = [f"v{draw.randrange(10**6)}".encode() for _ in range(60_000)]
    block = decontaminate.TestBlock([("a", words), ("b", words[100:140])], 10)
    hits, found = decontaminate.shard_matches([[b"x", *words, b"y"], words[110:130], [b"ha"] * 9], block)
    assert [len(h) for h in hits] == [60_000, 20, 0] and found == [{0: (1, 60_000), 1: (101, 40)}, {0: (0, 20), 1: (0, 20)}, {}]
    same = decontaminate.TestBlock([("a", [b"ha"] * 300)], 10)
    hits, found = decontaminate.shard_matches([[b"ha"] * 20_000], same)
    assert len(hits[0]) == 20_000 and found[0][0][1] == 300


# mixing
def test_shortage_goes_to_siblings_first(spark):
    rows = [(i, "x " * n, lang, s) for i, (n, lang, s) in enumerate([(10, "en", "src0"), (500, "en", "src4"), (500, "fr", "src0"), (500, "en", "src1")])]
    df = frame(spark, rows)
    supply = df.select(*mixing.leaf_columns(df), mixing.n_tokens(F.col("text")).alias("n")).groupBy(*mixing.LEAF).agg(F.sum("n").alias("supply"))
    got = {(r["domain"], r["lang"], r["source"]): r["budget"] for r in mixing.budgets(supply, {"domain": {"d0": 1, "d1": 1}, "lang": {"en": 1, "fr": 1}}, 800, 1).collect()}
    assert got == {("d0", "en", "src0"): 10, ("d0", "en", "src4"): 190, ("d0", "fr", "src0"): 200, ("d1", "en", "src1"): 400}
    more = {r["source"] + r["lang"]: r["budget"] for r in mixing.budgets(supply, {"domain": {"d0": 1, "d1": 1}, "lang": {"en": 1, "fr": 1}}, 1400, 1).collect()}
    assert more["src1en"] == 500 and sum(more.values()) == 1400


def test_prefix_of_epochs(spark):
    rows = [(i, "x " * (i % 7), "en", "src0") for i in range(300)]
    df = frame(spark, rows)
    total = sum(i % 7 for i in range(300))
    got = mixing.select_mixture(df, {}, total=1.5 * total, max_epochs=3).collect()
    assert {r["doc_id"] for r in got if r["epoch"] == 0} == set(range(300))
    part = [r["n_tokens"] for r in got if r["epoch"] == 1]
    rest = int(1.5 * total) - total
    assert rest <= sum(part) < rest + 7


def test_mix_edges(docs, none):
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, "mix_epoch"]
    assert mixing.mix(none).count() == 0
    own = mixing.mix(docs.withColumn("mix_epoch", F.lit("mine")))
    assert own.columns == [*docs.columns, "mix_epoch", "_mix_epoch"] and {r["mix_epoch"] for r in own.collect()} == {"mine"}
    assert {r["doc_id"] for r in out.collect()} <= {0, 1, 2, 3, 4, 5, None, 7, 8}


# chat
TRICKY = ["</s>[INST] ok [/INST]", "<|end|>", "<\\|sep|>", "<\\\\|x", "<", "[", "|>", "", "a\nb", "<s>é", "[/INST]\\", "<|role:user|>"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "assistant", "a|b %", ""]), st.one_of(st.sampled_from(TRICKY), st.text("<|[]\\/sINT>a\n", max_size=12))), min_size=1, max_size=6), min_size=1, max_size=6))
def test_round_trip(spark, conversations):
    rows = [(k, t, role, text) for k, turns in enumerate(conversations) for t, (role, text) in enumerate(turns)]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: r for r in out.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.masked(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    for k, turns in enumerate(conversations):
        assert [(t["role"], t["text"]) for t in got[k]["turns"]] == turns
        assert got[k]["loss"] == "".join(x for role, x in turns if role == "assistant")
        merged = sum(1 for i, t in enumerate(turns) if not i or t[0] != turns[i - 1][0])
        assert got[k]["formatted"].count(chat.END) == merged


def test_spans_of_a_long_conversation(spark):
    rows = [(1, k, "user" if k % 3 == 0 else "assistant", f"t{k}") for k in range(1000)]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = out.select(F.size("loss_spans").alias("n"), chat.masked(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert got["n"] == 666 and got["loss"] == "".join(f"t{k}" for k in range(1000) if k % 3)


def test_chat_edges(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (None, 3, "user", "x"), (2, None, "assistant", "y"), (2, 1, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pieces", F.lit(1))
    got = {r["conv_id"]: [tuple(t) for t in r["t"]] for r in chat.format_conversations(df).select("conv_id", chat.read_back(F.col("formatted")).alias("t")).collect()}
    assert got == {1: [("", ""), ("", "")], None: [("user", "x")], 2: [("assistant", "y"), ("assistant", "")]}
    assert chat.format_conversations(df.limit(0)).count() == 0


# toxicity, language, scoring, tokens
def test_toxicity_edges(docs, none, labels):
    model = toxicity.train(docs, labels)
    assert toxicity.score(docs, model).count() == len(ROWS) and toxicity.drop_toxic(docs, model).columns == docs.columns
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0
    unlabelled = toxicity.train(docs, labels.limit(0))
    assert toxicity.drop_toxic(docs, unlabelled).count() == len(ROWS)


def test_language_edges(docs, none):
    model = language.KernelRidge(*language.training_rows(docs))
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language.predict(docs, model).collect()]
    assert all(lang == "und" and s == 0 for i, lang, s in got if i in (2, 3, 4, 8)) and len(got) == len(ROWS)
    assert language.predict(none, language.KernelRidge(*language.training_rows(none))).count() == 0
    assert {r["lang_pred"] for r in language.predict(docs, language.KernelRidge([], [])).collect()} == {"und"}


def test_scoring_edges(docs, none):
    counted, model = lm_score.train(docs)
    got = lm_score.score(docs, counted, model).collect()
    assert len(got) == len(ROWS) and all(r["n_tokens"] == 1 for r in got if r["doc_id"] in (2, 3, 4))
    assert all(r["bits_per_byte"] is None for r in got if r["doc_id"] in (2, 3))
    twice = [r["score"] for r in got if r["doc_id"] == 5]
    assert len(twice) == 2 and twice[0] == twice[1]
    empty = lm_score.train(none)
    assert lm_score.score(none, *empty).count() == 0
    even = lm_score.score(docs, *empty).collect()
    assert [round(r["score"], 3) for r in even if r["doc_id"] == 3] == [round(-8 * np.log10(2), 3)]


def test_segments_are_the_text():
    for text in ("Ab, c\n d..", "", "...", "é\x00x  ", " a. B! c?\nD.. ", "\x00 a \x00", LONG):
        raw = text.encode()
        found, items = lm_score.segments(raw), lm_score.items_of(raw)
        assert b"".join(found).replace(lm_score.MARK, b"") == raw + lm_score.END
        assert [x[lm_score.CARRY :] for x in items] == found
        assert [lm_score.token_of(x) for x in items] == [*raw.lower().split(), lm_score.END_TOKEN]
        before = lm_score.START
        for x in items:
            assert x[: lm_score.CARRY] == before[-lm_score.CARRY :]
            before += x[lm_score.CARRY :]


def test_probabilities_of_texts_add_up_to_one_at_most(spark):
    draw = random.Random(1)
    rows = [(i, " ".join(draw.choices(["a", "aa", "aaa"], k=draw.randrange(1, 4)))) for i in range(300)]
    counted, model = lm_score.train(spark.createDataFrame(rows, "doc_id long, text string"))
    texts = ["".join(x) for n in range(11) for x in product("a ", repeat=n)]
    assert 0.5 < sum(10 ** model.log10(lm_score.items_of(t.encode())).sum() for t in texts) <= 1
    scored = lm_score.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), counted, model).collect()
    assert 0.5 < sum(10 ** r["score"] for r in scored) <= 1
    for start in (b"\xff\xff", b"\xff\xffa", b" a a", b"aa a"):  # the next byte, a token's or the text's end among them
        follow = [start + bytes((c,)) for c in range(256)]
        before = model.coded_log10([start])[0] if len(start) > lm_score.CARRY else 0
        p = 10 ** (model.coded_log10(follow) - before)
        assert p.sum() == pytest.approx(1, abs=1e-3)
        assert p[0xFF] > 0.1 or not start.endswith(b"a")


def test_no_segment_begins_another():
    texts = ["".join(x) for n in range(6) for x in product("a. \x00\t", repeat=n)]
    found = [[lm_score.coded(s) for s in lm_score.items_of(t.encode())] for t in texts]
    parts = {s for items in found for s in items}
    assert not any(s[:k] in parts for s in parts for k in range(lm_score.CARRY + 1, len(s)))
    assert len({b"".join(x) for x in found}) == len(texts)


def test_score_against_brute_force(spark):
    """Counts, contexts, mixing and token shares again, byte by byte and bit by bit in plain Python."""
    from collections import defaultdict
    from math import exp, log, log10
    from zlib import crc32

    draw = random.Random(9)
    some = lambda: "".join(draw.choice(["the", "a", "Cat", "sat. ", "é", "\x00", "  x"]) + draw.choice([" ", "\n", "", "\t "]) for _ in range(draw.randrange(12)))
    rows = [(i, some()) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    counted, model = lm_score.train(df)
    low, mask = 2**32 - 1, 2**64 - 1

    def slots(item):
        """(order, slot) for each order, and the bit, of every bit coded."""
        for i in range(lm_score.CARRY, len(item)):
            hashes = []
            for order in lm_score.ORDERS:
                if order > 0:
                    h = 0
                    for k in range(1, order + 1):
                        h = ((h + item[i - k] + 1) * 0x01000193 if i >= k else h + 0x3779) & low
                else:
                    first = lm_score.CARRY if order == 0 else 0
                    h = sum((item[j] + 1) * pow(0x100000001B3, j, 2**64) for j in range(first, i)) & mask
                    h = (((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 + i) & mask) >> 32
                h = (h * 0xCC9E2D51) & low
                hashes.append(h ^ (h >> 15))
            for half in (0, 1):
                nibble = item[i] >> 4 if half == 0 else item[i] & 15
                for bit in range(4):
                    place, at = (1 << bit) | (nibble >> (4 - bit)), []
                    for k, h in enumerate(hashes):
                        x = ((h if half == 0 else h ^ (((item[i] >> 4) + 1) * 0x85EBCA6B & low)) * 0x9E3779B1) & low
                        x = ((x ^ (x >> 16)) * 0x85EBCA6B) & low
                        at.append((k, (x >> (32 - model.bits[k])) * 16 + place))
                    yield at, half * 4 + bit, nibble >> (3 - bit) & 1

    seen, tokens, forms = defaultdict(lambda: [0, 0]), Counter(), Counter()
    for i, text in rows:
        if crc32(str(i).encode()) % 7 != 2:
            for item in lm_score.items_of(text.encode()):
                tokens[lm_score.token_of(item)] += 1
                forms[lm_score.form_of(item)] += 1
                for at, _, bit in slots(lm_score.coded(item)):
                    for slot in at:
                        seen[slot][bit] += 1
    n = sum(tokens.values())

    def log10_of(item):
        total, top = 0.0, 0
        for at, place, bit in slots(lm_score.coded(item)):
            x = [0.0 if slot not in seen else log((seen[slot][1] + lm_score.PRIOR) / (seen[slot][0] + lm_score.PRIOR)) or 1e-6 for slot in at]
            if place % 4 == 0:
                top = max((k + 1 for k in range(len(x)) if x[k]), default=0)
            gate = top * 2 + place // 4
            mixed = sum(float(model.mixer.weights[k][gate][place % 4]) * x[k] for k in range(len(x)))
            bucket = int((min(max(mixed, -lm_score.LIMIT), lm_score.LIMIT) + lm_score.LIMIT) * (lm_score.BUCKETS - 1) / (2 * lm_score.LIMIT) + 0.5)
            p = (1 / (1 + exp(-mixed)) + float(model.refined[(gate * 4 + place % 4) * lm_score.BUCKETS + bucket])) / 2
            total += log10(min(max(p if bit else 1 - p, 1e-6), 1 - 1e-6))
        form = lm_score.form_of(item)
        share = forms[form] / sum(c for f, c in forms.items() if f >= 0 and f // 6 == form // 6) if form >= 0 else 0
        return log10((1 - lm_score.SHARE) * 10**total + lm_score.SHARE * share * tokens[lm_score.token_of(item)] / n)

    got = {r["doc_id"]: r for r in lm_score.score(df, counted, model).collect()}
    for i, text in rows:
        want = sum(map(log10_of, lm_score.items_of(text.encode())))
        assert got[i]["score"] == pytest.approx(want, rel=2e-3, abs=2e-3)
        assert got[i]["bits"] == pytest.approx(-got[i]["score"] * np.log2(10)) and got[i]["n_bytes"] == len(text.encode())


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 6), max_size=12), st.lists(st.integers(0, 40), max_size=5), st.sampled_from(token_counts.RULES))
def test_attribution(sizes, cuts, rule):
    ends = np.cumsum(sizes).astype(np.int64)
    n = int(ends[-1]) if len(ends) else 0
    borders = np.unique([0, n, *[c for c in cuts if c < n]]) if n else np.array([0, 0])
    counts, crossing = token_counts.attribute(ends, borders, rule)
    want, cross = np.zeros(len(borders) - 1), np.zeros(len(borders) - 1, int)
    for a, b in zip([0, *ends[:-1]] if len(ends) else [], ends, strict=True):
        inside = np.array([max(0, min(b, z) - max(a, y)) for y, z in zip(borders, borders[1:], strict=False)])
        touched = np.flatnonzero(inside)
        if len(touched) > 1:
            cross[touched] += 1
        share = {"start": touched[0], "end": touched[-1], "majority": inside.argmax()}.get(rule)
        if share is None:
            want += inside / inside.sum()
        else:
            want[share] += 1
    assert counts == pytest.approx(want) and crossing.tolist() == cross.tolist()


def test_token_edges(docs, none):
    got = token_counts.section_tokens(docs).collect()
    assert [(r["section"], r["end_char"], r["n_tokens"]) for r in got if r["doc_id"] == 2] == [(0, 0, 0)]
    assert sum(r["n_tokens"] for r in got if r["doc_id"] == 4) > 0 and max(r["end_char"] for r in got if r["doc_id"] == 5) == len(LONG)
    assert token_counts.section_tokens(none).count() == 0


# HTML
def page(body: str) -> str:
    return f"<html><head><title>t</title></head><body>{body}</body></html>"


def test_templates_recur_on_a_host(spark):
    rows = [(i, f"https://a.org/{i}", page(f"<div><div>Our shop <b>sells</b> things</div><p>Text number {i} &amp; more</p><div>Follow us</div></div>")) for i in range(8)]
    rows += [(20, "http://b.org/x", page("<div>Our shop <b>sells</b> things</div><p>Other</p>")), (None, None, None), (21, "?", "just text &lt;b&gt;"), (21, "?", "just text &lt;b&gt;")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"row": F.lit(1), "host": F.lit(2), "template": F.lit(3)})
    got = Counter((r["page_id"], r["text"]) for r in html_text.extract(df).collect())
    want = Counter({(i, f"Text number {i} & more"): 1 for i in range(8)})
    want.update({(20, "Our shop sells things\nOther"): 1, (None, ""): 1, (21, "just text <b>"): 2})
    assert got == want
    assert html_text.extract(df.limit(0)).count() == 0


def test_template_of_a_section_of_a_large_host(spark):
    rows = [(i, f"https://a.org/{i}", page(f"<div>{'<div>Sale in our shop</div>' if i % 10 == 0 else ''}<div>Text number {i}</div></div>")) for i in range(600)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Text number {i}" for i in range(600)}


def test_names_do_not_take_the_article_itself():
    text = "<p>One two three four five six seven.</p><p>Eight nine ten eleven.</p>"
    want = "One two three four five six seven.\nEight nine ten eleven."
    for kind in ("post legal", "notice", "comments"):
        assert html_text.main_text(f'<nav>a b</nav><article class="{kind}">{text}</article><footer>c</footer>') == want
        assert html_text.main_text(f'<div class="{kind}"><article>{text}</article></div><div class="sidebar">x y</div>') == want
        assert html_text.main_text(f'<div class="{kind}">{text}</div>') == want  # else nothing would be left
    assert html_text.main_text(f'<article>{text}</article><div class="comments">{"<p>Long talk of readers.</p>" * 20}</div>') == want
    assert html_text.main_text('<nav><a href="x">only links</a></nav>') == ""


def test_headers_in_the_main_block_stay():
    assert html_text.main_text('<header>Site</header><div id="content"><p>one two three</p><header><h1>Title</h1></header><p>four five</p></div>') == "one two three\nTitle\nfour five"
    assert html_text.main_text('<div id="content"><p>a</p><header><h1>Title</h1></header><p>b</p></div>') == "a\nTitle\nb"


def test_parts_that_are_no_main_text():
    body = """<header>Site</header><nav><ul><li>Home</ul></nav><div class="cookie-banner">We use cookies</div><main><article><h1>Title</h1>
    <p>One<br>two <b>three</b><p>Four&nbsp;five<script>var x = "<p>no</p>";</script><form><input>Mail</form><ul><li>a<li>b</ul>
    <section id="comments"><p>first!</p></section></article></main><aside>Side</aside><div class="ad">Buy</div><!-- <p>no</p> --><footer>(c)</footer>"""
    assert html_text.main_text(page(body)) == "Title\nOne two three\nFour five\na\nb"
    assert html_text.main_text("") == "" and html_text.main_text("<p>a<div>b") == "a\nb"
    assert html_text.main_text('<div class="header">Top</div><div data-id="nav" width=3>in</div><div hidden>no</div><div aria-hidden="true">no</div>') == "in"
    assert html_text.main_text("<div>" * 3000 + "deep") == "deep"


def test_templates_alone_find_the_main_text(spark):
    """No article, no telling tag or name, and no text of the menus recurs: only their skeletons do."""
    draw = random.Random(3)
    some = lambda n: " ".join(draw.choices(WORDS, k=n))
    rows, want = [], {}
    for i in range(12):
        parts = [some(30) for _ in range(draw.randrange(2, 5))]
        top = "".join(f'<div><a href="/{k}">{some(2)}</a></div>' for k in range(draw.randrange(3, 7)))
        rows.append((i, f"https://a.org/{i}", page(f"<div>{top}</div><span>Share this</span><div>{some(6)}</div><div>{''.join(f'<p>{x}</p>' for x in parts)}</div><div><i>{some(4)}</i></div>")))
        want[i] = "\n".join(parts)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_text.extract(df).collect()} == want
    assert all(len(html_text.main_text(h)) > len(want[i]) for i, _, h in rows)


def test_both_ways_to_the_templates_agree(spark, data, monkeypatch):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    key = lambda df: Counter(map(tuple, df.collect()))
    near = key(html_text.extract(pages, 2))
    monkeypatch.setattr(html_text, "BROADCAST", 0)
    assert key(html_text.extract(pages, 2)) == near


def test_driver_pages_have_templates(spark, data):
    rows = spark.read.parquet(f"{data}/pages.parquet").select(F.xxhash64("url").alias("row_a"), F.xxhash64("html").alias("row_b"), F.xxhash64(html_text.host_of(F.col("url"))).alias("host"), "html")
    assert html_text.templates(rows, 2)[0].count() > 0


def test_broken_markup():
    read = html_text.main_text
    assert read("<p title=it's>hello</p><p>there's more</p>") == "hello\nthere's more"
    assert read("<p title='a>b' id=x/y>hello") == "hello" and read('<p title="open>hello</p><p>next</p>') == "hello\nnext"
    assert read("<div>" * 1000 + "<nav>MENU</nav>text") == "text"
    assert read('<article><div class="social-science">a</div><table class="table-legal"><tr><td>b</table><div class="share-buttons">c</div><div class="comments">d</div></article>') == "a\nb"
    assert read("<article><p>teaser</p></article><div><p>A text that is much longer than the teaser above it.</p></div>") == "teaser\nA text that is much longer than the teaser above it."
    assert read("<main><article><p>long enough text</p></article><p>x</p></main>y") == "long enough text"
    assert read("a<!-- open") == "a" and read("a<!-->b<!x>c<?php?>d") == "abcd" and read("1 < 2 <3") == "1 < 2 <3"
    assert read("<script>x</script >a<style>") == "a" and read("<b") == ""


def test_broken_markup_takes_time_in_proportion():
    import time

    for text in ('<a href="', "<p><li><b>", "<b><p>", "</x><y>", "<!--", "<script", "<a href='x' =", "<div><div", "<p title= "):
        began = time.process_time()
        nodes = html_text.parse(text * 40_000)
        html_text.measure(nodes)
        assert time.process_time() - began < 10, text
