"""Registered queries of the training-data operators against SQL, or against brute force where SQL cannot express them."""

from __future__ import annotations

import math
from collections import Counter
from zlib import crc32

import pytest

from cinderlake.llm import registry
from tests.compare import duck_rows, spark_rows

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, data, name):
    assert spark_rows(registry.queries()[name](spark, data)) == duck_rows(duck, SQL[name])


def test_guarded_registry(spark):
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries())
    assert sorted(n for n in entry.queries() if n.startswith("op")) == sorted(n for n in registry.queries() if n != "pipeline")


def test_op2_base_score_counts_and_model(spark, data):
    got = {r["doc_id"]: r for r in registry.queries()["op2_lm_score"](spark, data).collect()}
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    tokens = {i: [*t.encode().lower().split(), "end"] for i, t in docs}
    held = {i: crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    assert set(got) == set(tokens)
    for i, ws in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(w in c for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
        assert r["score"] < 0
    text = dict(docs)
    even = sum(-8 * math.log10(2) * (len(text[i].encode()) + 1) for i in text if held[i])
    assert sum(r["score"] for i, r in got.items() if held[i]) > 0.5 * even  # far better than even bits


def test_op2_sees_the_order_of_words(spark, data):
    import random

    from cinderlake.llm import lm_score

    docs = spark.read.parquet(f"{data}/documents.parquet")
    counted, model = lm_score.train(docs)
    draw, rows = random.Random(5), []
    for r in docs.where("n_chars > 200").limit(60).collect():
        words = r["text"].split()[:200]
        rows += [(r["doc_id"], " ".join(words)), (-1 - r["doc_id"], " ".join(draw.sample(words, len(words))))]
    got = {r["doc_id"]: r["score"] for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string"), counted, model).collect()}
    worse = [got[i] > got[-1 - i] for i in got if i >= 0]
    assert sum(worse) >= 0.9 * len(worse)


def test_op5_held_out_accuracy(spark, data):
    rows = registry.queries()["op5_language_id"](spark, data).collect()
    lang = {r["doc_id"]: (r["lang"], r["n_chars"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    held = [r for r in rows if r["held_out"] and lang[r["doc_id"]][1] > 100]
    assert {r["doc_id"] for r in rows} == set(lang) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["lang_pred"] == lang[r["doc_id"]][0] for r in held) >= 0.85 * len(held)


def test_op7_held_out(spark, data):
    rows = {r["doc_id"]: r for r in registry.queries()["op7_toxicity"](spark, data).collect()}
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows.values())
    right = [rows[i]["predicted"] == t for i, t in toxic.items()]
    assert sum(right) >= 0.85 * len(right)


def test_op8_sums_to_the_documents_tokens(spark, data):
    from cinderlake.llm.token_counts import TOKENIZER, Encoder, read_ranks

    encoder = Encoder(read_ranks(TOKENIZER))
    got: dict = {}
    for r in registry.queries()["op8_token_counts"](spark, data).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["n_tokens"]
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        assert got[r["doc_id"]] == len(encoder.encoding.encode_ordinary(r["text"] or ""))


def test_op9_against_a_plain_reading(spark, data):
    import html
    import re

    for r in spark.read.parquet(f"{data}/pages.parquet").join(registry.queries()["op9_html_text"](spark, data), ["page_id", "url"]).collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"<!--.*?-->", "", inner, flags=re.S).replace("<br>", " "))
        lines = (" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in parts)
        assert r["text"] == "\n".join(x for x in lines if x) and r["n_chars"] == len(r["text"])


def test_pipeline_stages_one_by_one(spark, data):
    import corpus_pipeline as P
    from cinderlake.llm.decontaminate import words_of

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(P.STAGES):
        before = docs.collect()
        docs = stage(spark, docs, data)
        docs = P.materialise(docs, f"test-{name}")
        after = docs.collect()
        if k + 1 < len(P.STAGES):
            assert docs.columns == columns
            kept = {r["doc_id"] for r in after}
        if name == "toxicity":
            toxic = {r["doc_id"] for r in spark.read.parquet(f"{data}/labels.parquet").where("toxic = 1").collect()}
            gone = {r["doc_id"] for r in before} - kept
            assert len(gone - toxic) <= 0.05 * len(before) and len(toxic & kept) <= 0.5 * max(1, len(toxic))
        if name == "exact_dedup":
            first: dict = {}
            for r in before:
                key = __import__("re").sub(r"[\x20\x09-\x0D]+", " ", r["text"])
                first[key] = min(first.get(key, r["doc_id"]), r["doc_id"])
            assert kept == set(first.values())
        if name == "jaccard_join":
            sets = {}
            for r in before:
                w = r["text"].encode().lower().split()
                sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
            root = {i: i for i in sets}

            def find(i):
                while root[i] != i:
                    i = root[i]
                return i

            ids = sorted(sets)
            for x in ids:
                for y in ids:
                    if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                        a, b = find(x), find(y)
                        root[max(a, b)] = min(a, b)
            assert kept == {find(i) for i in ids}
        if name == "decontaminate":
            windows = set()
            for r in spark.read.parquet(f"{data}/benchmark.parquet").collect():
                w = words_of(r["text"])
                windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
            sizes = {len(w) for w in windows}
            clean = lambda w: not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
            assert kept == {r["doc_id"] for r in before if clean(words_of(r["text"]))}
        if name == "mix_sources":
            assert docs.columns == [*columns, "mix_epoch"] and {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
