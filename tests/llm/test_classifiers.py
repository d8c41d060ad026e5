from __future__ import annotations

import random
from collections import Counter

import numpy as np

from corpusloom.llm import _ngrams as ng
from corpusloom.llm import language_id as li
from corpusloom.llm import toxicity as tox


def test_grams_against_brute_force():
    for text in ("", "a", "Ab, ção!\nx", "l'été 123 ß", "word " * 3):
        padded = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
        for n in (1, 2, 3):
            expected = Counter(padded[i : i + n] for i in range(len(padded) - n + 1) if padded[i : i + n].strip() and " " not in padded[i : i + n][1:-1])
            packed = Counter(ng.packed(ng.codes(text), n).tolist())
            name = lambda g: int("".join(f"{ord(c):021b}" for c in g), 2)
            assert packed == {name(g): k for g, k in expected.items() if g.strip() and (n > 1 or g != " ")}


def test_hashed_are_distinct_and_sorted():
    h = ng.hashed(ng.codes("banana bandana banana"), (3, 5), 1 << 16)
    assert (np.diff(h.astype(np.int64)) > 0).all() and len(ng.hashed(ng.codes(""), (5, 6), 1 << 16)) == 0


def corpus(spark, n=400, seed=1):
    rng = random.Random(seed)
    words = {"aa": ["lorem", "ipsum", "dolor", "sita"], "bb": ["zwei", "grüße", "fünfzig", "über"]}
    docs, labels = [], []
    for k in range(n):
        lang = rng.choice(["aa", "bb"])
        text = [rng.choice(words[lang]) for _ in range(rng.randint(5, 60))]
        bad = k % 4 == 0
        if bad:
            text.insert(rng.randrange(len(text)), "horrible")
        docs.append((k, " ".join(text), lang, "src", 0.5))
        if k % 3:
            labels.append((k, 1, int(bad)))
    odd = [(1001, None, "aa", "s", 0.1), (1002, "", None, "s", 0.1), (1003, "123 !!", "aa", "s", 0.1), (None, "lorem ipsum", None, "s", 0.1), (1004, "lorem " * 20000, "aa", "s", 0.1), (1004, "lorem " * 20000, "aa", "s", 0.1)]
    return spark.createDataFrame(docs + odd, "doc_id long, text string, lang string, source string, score double"), spark.createDataFrame(labels + [(5000, 1, 1), (None, 0, 1), (2, 1, None)], "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = corpus(spark)
    model = tox.train(docs, labels.where(tox.remainder("doc_id", 5) != 0))
    scores = {r.doc_id: r.score for r in tox.score(docs, model).collect()}
    assert all((scores[k] >= 0.5) == (k % 4 == 0) for k in range(400)) and all(0 <= s <= 1 for s in scores.values())
    assert scores[1001] == scores[1002] < 0.5
    kept = tox.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == 300 + 6
    assert tox.score(docs.where("false"), model).count() == 0


def test_toxicity_without_both_classes(spark):
    docs, labels = corpus(spark)
    assert all(r.score < 0.5 for r in tox.score(docs, tox.train(docs, labels.where("false"))).collect())
    assert all(r.score > 0.5 for r in tox.score(docs, tox.train(docs, labels.where("toxic = 1"))).collect())


def test_toxicity_held_out(spark):
    rows = tox.query(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").collect()
    right = sum((r.score >= 0.5) == (r.toxic == 1) for r in rows)
    assert right / len(rows) > 0.95 and all(r.predicted == int(r.score >= 0.5) for r in rows)


def test_language_against_brute_force(spark):
    docs, _ = corpus(spark)
    profiles = li.learn(docs)
    assert profiles.names == ["aa", "bb"]

    def grams(text):
        padded = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
        return Counter(int("".join(f"{ord(c):021b}" for c in g), 2) for n in (1, 2, 3) for i in range(len(padded) - n + 1) if (g := padded[i : i + n]).strip() and " " not in g[1:-1])

    top = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:300]]
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").collect()
    known = {lang: top(sum((grams(r.text) for r in rows if r.lang == lang), Counter())) for lang in ("aa", "bb")}
    for k, name in enumerate(profiles.names):
        ranked = sorted((r, g) for g, r in zip(profiles.grams.tolist(), profiles.ranks[k][:-1].tolist()) if r >= 0)
        assert [g for _, g in ranked] == known[name]
    for r in rows[:40]:
        own = top(grams(r.text))
        apart = {name: sum(abs(i - known[name].index(g)) if g in known[name] else 300 for i, g in enumerate(own)) for name in known}
        lang, score = profiles.nearest(li.profile(r.text))
        assert lang == min(apart, key=lambda n: (apart[n], n)) and abs(score - (1 - apart[lang] / (300 * len(own)))) < 1e-12


def test_language_odd_rows(spark):
    docs, _ = corpus(spark)
    found = {(r.doc_id, r.lang_pred, r.score > 0) for r in li.identify(docs, li.learn(docs)).where("doc_id > 1000 OR doc_id IS NULL").collect()}
    assert found == {(1001, "und", False), (1002, "und", False), (1003, "und", False), (1004, "aa", True), (None, "aa", True)}
    assert {r.lang_pred for r in li.identify(docs, li.learn(docs.where("false"))).collect()} == {"und"}


def test_language_held_out(spark, sf):
    rows = li.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.98
