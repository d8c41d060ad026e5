from __future__ import annotations

import random

import pytest

from corpusloom.llm import decontaminate as dc


def brute(words, items, window=10):
    hit, found = set(), set()
    for item, w in items:
        k = min(window, len(w))
        if not k:
            continue
        wins = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
        for i in range(len(words) - k + 1):
            if tuple(words[i : i + k]) in wins:
                hit |= set(range(i, i + k))
                found.add(item)
    return hit, found


@pytest.mark.parametrize("seed", range(30))
def test_automaton_against_brute_force(seed):
    rng = random.Random(seed)
    vocab = [f"w{n}".encode() for n in range(rng.choice([2, 3, 6]))]
    window = rng.choice([2, 3, 5])
    items = [(str(n), [rng.choice(vocab) for _ in range(rng.randint(0, 12))]) for n in range(8)]
    auto = dc.SuffixAutomaton(window)
    for item, w in items:
        auto.add(w, item)
    auto.close()
    for _ in range(20):
        words = [rng.choice([*vocab, b"zzz"]) for _ in range(rng.randint(0, 40))]
        spans, found = auto.hits(words)
        hit, expected = brute(words, items, window)
        assert {p for a, b in spans for p in range(a, b)} == hit and found == expected
        assert all(x[1] < y[0] for x, y in zip(spans, spans[1:]))


def tables(spark):
    passage = " ".join(f"Term{n}" for n in range(14))
    docs = [(1, f"before text {passage} after, text"), (2, "nothing here"), (3, None), (4, ""), (5, passage.upper().replace(" ", "--")), (5, passage.upper().replace(" ", "--")), (None, "short one"), (6, "é" * 9000 + " short one")]
    items = [(10, passage), (11, "Short, ONE!"), (12, None), (13, "..."), (11, "other thing")]
    return spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, spans string"), spark.createDataFrame(items, "item_id long, text string")


def test_odd_rows_and_shards(spark):
    docs, items = tables(spark)
    rows = lambda df: sorted((str(r.doc_id), r.n_words, tuple((s.a, s.b) for s in r.spans), tuple(r["items"])) for r in df.collect())
    one = rows(dc.find_hits(docs, items))
    assert one == rows(dc.find_hits(docs, items, shard_words=3))  # several automata, one after another
    assert one == [("1", 18, ((2, 16),), ("10",)), ("2", 2, (), ()), ("3", 0, (), ()), ("4", 0, (), ()), ("5", 14, ((0, 14),), ("10",)), ("5", 14, ((0, 14),), ("10",)), ("6", 3, ((1, 3),), ("11",)), ("None", 2, ((0, 2),), ("11",))]
    assert dc.find_hits(docs.where("false"), items).count() == 0
    assert all(not r[2] for r in rows(dc.find_hits(docs, items.where("false"))))


def test_spans_are_removed(spark):
    docs, items = tables(spark)
    kept = sorted((str(r.doc_id), r.text, r.spans) for r in dc.remove_spans(docs, items).collect())
    assert kept == [("1", "before text\nafter, text", "x"), ("2", "nothing here", "x"), ("3", None, "x"), ("4", "", "x"), ("6", "é" * 9000 + "\n", "x")]
    # a cut that brings a window together is cut again
    items2 = spark.createDataFrame([(1, "a b"), (2, "c d")], "item_id long, text string")
    twice = spark.createDataFrame([(1, "x a c d b y z z z z z")], "doc_id long, text string")
    assert [r.text for r in dc.remove_spans(twice, items2).collect()] == ["x\ny z z z z z"]


def test_spans_by_shards_as_by_one(spark):
    """Passages of several items, one brought together by a cut, a document that is all passages, repeats and odd rows."""
    items = spark.createDataFrame([(1, " ".join(f"a{n}" for n in range(14))), (2, " ".join(f"b{n}" for n in range(12))), (3, "short item"), (4, None)], "item_id long, text string")
    a, b = (" ".join(f"{c}{n}" for n in range(11)) for c in "ab")
    rows = [(1, f"one two {a} three {b} four five six seven eight nine ten eleven twelve"), (2, f"{a} {b}"), (3, None), (4, ""), (5, "clean text"), (5, "clean text"), (None, f"x y z short {a} item w " * 3), (6, "A short, item. And more of its own text here"), (7, f"{' '.join(f'c{n}' for n in range(30))} b0 b1 b2 b3 b4 {a} b5 b6 b7 b8 b9 b10 end")]
    docs = spark.createDataFrame([(i, t, "k", 5) for i, t in rows], "doc_id long, text string, _op_total string, n int")
    whole = sorted(map(str, dc.remove_spans(docs, items).collect()))
    assert sorted(map(str, dc.remove_spans(docs, items, shard_words=13).collect())) == whole and len(whole) == 8
    assert dc.remove_spans(docs.where("false"), items, shard_words=13).count() == 0
