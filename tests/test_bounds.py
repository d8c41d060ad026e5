"""What grows with the input is bounded: scores of a tile, Python objects of a batch, pairs of common phrases, rows of a sort."""

from __future__ import annotations

import random
import sys
import tracemalloc
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from corpusloom.functions.rows import BLOCK, per_row
from corpusloom.operators import dedup


def most_rows(df) -> int:
    """The most rows that any step of the plan gave."""
    df.collect()

    def of(plan) -> int:
        name = plan.getClass().getSimpleName()
        inner = [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
        own = plan.metrics().get("numOutputRows")
        return max([own.get().value() if own.isDefined() else 0, *map(of, inner)])

    return of(df._jdf.queryExecution().executedPlan())


def test_a_tile_holds_a_strip_of_its_scores():
    rng = np.random.default_rng(4)
    left, right = rng.normal(size=(1500, 8)), rng.normal(size=(3000, 8))
    whole = np.round(left @ right.T, 12)
    row, at = dedup._best_of_tile(whole, 3)
    tracemalloc.start()
    found = dedup._best_in_strips(left, right, 3, strip=1 << 16)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (found[0] == row).all() and (found[1] == at).all() and np.allclose(found[2], whole[row, at])
    assert peak < whole.nbytes / 6


def test_few_rows_are_python_objects_at_once(spark):
    df = spark.range(0, 3000, 1, 1)
    held = per_row(df, [F.col("id")], lambda i: max(map(len, sys._getframe(1).f_locals["columns"])), "n", "int").collect()
    assert len(held) == 3000 and max(r.n for r in held) <= BLOCK


def test_common_phrases_make_no_pairs(spark):
    rng = random.Random(6)
    texts = {n: {f"p{i}" for i in range(3)} | {f"w{rng.randrange(4000)}" for _ in range(rng.choice([4, 30, 60]))} for n in range(200)}
    for n in range(0, 200, 10):  # what passes
        texts[n] |= set(sorted(texts[n + 1])[:12])
    rows = spark.createDataFrame([(n, s) for n, t in texts.items() for s in sorted(t)], "new_id long, shingle string")
    known = rows.withColumnRenamed("new_id", "known_id")
    expected = {(a, b): len(x & y) for a, x in texts.items() for b, y in texts.items() if len(x & y) / len(x) >= 0.15}
    found = dedup.containment(rows, known, "new_id", "known_id", 0.15)
    assert {(r.new_id, r.known_id): r.n_shared for r in found.collect()} == expected
    assert all(r.n_new == len(texts[r.new_id]) and r.containment == r.n_shared / r.n_new for r in found.collect())
    every = dedup.containment(rows, known, "new_id", "known_id")
    assert {(r.new_id, r.known_id): r.n_shared for r in every.collect()} == {(a, b): n for a, x in texts.items() for b, y in texts.items() if (n := len(x & y))}
    often = Counter(s for t in texts.values() for s in t)
    assert most_rows(found) < sum(n * n for n in often.values()) / 2


def test_posting_tables_are_sorted_in_ranges_of_bounded_size(spark, monkeypatch):
    from corpusloom.operators import postings

    chunks = spark.createDataFrame([(n, " ".join(f"word{i}" for i in range(n % 7, n % 7 + 9))) for n in range(40)], "id long, text string").withColumn("title", F.lit(""))
    monkeypatch.setattr(postings, "SORTED", 25)
    tables = postings.made(chunks)
    assert tables["postings"].rdd.getNumPartitions() == -(-360 // 25)
    rows = tables["postings"].rdd.glom().map(len).collect()
    assert sum(rows) == 360 and max(rows) <= 4 * 25


def test_words_are_counted_where_they_are_if_ids_are_unique(spark):
    from corpusloom.operators import postings

    once = spark.createDataFrame([(1, "abc abc de xyz"), (2, "abc xyz"), (None, "abc"), (None, "q abc")], "id long, text string")
    twice = once.unionByName(once.where("id = 1"))
    assert postings.unique_ids(once) and not postings.unique_ids(twice)
    for rows, unique in ((once, True), (once, False), (twice, False)):
        counted = postings.word_counts(rows, "id", F.col("text"))
        found = {r.word: (r.df, r.total) for r in postings.word_table(counted, unique).collect()}
        assert found == {"abc": (2, 5 + 2 * (rows is twice)), "xyz": (2, 2 + (rows is twice))}
    plan = postings.word_table(postings.word_counts(once, "id", F.col("text")), True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_words_of_the_garbage_ratio_are_found_once(spark):
    from corpusloom.functions import text as tx

    texts = ["a b c d e " * 5 + "palavra " * 5, "palavra " * 30, "a b", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(tx.garbage_run_ratio(F.col("text")).alias("r"))
    assert [r.r for r in df.collect()] == [25 / 30, 0.0, 0.0, 0.0, None]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1
