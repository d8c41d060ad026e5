from __future__ import annotations

import random
import re

import books
import pytest
from pyspark.sql import functions as F
from test_retrieval import store

from corpusloom.functions import text as tx
from corpusloom.functions.vectors import hashed_embedding_py
from corpusloom.operators import maintenance, retrieval
from corpusloom.operators.postings import Postings, made, word_counts
from corpusloom.operators.retrieval import SearchFilters
from corpusloom.streaming import ingest


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def collection(n=600, seed=5):
    rng = random.Random(seed)
    common = ["farinha", "ovos", "leite", "açúcar", "forno", "massa", "a", "de", "e", "x9"]
    rare = ["entremet", "Entremets", "reentremetado", "anana", "ananananas", "banana", "Crème", "cremes", "ΑΒΓ", "naïveté", "abcabcabc"]
    texts = []
    for _ in range(n):
        words = rng.choices(common, k=rng.randint(0, 20)) + (rng.choices(rare, k=rng.randint(1, 7)) if rng.random() < 0.02 else [])
        rng.shuffle(words)
        texts.append(rng.choice([" ", "\n", "-", ", "]).join(words))
    return [("livro", rng.choice(["receita", "texto"]), text) for text in texts]


def test_runs_of_words(spark):
    df = spark.createDataFrame([(1, "b a b  Bé a9"), (2, ""), (3, None), (4, "日本 --"), (5, "z" * 5000)], "id int, text string")
    got = rows_of(word_counts(df, "id", tx.fold(F.col("text"))))
    assert got == [("a", 1, 1), ("a9", 1, 1), ("b", 1, 2), ("be", 1, 1), ("z" * 5000, 5, 1)]


def test_counts_equal_a_scan_of_the_texts(spark):
    chunks = store(spark, collection())
    index = Postings.built(chunks)
    terms = ["entremet", "anana", "creme", "naivete", "abcabc", "farinha", "inha", "nothere", "bcab"]
    folded = tx.held(chunks, "_f", retrieval.folded_text())
    scanned = retrieval.term_counts(folded, "id", "_f", terms)
    found, expected = index.term_counts(terms), retrieval.rare_terms(scanned, 600)
    assert rows_of(retrieval.rare_terms(found, 600)) == rows_of(expected) and expected.count() >= 3
    rare = {r.term for r in expected.collect()}
    assert rows_of(found.where(F.col("term").isin(*rare))) == rows_of(scanned.where(F.col("term").isin(*rare)))
    assert "farinha" not in {r.term for r in found.select("term").distinct().collect()}  # told by its words' sums alone
    assert rows_of(index.term_counts([])) == []
    with pytest.raises(ValueError):
        index.words_of(["ab"])


def test_search_is_the_same_and_reads_no_text(spark, tmp_path):
    store(spark, collection(900, 8)).write.parquet(str(tmp_path / "chunks"))
    chunks = spark.read.parquet(str(tmp_path / "chunks"))
    index = Postings.built(chunks)
    for text, filters in (("um entremet de banana com creme", None), ("anana abcabc farinha", SearchFilters(kind="texto")), ("forno", None), ("anana", SearchFilters(ingredient="entremet")), ("", None)):
        vector = hashed_embedding_py(text).tolist()
        plain = retrieval.search(chunks, text, vector, filters, k=20)
        quick = retrieval.search(chunks, text, vector, filters, k=20, postings=index)
        assert [tuple(r) for r in quick.collect()] == [tuple(r) for r in plain.collect()]
        plan = quick._jdf.queryExecution().executedPlan().toString()
        read = " ".join(s for s in re.findall(r"ReadSchema: struct<(.*)>", plan) if "embedding" in s)
        assert ("text:" in read) == bool(filters and filters.ingredients)


def test_lookups_reach_the_scan(spark):
    index = Postings.built(store(spark, collection()))
    plan = index.term_counts(["entremet"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^]]*(In\(word|EqualTo\(word)", plan)
    plan = index.words_of(["entremet"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^]]*In\(gram", plan)


def test_many_words_for_one_term(spark, monkeypatch):
    """Beyond the number of values that a scan takes, words are joined."""
    from corpusloom.operators import postings

    monkeypatch.setattr(postings, "MOST_VALUES", 3)
    chunks = store(spark, [("l", "texto", "farinha")] * 1500 + [("l", "texto", f"pre{n}raro{n} raro{n}") for n in range(8)])
    assert rows_of(Postings.built(chunks).term_counts(["raro"]).select("term", "tf")) == [("raro", 2)] * 8


def test_empty_table(spark):
    index = Postings.built(store(spark, collection()).limit(0))
    assert index.n_chunks == 0 and index.term_counts(["entremet"]).count() == 0


def test_index_keeps_its_postings(spark, tmp_path):
    """Appended batches, a removal and an index made before there were postings: the same as postings built anew."""
    folder, at = tmp_path / "in", str(tmp_path / "index")
    folder.mkdir()
    index = maintenance.Snapshots(spark, at, "chunks")

    def check():
        kept, anew = Postings.of(index), Postings.built(index.read())
        assert rows_of(kept.postings) == rows_of(anew.postings) and kept.n_chunks == anew.n_chunks
        sums = lambda p: rows_of(p.grams.groupBy("gram", "word").agg(F.sum("df"), F.sum("total")))
        assert sums(kept) == sums(anew)
        return kept

    for n in (1, 9):
        (folder / f"livro{n}.md").write_text(books.recipe_text(n))
        ingest.build(spark, str(folder), at)
        kept = check()
    assert rows_of(kept.words_of(["farinha"])) == rows_of(Postings.built(index.read()).words_of(["farinha"]))
    with index.lock():
        maintenance.remove_from_index(index, ["livro1"])
    check()
    now = index.current
    index._point({**now, "parts": {k: v for k, v in now["parts"].items() if k not in ("postings", "grams")}, "after": index._number()})
    assert Postings.of(index) is None
    (folder / "livro3.md").write_text(books.recipe_text(3))
    ingest.build(spark, str(folder), at)
    check()


def test_made_is_sorted(spark):
    words = [r.word for r in made(store(spark, collection(50)))["postings"].coalesce(1).collect()]
    assert words and words == sorted(words)
