"""Very long texts, empty tables and columns whose names clash with the operators' own."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import bpe, decontaminate, language_id, line_dedup, token_counts

OWN = ("_id", "_doc", "_pos", "_text_key", "ids", "decoded", "edits", "score", "lang_pred", "n_words", "n_hit", "batch", "_op_x", "spans", "source")
LONG = "the quick brown fox jumps over a lazy dog and goes home at last "


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, LONG, "en"), (2, LONG * 4000, "en"), (3, "un deux trois quatre cinq six sept huit neuf dix onze", "fr"), (4, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def forms(docs):
    """The table, the same with clashing names, and the same without rows."""
    return docs, docs.withColumns({c: F.lit("x") for c in OWN}), docs.where("false")


def same(run, docs):
    plain, clash, empty = (sorted(map(tuple, run(d).collect()), key=str) for d in forms(docs))
    assert plain == clash and empty == []
    return plain


def test_decontamination(spark, docs):
    items = spark.createDataFrame([("a", "quick brown fox jumps over a lazy dog and goes"), ("b", None)], "item_id string, text string")
    hits = same(lambda d: decontaminate.find_hits(d, items.withColumns({"_id": F.lit(1), "n_hit": F.lit(2)})).select("doc_id", "n_words", F.size("spans").alias("n")), docs)
    assert (2, 56_000, 4000) in hits and (1, 14, 1) in hits
    kept = same(lambda d: decontaminate.remove_spans(d, items).select("doc_id", "text"), docs)
    assert {k[0] for k in kept} >= {3, 4}


def test_bpe(docs):
    rows = same(lambda d: bpe.encode_decode(d, bpe.default_path()).select("doc_id", F.size("ids").alias("n"), F.md5("decoded").alias("m")), docs)
    by = {r[0]: r[1] for r in rows}
    assert by[2] == 4000 * by[1] and by[4] == 0


def test_language(docs):
    profiles = language_id.learn(docs)
    rows = same(lambda d: language_id.identify(d, profiles).select("doc_id", "lang_pred"), docs)
    assert {(1, "en"), (2, "en"), (3, "fr"), (4, "und")} == set(rows)
    nothing = language_id.learn(docs.where("false"))
    assert {r.lang_pred for r in language_id.identify(docs, nothing).collect()} == {"und"}


def test_token_counts(spark, docs):
    edits = spark.createDataFrame([(2, 1, 0, 4, "a "), (4, 1, 0, 0, "new"), (9, 1, 0, 0, "none")], "doc_id long, seq int, pos int, n_delete int, insert string")
    rows = same(lambda d: token_counts.recount_from(d, edits, token_counts.default_path()), docs)
    assert len(rows) == 4


def test_lines(docs):
    rows = same(lambda d: line_dedup.dedup_lines(d).select("doc_id", "n_lines", "n_dropped"), docs)
    assert (2, 1, 0) in rows
    many = docs.withColumn("text", F.repeat("text", F.lit(1))).withColumn("text", F.concat_ws("\n", "text", F.repeat(F.lit("the same long line\n"), 50_000)))
    assert {(r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(many.where("doc_id IN (1, 3)")).collect()} == {(50_002, 0), (50_002, 50_000)}
