from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.vectors import hashed_embedding_py
from corpusloom.operators import retrieval
from corpusloom.operators.retrieval import SearchFilters

SCHEMA = "id string, book string, title string, kind string, lang string, text string, region string, dish_types array<string>, embedding array<float>"


def store(spark, rows):
    return spark.createDataFrame([(f"b::{n:04d}", book, "", kind, "pt", text, "brasileira", ["sobremesa"], hashed_embedding_py(text).tolist()) for n, (book, kind, text) in enumerate(rows)], SCHEMA)


def ids(df):
    return [r.id for r in df.collect()]


def ask(chunks, text, **k):
    return retrieval.search(chunks, text, hashed_embedding_py(text).tolist(), **k)


def test_filter_before_ranking(spark):
    chunks = store(spark, [("livro", "receita", "bolo de chocolate")] * 300 + [("livro", "tecnica", "outra coisa qualquer")])
    assert ids(ask(chunks, "bolo de chocolate", filters=SearchFilters(kind="tecnica"))) == ["b::0300"]
    assert ids(ask(chunks, "bolo", filters=SearchFilters(kind="texto"))) == []


def test_words_begin(spark):
    chunks = store(spark, [("l", "receita", "temperatura alta"), ("l", "receita", "espere um pouco"), ("l", "receita", "Pêras maduras"), ("l", "receita", "creme\nde leite")])
    assert ids(ask(chunks, "x", filters=SearchFilters(ingredient="pera"))) == ["b::0002"]
    assert ids(ask(chunks, "x", filters=SearchFilters(ingredient="Creme  de leite"))) == ["b::0003"]
    assert len(ids(ask(chunks, "x", filters=SearchFilters(ingredient=" , ;")))) == 4
    assert ids(ask(chunks, "x", filters=SearchFilters(ingredient="pera, creme"))) == []


def test_book_filter_folds_and_contains(spark):
    chunks = store(spark, [("Cozinha Française", "receita", "a"), ("Outro", "receita", "b")])
    assert ids(ask(chunks, "a", filters=SearchFilters(book="francaise"))) == ["b::0000"]
    assert ids(ask(chunks, "a", filters=SearchFilters(region="francesa"))) == []
    assert len(ids(ask(chunks, "a", filters=SearchFilters(dish_type="sobremesa")))) == 2


def test_rare_terms_reach_the_top(spark):
    rng = random.Random(3)
    common = [("l", "receita", " ".join(rng.choices(["receita", "completa", "farinha", "ovos", "leite"], k=12))) for _ in range(400)]
    chunks = store(spark, common + [("l", "receita", f"notas longas sobre entremet gelado e camadas numero {n}") for n in range(3)])
    assert {"b::0400", "b::0401", "b::0402"} <= set(ids(ask(chunks, "receita completa de entremet", k=8)))


def test_nothing_is_rare_in_a_small_store(spark):
    chunks = store(spark, [("l", "receita", f"texto {n} entremet") for n in range(50)])
    assert all(r.lex_rank is None for r in ask(chunks, "entremet", k=8).collect())


def test_ties_are_stable(spark):
    chunks = store(spark, [("l", "receita", "igual")] * 20)
    assert ids(ask(chunks, "igual", k=5)) == [f"b::{n:04d}" for n in range(5)]


def test_filters():
    f = SearchFilters(kind="", ingredient="alho", book=None)
    assert f.kind is None and f.active and not SearchFilters().active
    assert SearchFilters(ingredient="alho", kind="receita", region="x").describe() == "ingrediente: alho, tipo: receita, regiao: x"
    with pytest.raises(AttributeError):
        f.kind = "x"


def test_batches():
    assert retrieval.pack_batches([10] * 1001) == [0] * 500 + [1] * 500 + [2]
    assert retrieval.pack_batches([350_000, 350_000, 70_001, 1]) == [0, 1, 2, 2]
    assert retrieval.pack_batches([]) == []


def test_query_terms():
    assert retrieval.query_terms("Receita de ENTREMÉT com what entremet abc") == ["entremet"]


def test_packing_of_a_large_group_moves_heads_only(spark):
    rows = spark.range(0, 20_000, numPartitions=40).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"), "id", F.when(F.col("id") % 5000 == 41, 1000).otherwise(F.col("id") % 4).cast("int").alias("n"))
    packed = retrieval.pack_context(rows, ["g"], ["id"], F.col("n"), limit=300)
    expected, sums = set(), {}
    for r in sorted(rows.collect(), key=lambda r: r.id):
        sums[r.g] = sums.get(r.g, 0) + r.n
        if sums[r.g] <= 300:
            expected.add((r.g, r.id, sums[r.g]))
    assert packed.columns == ["g", "id", "n", "packed_chars"]
    assert {(r.g, r.id, r.packed_chars) for r in packed.collect()} == expected


@pytest.mark.parametrize(("block", "items", "tokens"), [(65_536, 500, 10**6), (16, 5, 40), (7, 7, 25), (10, 3, 9)])
def test_batches_over_blocks(spark, block, items, tokens):
    rng = random.Random(block)
    rows = [(rng.choice(["a", "a", "a", "b", None]), n, rng.choice([None, "", "x", "x" * 9, "x" * 40, "x" * 200])) for n in range(300)]
    df = spark.createDataFrame(rows, "g string, o long, t string").repartition(5)
    found = {(r.g, r.o): r.batch for r in retrieval.batched(df, "g", "o", "t", items, tokens, block).collect()}
    expected = {}
    for g in ("a", "b", None):
        mine = sorted((o, len(t or "")) for gg, o, t in rows if gg == g)
        expected |= {(g, o): b for (o, _), b in zip(mine, retrieval.pack_batches([n for _, n in mine], items, tokens))}
    assert found == expected
    assert retrieval.batched(df.where("false"), "g", "o", "t").collect() == []


def test_one_group_spreads_over_tasks(spark):
    df = spark.range(5000).select(F.lit("all").alias("g"), F.col("id").alias("o"), F.lit("xxxx").alias("t"))
    found = retrieval.batched(df, "g", "o", "t", 10, 1000, 500).withColumn("task", F.expr("spark_partition_id()"))
    assert found.agg(F.count_distinct("batch"), F.max("batch")).first() == (500, 499)
    sizes = [r["count"] for r in found.groupBy("batch").count().collect()]
    assert set(sizes) == {10}
