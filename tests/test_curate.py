from __future__ import annotations

import books
import pytest

from corpusloom.functions import text as tx
from corpusloom.operators import curate


@pytest.fixture(scope="module")
def prepared(spark):
    rows = [("recipes", books.recipe_text(1)), ("manual", books.manual()), ("short", "Pouco texto."), ("empty", ""), ("none", None), ("broken", "s t r e e s t e p s e e p a b " * 40)]
    return {r.name: r for r in curate.prepare(spark.createDataFrame(rows, "name string, text string"), "name").collect()}


def test_recipe_book(prepared):
    r = prepared["recipes"]
    assert (r.tier, r.lang, r.discard_reason) == ("receitas", "pt", None)
    assert sum(p.kind == "receita" for p in r.pieces) == 6
    assert {p.title for p in r.pieces if p.kind == "receita"} == {t.title() for t, _, _ in books.recipes(1)}


def test_reasons(prepared):
    assert prepared["manual"].discard_reason == "non_culinary"
    assert {prepared[n].discard_reason for n in ("short", "empty", "none")} == {"too_little_text"}
    assert prepared["broken"].discard_reason == "too_little_text"


def test_columns_agree_with_python(spark):
    texts = ["Ação É aÇÃO", "", "123", "ABC def", "São João\nÉ Ótimo"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.fold(tx.F.col("t")).alias("f"), tx.uppercase_ratio(tx.F.col("t")).alias("u")).collect()
    for r in rows:
        assert r.f == tx.fold_py(r.t) and abs(r.u - tx.uppercase_ratio_py(r.t)) < 1e-9


def test_clean_text():
    raw = "co-\nzinha\n| --- | --- |\n| sal | pimenta |\n42\n- 7 -\nxiv\n.... .... ....\nhttps://example.com/x\nISBN 123\nlinha um\ncontinua aqui.\nNova frase"
    assert curate.clean_text(raw) == "cozinha sal pimenta linha um continua aqui.\nNova frase"
    header = "\n\n".join(f"LIVRO DE TESTE\n\nparágrafo {n} com texto próprio." for n in range(8))
    assert "LIVRO DE TESTE" not in curate.clean_text(header)
    steps = "\n\n".join(f"Ingredientes\n\nitem {n}." for n in range(8))
    assert curate.clean_text(steps).count("Ingredientes") == 8
    assert curate.clean_text("a.\n\n\n\nb.") == "a.\n\nb."
    assert curate.clean_text(None) == curate.clean_text("") == ""


def test_unwrap_keeps_titles_lists_and_ends():
    lines = ["primeira linha", "segue.", "TITULO GRANDE", "corpo", "- item", "mais"]
    assert curate.unwrap(lines) == ["primeira linha segue.", "TITULO GRANDE", "corpo", "- item mais"]


def test_chunk_bounds():
    text = "\n\n".join(f"Parágrafo {n} " + "palavra " * 60 + "." for n in range(40))
    sizes = [len(p.text) for p in curate.chunk(text, "tecnica")]
    assert all(30 <= s <= 2200 + 600 for s in sizes) and len(sizes) > 5
    assert all(len(p.text) <= 4400 for p in curate.chunk("x" * 50_000, "tecnica"))
    assert curate.split_hard("a" * 10, 4) == ["aaaa", "aaaa", "aa"]
    assert curate.chunk("", "receitas") == curate.chunk(None, None) == []


def test_ingredients():
    assert curate.ingredients_of("200 g de farinha, peneirada\n2 xícaras de açúcar (branco)\n2 xícaras de AÇÚCAR") == ["de farinha", "de açúcar"]
    # the quirk: a match that starts on a blank line loses its quantity
    assert curate.ingredients_of("texto\n\n200 g de farinha") == []


def test_garbage_ratio_column(spark):
    rows = [("a b c d " * 10 + "palavra " * 40,), ("um dois tres",), ("a b c palavra " * 20,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(tx.garbage_run_ratio(tx.F.col("t"))).collect()]
    assert got == [0.5, 0.0, 0.0]


def test_names(spark):
    df = spark.createDataFrame([("Copy of Meu Livro_1.PDF",), ("a/b/x?y.htm",), ("sem",), ("t.zip",)], "n string")
    got = df.select(tx.safe_slug(tx.F.col("n")), tx.book_title(tx.F.col("n")), tx.extension(tx.F.col("n"))).collect()
    assert [tuple(r) for r in got] == [("Meu Livro_1", "Meu Livro 1", "pdf"), ("x_y", "x?y", "html"), ("sem", "sem", None), ("t", "t", None)]
