from __future__ import annotations

import json

import books
import pytest

from corpusloom.__main__ import main
from corpusloom.operators.maintenance import Snapshots


def titles(index):
    return {r.book for r in index.read().select("book").distinct().collect()}


def test_build_resume_remove_and_guarded_rebuild(spark, tmp_path, capsys):
    folder, few, at = tmp_path / "in", tmp_path / "few", str(tmp_path / "index")
    (folder / "sub").mkdir(parents=True)
    few.mkdir()
    (folder / "receitas.md").write_text(books.recipe_text(1))
    (folder / "manual.txt").write_text(books.manual())
    assert main(["build", str(folder), at], spark) == 0
    assert json.loads(capsys.readouterr().out) == {"added": 1, "discarded": 1}
    (folder / "sub" / "mais.txt").write_text(books.recipe_text(7))  # folders inside are not read
    (folder / "receitas.txt").write_text(books.recipe_text(9))
    (few / "outro.md").write_text(books.recipe_text(4))
    assert main(["build", str(folder), at], spark) == 0  # only what is new
    assert json.loads(capsys.readouterr().out) == {"added": 1}
    index = Snapshots(spark, at, "chunks")
    other = "receitas [receitas.txt]"
    assert titles(index) == {"receitas", other}
    n = {r.book: r["count"] for r in index.read().groupBy("book").count().collect()}

    before = index.current
    assert main(["remove", at, "--title", "receitas", "--dry-run"], spark) == 0
    told = json.loads(capsys.readouterr().out)
    assert index.current == before
    assert told["titles"] == ["receitas"] and told["slugs"] == ["receitas"] and told["relabelled"] == {other: "receitas"}
    assert (told["chunks_removed"], told["chunks_after"], told["books_after"]) == (n["receitas"], n[other], 1)

    # a folder that lacks an indexed book's file refuses to be the whole
    assert main(["build", str(few), at, "--rebuild"], spark) == 2
    assert index.current == before and "1 files for 2" in capsys.readouterr().err

    assert main(["remove", at, "--title", "receitas"], spark) == 0
    assert json.loads(capsys.readouterr().out) == told
    assert titles(index) == {"receitas"} and index.read().count() == n[other]
    assert {(r.title, r.filename) for r in index.read("books").collect()} == {("receitas", "receitas.txt")}
    assert {(r.filename, r.book_title) for r in index.read("jobs").collect() if r.status == "added"} == {("receitas.md", "receitas"), ("receitas.txt", "receitas")}
    assert {r.slug: (r.n_chunks, r.removed) for r in index.read("processed").where("slug IS NOT NULL").collect()}["receitas"] == (0, True)
    assert main(["build", str(folder), at], spark) == 0  # the removed book's file does not come back
    capsys.readouterr()
    assert index.read().count() == n[other]
    with pytest.raises(ValueError, match="unknown titles"):
        main(["remove", at, "--title", "nada"], spark)

    assert main(["build", str(few), at, "--rebuild", "--force"], spark) == 0
    assert json.loads(capsys.readouterr().out) == {"added": 1} and titles(index) == {"outro"}
    assert index.read("processed").count() == 1 and index.read("jobs").count() == 4
