"""Restart of the queue, migration of an older table, names of originals, and paragraphs from the places of lines."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import answers, catalog, maintenance
from corpusloom.operators import jobs as jb

NOW = datetime.datetime(2024, 1, 1)
LATER = datetime.datetime(2024, 1, 2)
FIELDS = ("status", "stage", "reason_code", "retryable", "finished_at", "book_title", "book_slug", "lang", "n_chunks")


def queue(spark):
    rows = []
    for n, status in enumerate(("queued", "processing", "processing", "processing", "processing", "added", "error")):
        rows.append({"id": str(n), "filename": f"{n}.txt", "file_md5": f"m{n}", "status": status, "stage": "indexing" if status == "processing" else None, "cancel_requested": n == 3, "retryable": n == 6, "created_at": NOW, "updated_at": NOW})
    return spark.createDataFrame(rows, jb.SCHEMA), rows


def test_restart_is_what_single_events_give(spark):
    jobs, rows = queue(spark)
    processed = spark.createDataFrame([("m1", "um", 5), ("m2", "dois", 0), ("m4", "quatro", 7), ("m0", "zero", 1)], "md5 string, slug string, n_chunks int")
    meta = spark.createDataFrame([("um", "Um", "pt")], "slug string, title string, lang string")
    found = {r.id: r.asDict() for r in jb.recovered(jobs, processed, meta, LATER).collect()}
    told = {"1": {"book_title": "Um", "book_slug": "um", "lang": "pt", "n_chunks": 5}, "4": {"book_title": "quatro", "book_slug": "quatro", "lang": None, "n_chunks": 7}}
    assert len(found) == len(rows)
    for row in rows:
        job = {**dict.fromkeys(f.split()[0] for f in jb.SCHEMA.split(", ")), **row}
        job = jb.apply_event(job, "finish", LATER, status="added", **told[row["id"]]) if row["id"] in told else jb.apply_event(job, "interrupt", LATER)
        assert {k: found[row["id"]][k] for k in FIELDS} == {k: job[k] for k in FIELDS}
    again = {r.id: r.asDict() for r in jb.recovered(jb.recovered(jobs, processed, meta, LATER), processed, meta, NOW).collect()}
    assert again == found
    assert jb.recovered(jobs.limit(0), processed, meta, LATER).count() == 0


def test_pages_and_history(spark):
    jobs, _ = queue(spark)
    recent = jobs.where("id IN ('5', '6')").withColumn("status", F.lit("queued"))
    both = {r.id: r.status for r in jb.joined_pages(recent, jobs).collect()}
    assert len(both) == 7 and both["5"] == "queued"
    active = {r.id for r in jobs.where(jb.is_active()).collect()}
    assert active == {"0", "1", "2", "3", "4"}
    assert jobs.withColumn("status", F.lit(None).cast("string")).where(~jb.is_active()).count() == 7


def test_migration(spark, tmp_path):
    table = spark.createDataFrame([("a", True, NOW, 1)], "id string, retryable boolean, at timestamp, n int")
    older = spark.createDataFrame(
        [("a", 0, "2020-01-01", "1"), ("b", 1, "2024-05-01T10:00:00", "2"), ("c", None, "2024-05-01T10:00:00+02:00", "3"), ("d", 0, "", "4"), ("e", 0, None, "5"), ("f", 1, "2024-05-01T10:00:00Z", "6"), ("g", 1, "2024-05-01", "7")],
        "id string, retryable int, at string, gone string",
    )
    made = maintenance.migrated(table, older, "id")
    found = {r.id: (r.retryable, r.at, r.n) for r in made.collect()}
    ten = datetime.datetime(2024, 5, 1, 10)
    expected = {"a": (True, NOW, 1), "b": (True, ten, None), "c": (False, ten.replace(hour=8), None), "d": (False, None, None), "e": (False, None, None), "f": (True, ten, None), "g": (True, ten.replace(hour=0), None)}
    stamps = {r.id: r.s for r in made.select("id", F.date_format("at", "yyyy-MM-dd HH:mm").alias("s")).collect() if r.id != "a"}
    assert stamps == {k: v[1] and v[1].strftime("%Y-%m-%d %H:%M") for k, v in expected.items() if k != "a"}
    assert {k: (v[0], v[2]) for k, v in found.items()} == {k: (v[0], v[2]) for k, v in expected.items()}
    assert maintenance.check_migrated(made, older, "id") == 7
    with pytest.raises(RuntimeError, match="1 of 7"):
        maintenance.check_migrated(table, older, "id")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        maintenance.migrated(table, older.withColumn("at", F.lit("yesterday")), "id").collect()
    (tmp_path / "jobs.db").write_text("x")
    maintenance.set_aside(spark, str(tmp_path / "jobs.db"))
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["jobs.db.migrated"]


def test_names_of_originals(spark):
    files = spark.createDataFrame([("a.b.pdf", "cccccccc"), (".pdf", "cccccccc"), ("plain", "cccccccc"), ("new.txt", "cccccccc"), ("new.txt", "dddddddd"), ("same.txt", "eeeeeeee"), ("a.", "cccccccc")], "name string, md5 string")
    stored = spark.createDataFrame([(n, "aaaaaaaa") for n in ("a.b.pdf", ".pdf", "plain", "a.")] + [("same.txt", "eeeeeeee"), ("plain (cccccc)", "cccccccc")], "name string, md5 string")
    found = {(r.name, r.md5[0]): (r.stored_name, r.move) for r in maintenance.original_names(files, stored).collect()}
    assert found == {
        ("a.b.pdf", "c"): ("a.b (cccccc).pdf", True), (".pdf", "c"): (".pdf (cccccc)", True), ("plain", "c"): ("plain (cccccc)", False), ("a.", "c"): ("a. (cccccc)", True),
        ("new.txt", "c"): ("new.txt", True), ("new.txt", "d"): ("new (dddddd).txt", True), ("same.txt", "e"): ("same.txt", False),
    }


def test_paragraphs_from_places(spark):
    schema = "doc_id long, page long, n long, top double, left double, height double, text string"
    page = [(700, 50, "TITLE"), (670, 50, "one"), (658, 50, "two"), (646, 50, " \t"), (646, 50, "three "), (634, 70, "set in"), (622, 50, "back"), (700, 300, "column"), (688, 300, "its second")]
    rows = [(1, 0, n, float(top), float(left), 10.0, text) for n, (top, left, text) in enumerate(page)] + [(1, 1, 0, 5.0, 5.0, 0.0, "alone"), (2, 0, 0, 5.0, 5.0, 1.0, ""), (2, 0, 1, 5.0, 5.0, 1.0, None)]
    found = {(r.doc_id, r.page): r.text for r in catalog.page_text(spark.createDataFrame(rows, schema)).collect()}
    assert found == {(1, 0): "TITLE\n\none\ntwo\nthree\n\nset in\nback\n\ncolumn\nits second", (1, 1): "alone"}
    assert catalog.page_text(spark.createDataFrame([], schema)).count() == 0


def test_source_card(spark):
    rows = spark.createDataFrame([(["a", "b", "c"], [str(n) for n in range(20)]), ([], None)], "d array<string>, i array<string>")
    first, empty = (r.asDict() for r in rows.select(*(v.alias(k) for k, v in answers.shown(F.col("d"), F.col("i")).items())).collect())
    assert first == {"dishes": "a, b", "ingredients": ", ".join(map(str, range(15)))} and empty == {"dishes": None, "ingredients": None}
