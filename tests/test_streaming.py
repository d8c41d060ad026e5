from __future__ import annotations

import json
import os

import books
import pytest

from corpusloom.operators.maintenance import Snapshots
from corpusloom.streaming import ingest, state


def files_of(path, rows):
    path.mkdir(exist_ok=True)
    n = len(list(path.iterdir()))
    made = path / f"{n:03d}.json"
    made.write_text("\n".join(json.dumps(r) for r in rows))
    os.utime(made, (1_700_000_000 + n, 1_700_000_000 + n))  # files are taken in order of time


def finish(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_ingest_is_idempotent(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "receitas.md").write_text(books.recipe_text(1))
    (folder / "Copy of receitas.md").write_text(books.recipe_text(1))
    (folder / "manual.txt").write_text(books.manual())
    (folder / "quebrado.epub").write_bytes(b"PK\3\4" + b"x" * 3000)
    ingest.run(spark, str(folder), str(tmp_path / "index"), str(tmp_path / "c1")).awaitTermination(240)
    index = Snapshots(spark, str(tmp_path / "index"), "chunks")
    rows = index.read().collect()
    n = len(rows)
    assert n >= 6 and {r.id.split("::")[0] for r in rows} == {"receitas"} and {r.book for r in rows} == {"receitas"} and all(len(r.embedding) == 512 and r.region and r.dish_types for r in rows)
    assert {r.reason for r in index.read("processed").collect()} == {None, "non_culinary"}
    assert {(r.filename, r.status, r.reason_code) for r in index.read("jobs").collect()} == {("receitas.md", "added", None), ("manual.txt", "discarded", "non_culinary"), ("quebrado.epub", "error", "corrupt")}
    assert {(r.title, r.n_chunks) for r in index.read("books").collect()} == {("receitas", n)}
    ingest.run(spark, str(folder), str(tmp_path / "index"), str(tmp_path / "c2")).awaitTermination(240)  # all of it again
    assert index.read().count() == n and index.read("processed").count() == 2
    # the same book in other bytes is a near copy; another book of the same name gets a label and a slug of its own
    (folder / "outro.md").write_text(books.recipe_text(1) + "\n\nFim do livro.\n")
    (folder / "receitas.txt").write_text(books.recipe_text(9))
    ingest.run(spark, str(folder), str(tmp_path / "index"), str(tmp_path / "c1")).awaitTermination(240)
    jobs = {r.filename: r for r in index.read("jobs").collect()}
    assert (jobs["outro.md"].status, jobs["outro.md"].reason_code, jobs["outro.md"].duplicate_of, jobs["outro.md"].n_chunks) == ("duplicate", "duplicate_content", "receitas", 0)
    assert jobs["receitas.txt"].status == "added" and jobs["receitas.txt"].book_title == "receitas [receitas.txt]" and jobs["receitas.txt"].book_slug.startswith("receitas-")
    assert len({r.id for r in index.read().collect()}) == index.read().count()


def test_ingest_survives_a_failure_at_each_step(spark, tmp_path, monkeypatch):
    """A batch that breaks before or after any write of its commit, and is replayed, adds each file once."""
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "receitas.md").write_text(books.recipe_text(1))
    files = spark.read.format("binaryFile").load(str(folder))
    index = Snapshots(spark, str(tmp_path / "index"), "chunks")
    whole = Snapshots._point
    steps = {"write": 0}

    class Broken(RuntimeError):
        pass

    from pyspark.sql import DataFrameWriter

    plain = DataFrameWriter.parquet

    def failing(self, path, *a, **k):
        if "/v-" in path:
            steps["write"] += 1
            if steps["write"] == steps["at"]:
                raise Broken
        return plain(self, path, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "parquet", failing)
    for at in (1, 2, 3, 4):
        steps.update(write=0, at=at)
        with pytest.raises(Broken):
            ingest.ingest_batch(files, index)
        assert index.current is None
    assert len(index.recover()) == 6 and index.current is None
    steps["at"] = 0

    def before(self, made):
        raise Broken

    def after(self, made):
        whole(self, made)
        raise Broken

    for broken in (before, after):
        monkeypatch.setattr(Snapshots, "_point", broken)
        with pytest.raises(Broken):
            ingest.ingest_batch(files, index)
    monkeypatch.setattr(Snapshots, "_point", whole)
    ingest.ingest_batch(files, index)
    index.recover()
    assert index.read().count() == index.read().select("id").distinct().count() > 5 and index.read("processed").count() == 1


def test_job_states(spark, tmp_path):
    at = [f"2024-01-01T00:00:0{n}.000Z" for n in range(6)]
    files_of(tmp_path / "e", [{"id": "a", "event": "create", "fields": "{}", "at": at[0]}, {"id": "a", "event": "claim", "at": at[1]}, {"id": "b", "event": "claim", "at": at[1]}])
    files_of(tmp_path / "e", [{"id": "a", "event": "finish", "fields": json.dumps({"status": "error", "reason_code": "internal"}), "at": at[2]}, {"id": "a", "event": "finish", "fields": json.dumps({"status": "added"}), "at": at[3]}, {"id": "a", "event": "retry", "at": at[4]}])
    events = spark.readStream.schema("id string, event string, fields string, at timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "e"))
    rows = sorted((r.id, r.at, r.event, r.status, bool(r.error)) for r in finish(state.job_states(events), "job_rows"))
    assert [(r[0], r[2], r[3], r[4]) for r in rows] == [
        ("a", "create", "queued", False), ("a", "claim", "processing", False), ("a", "finish", "error", False), ("a", "finish", "error", True), ("a", "retry", "queued", False), ("b", "claim", None, True),
    ]


def test_conversations_and_sessions(spark, tmp_path):
    files_of(tmp_path / "t", [{"conversation": "c", "question": f"q{n}", "answer": f"a{n} [1]", "at": f"2024-01-01T00:0{n}:00.000Z"} for n in range(8)])
    turns = spark.readStream.schema("conversation string, question string, answer string, at timestamp").json(str(tmp_path / "t"))
    rows = finish(state.conversation_memory(turns), "memory_rows", "append")
    assert sorted((r.position, r.question, r.answer) for r in rows) == [(n, f"q{n + 2}", f"a{n + 2}") for n in range(6)]
    files_of(tmp_path / "s", [{"user": "u", "ts": t} for t in ("2024-01-01T00:00:00.000Z", "2024-01-01T00:10:00.000Z", "2024-01-01T02:00:00.000Z", "2024-01-02T00:00:00.000Z")])
    events = spark.readStream.schema("user string, ts timestamp").json(str(tmp_path / "s"))
    assert sorted(r.n for r in finish(state.idle_sessions(events, "user", "ts"), "session_rows")) == [1, 2]


def test_first_uploads(spark, tmp_path):
    files_of(tmp_path / "u", [{"md5": "x", "ts": "2024-01-01T00:00:00.000Z"}, {"md5": "x", "ts": "2024-01-01T00:00:01.000Z"}, {"md5": "y", "ts": "2024-01-01T00:00:02.000Z"}])
    uploads = spark.readStream.schema("md5 string, ts timestamp").json(str(tmp_path / "u"))
    assert sorted(r.md5 for r in finish(ingest.first_uploads(uploads), "upload_rows")) == ["x", "y"]


def outcomes(index):
    return {r.filename: (r.status, r.duplicate_of, r.book_title) for r in index.read("jobs").collect()}


def test_near_copies_of_one_batch_are_as_one_after_another(spark, tmp_path):
    """A, its near copy B, a near copy C of B, another book D and its copy E: one batch and five give the same outcomes."""
    a, d = books.recipe_text(1), books.recipe_text(9)
    texts = {"a.md": a, "b.md": a + "\n\nFim do livro.\n", "c.md": a + "\n\nFim do livro.\n\nUma nota a mais do editor.\n", "d.md": d, "e.md": d + "\n\nFim.\n"}
    folder = tmp_path / "in"
    folder.mkdir()
    for name, text in texts.items():
        (folder / name).write_text(text)
    files = spark.read.format("binaryFile").load(str(folder))
    whole, single = Snapshots(spark, str(tmp_path / "whole"), "chunks"), Snapshots(spark, str(tmp_path / "single"), "chunks")
    ingest.ingest_batch(files, whole)
    for name in texts:
        ingest.ingest_batch(files.where(f"path LIKE '%/{name}'"), single)
    assert outcomes(whole) == outcomes(single) == {"a.md": ("added", None, "a"), "b.md": ("duplicate", "a", None), "c.md": ("duplicate", "a", None), "d.md": ("added", None, "d"), "e.md": ("duplicate", "d", None)}
    assert {r.id for r in whole.read().collect()} == {r.id for r in single.read().collect()}


def test_ingest_leaves_the_callers_cache(spark, tmp_path):
    mine = spark.range(5).persist()
    mine.count()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text(books.recipe_text(1))
    ingest.ingest_batch(spark.read.format("binaryFile").load(str(tmp_path / "in")), Snapshots(spark, str(tmp_path / "index"), "chunks"))
    assert mine.storageLevel.useMemory and spark._jsparkSession.sharedState().cacheManager().lookupCachedData(mine._jdf).isDefined()
    mine.unpersist()
