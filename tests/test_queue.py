from __future__ import annotations

import hashlib
import json
import random
import time
from datetime import datetime, timedelta, timezone

import books
import pytest
from test_streaming import files_of

from corpusloom.functions import fixed as fx
from corpusloom.operators import jobs as jb
from corpusloom.operators.maintenance import Snapshots
from corpusloom.streaming import ingest, queue

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def event(job, name, at, **fields):
    return {"id": job, "event": name, "fields": json.dumps(fields), "at": (START + timedelta(seconds=at)).isoformat()}


@pytest.fixture(autouse=True)
def small(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # a stream of state starts a Python worker for each partition
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture
def desk(spark, tmp_path):
    """Puts events into the queue's folder; each run is a stream of its own, started again from the checkpoint."""
    (tmp_path / "events").mkdir()

    def run(events, **waits):
        if events:
            files_of(tmp_path / "events", events)
        queue.start(spark, str(tmp_path), available_now=True, **waits).awaitTermination(120)
        return sorted((r.at.replace(tzinfo=timezone.utc), r.id, r.event, r.status, r.stage, r.cancel_requested, r.error) for r in spark.read.parquet(f"{tmp_path}/states").collect())

    return run


def replay(events):
    """One machine over all events, in order."""
    jobs, out = {}, []
    for e in sorted(events, key=lambda e: e["at"]):
        error = None
        try:
            jobs[e["id"]] = jb.apply_event(jobs.get(e["id"]), e["event"], datetime.fromisoformat(e["at"]), **json.loads(e["fields"]))
        except (ValueError, KeyError, TypeError) as x:
            error = str(x)
        job = jobs.get(e["id"]) or {}
        out.append((datetime.fromisoformat(e["at"]), e["id"], e["event"], job.get("status"), job.get("stage"), bool(job.get("cancel_requested")), error))
    return sorted(out)


def test_restarts_equal_one_replay(desk):
    rng = random.Random(4)
    events = [event(f"j{n}", "create", n) for n in range(25)]
    for at in range(25, 260):
        name = rng.choice(["claim", "claim", "stage", "stage", "finish", "finish", "cancel", "retry", "ocr", "interrupt", "unknown"])
        fields = {"stage": {"stage": rng.choice([*fx.STAGES, "none such"])}, "finish": {"status": rng.choice(["added", "error", "no_text", "queued"]), "reason_code": rng.choice(["internal", "corrupt"])}}.get(name, {})
        events.append(event(f"j{rng.randrange(25)}", name, at, **fields))
    for lo, hi in ((0, 90), (90, 260)):
        batch = events[lo:hi]
        rng.shuffle(batch)
        rows = desk(batch)
    assert rows == replay(events) and len({r[3] for r in rows}) >= 5


def test_events_before_their_job_wait(desk):
    first, then = [event("a", "claim", 2), event("a", "stage", 3, stage="cleaning"), event("b", "claim", 2)], [event("a", "create", 1)]
    assert desk([*first, event("c", "create", 0)]) == replay([event("c", "create", 0)])
    assert desk(then) == replay([*first[:2], *then, event("c", "create", 0)])


def test_silence_interrupts_and_the_ended_are_forgotten(desk):
    desk([event("a", "create", 0), event("a", "claim", 1), event("b", "create", 0), event("b", "claim", 1), event("b", "cancel", 2), event("d", "create", 0), event("d", "cancel", 1)], silence_seconds=0.5, keep_seconds=0.5)
    time.sleep(1)
    rows = desk([event("c", "create", 3), event("d", "create", 3), event("e", "cancel", 3)], silence_seconds=0.5, keep_seconds=0.5)
    assert [(r[1], r[3]) for r in rows if r[2] == "interrupt"] in ([("a", "error"), ("b", "cancelled")], [("b", "cancelled"), ("a", "error")])
    rows = desk([event("a", "retry", 4), event("a", "claim", 5)])  # the timer of a job that went on is gone
    assert [r[3] for r in rows if r[1] == "a" and r[2] in ("retry", "claim")] == ["processing", "queued", "processing"]
    assert not [r for r in rows if r[1] == "e"]


def test_ingestion_reports_and_stops_between_stages(spark, tmp_path):
    folder, at = tmp_path / "in", tmp_path / "queue"
    folder.mkdir()
    digest = {}
    for n in (1, 9, 5):
        (folder / f"livro{n}.md").write_text(books.recipe_text(n))
        digest[n] = hashlib.md5((folder / f"livro{n}.md").read_bytes()).hexdigest()
    desk = queue.Desk(spark, str(at))
    desk.command("create", *digest.values())
    desk.command("cancel", digest[5])  # before anything is done

    def run():
        queue.start(spark, str(at), available_now=True).awaitTermination(120)

    run()
    seen = []

    def between(stage, files):
        seen.append((stage, files.count()))
        if stage == "embedding":
            desk.command("cancel", digest[9])
            run()
        return desk.between(stage, files)

    files = spark.read.format("binaryFile").schema(ingest.FILES).load(str(folder))
    index = Snapshots(spark, str(tmp_path / "index"), "chunks")
    ingest.ingest_batch(files, index, between=between, done=desk.done)
    run()
    assert seen == [("extracting", 3), ("cleaning", 2), ("embedding", 2), ("checking_duplicates", 1)]
    assert {(r.md5, r.status) for r in index.read("jobs").collect()} == {(digest[1], "added"), (digest[9], "cancelled"), (digest[5], "cancelled")}
    assert {r.md5 for r in index.read("processed").collect()} == {digest[1]} and {r.title for r in index.read("books").collect()} == {"livro1"}
    states = {r.id: r for r in queue.latest(spark.read.parquet(f"{at}/states")).collect()}
    assert {k: (states[v].status, states[v].stage) for k, v in digest.items()} == {1: ("added", None), 9: ("cancelled", None), 5: ("cancelled", None)}
    # uploaded again, a cancelled file is taken in
    desk.command("create", digest[9])
    run()
    ingest.ingest_batch(files, index, between=desk.between, done=desk.done)
    run()
    assert {r.title for r in index.read("books").collect()} == {"livro1", "livro9"}
