from __future__ import annotations

import datetime

import pytest

from corpusloom.functions import fixed as fx
from corpusloom.operators import jobs as jb
from corpusloom.operators.memory import memory_of

NOW = datetime.datetime(2024, 1, 1)


def new(**k):
    return jb.apply_event(None, "create", NOW, id="a", filename="livro.pdf", **k)


def running():
    return jb.apply_event(new(), "claim", NOW)


@pytest.mark.parametrize("status", fx.STATUSES)
def test_only_listed_transitions(status):
    for to in fx.STATUSES:
        job = {**running(), "status": status}
        if to in fx.ACTIVE_STATUSES:
            continue
        if (status, to) in fx.TRANSITIONS:
            assert jb.apply_event(job, "finish", NOW, status=to)["status"] == to
        else:
            with pytest.raises(jb.InvalidTransition):
                jb.apply_event(job, "finish", NOW, status=to)


@pytest.mark.parametrize(("reason", "retryable"), [("embeddings_unavailable", True), ("interrupted", True), ("internal", True), ("corrupt", False), (None, False)])
def test_retryable(reason, retryable):
    job = jb.apply_event(running(), "finish", NOW, status="error", reason_code=reason)
    assert job["retryable"] is retryable and (job["finished_at"] is None) is retryable
    if retryable:
        assert jb.apply_event(job, "retry", NOW)["status"] == "queued"


def test_cancel():
    assert jb.apply_event(new(), "cancel", NOW)["status"] == "cancelled"
    asked = jb.apply_event(running(), "cancel", NOW)
    assert asked["cancel_requested"] and jb.apply_event(asked, "stage", NOW, stage="ocr")["stage"] is None
    assert jb.apply_event(asked, "interrupt", NOW)["status"] == "cancelled"
    late = jb.apply_event(running(), "stage", NOW, stage="indexing")
    with pytest.raises(jb.InvalidTransition, match="too_late"):
        jb.apply_event(late, "cancel", NOW)


def test_no_text_goes_on():
    job = jb.apply_event(running(), "finish", NOW, status="no_text", reason_code="partial_text")
    assert job["finished_at"] is None
    assert jb.apply_event(job, "ocr", NOW)["ocr_mode"] == "ocr"
    assert jb.apply_event(job, "continue_without_ocr", NOW)["ocr_mode"] == "skip_ocr"
    with pytest.raises(jb.InvalidTransition):
        jb.apply_event({**job, "reason_code": "no_text"}, "continue_without_ocr", NOW)


def test_table_view(spark):
    rows = [{**dict.fromkeys([c.split()[0] for c in jb.SCHEMA.split(", ")]), **j, "created_at": NOW, "updated_at": NOW} for j in (new(), running(), {**new(), "status": "added", "progress_total": 3, "book_title": "T"})]
    jobs = spark.createDataFrame([tuple(r[c.split()[0]] for c in jb.SCHEMA.split(", ")) for r in rows], jb.SCHEMA)
    out = jb.for_api(jobs).collect()
    assert [r.actions for r in out] == [["cancel"], ["cancel"], []]
    assert out[0].progress is None and out[2].progress.total == 3 and out[2].result.book_title == "T" and out[0].created_at == "2024-01-01T00:00:00.000000Z"


def test_pages(spark):
    rows = [(n, NOW + datetime.timedelta(minutes=n)) for n in range(7)]
    jobs = spark.createDataFrame(rows, "id long, created_at timestamp")
    seen, cursor = [], None
    for _ in range(3):
        page = jb.page(jobs, None if cursor is None else jb.F.lit(cursor), 3).collect()
        seen += [r.id for r in page]
        cursor = jb.next_cursor(page, 3)
    assert seen == [6, 5, 4, 3, 2, 1, 0] and cursor is None


def test_conversation_memory(spark):
    at = lambda s: NOW + datetime.timedelta(seconds=s)
    rows = [("a", f"q{n}", f"resposta [1] {n} [23]", at(n)) for n in range(3)] + [("b", "q", "x", at(20)), ("c", "old", "y", at(3)), ("c", "q", "palavra " * 400, at(22)), ("d", "q", "  ", at(22)), (None, "q", "x", at(22)), ("", "q", "x", at(22))]
    turns = spark.createDataFrame(rows, "conversation string, question string, answer string, at timestamp")
    held = lambda s, **k: {(r.conversation, r.position): (r.question, r.answer) for r in memory_of(turns, at(s), ttl_seconds=10, **k).collect()}
    assert held(2, most=2) == {("a", 0): ("q1", "resposta 1"), ("a", 1): ("q2", "resposta 2")}
    assert set(held(12)) == {("a", 0), ("a", 1), ("a", 2), ("c", 0)} and set(held(13)) == {("c", 0)}
    late = held(22)
    assert set(late) == {("b", 0), ("c", 0)} and late["c", 0][0] == "q"  # what stood before the pause is forgotten
    assert late["c", 0][1].endswith("palavra …") and len(late["c", 0][1]) <= 1502
    assert set(held(22, conversations=1)) == {("c", 0)} and held(40) == {}
