"""Keyed state over streams: job state machines, conversation memory, sessions by idleness."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import fixed as fx
from ..operators import jobs as jb
from ..functions.text import truncate_answer_py

JOB_OUT = "id string, event string, status string, stage string, error string, at timestamp"


def _stamp(job: dict) -> str:
    return json.dumps(job, default=str)


def job_states(events: DataFrame) -> DataFrame:
    """(id, event, status, stage, error, at): the state after each event (id, event, fields as JSON, at). An event that is
    not legal changes nothing and says why; one bad event never ends the stream."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        job = json.loads(state.get[0]) if state.exists else None
        out = []
        for row in pd.concat(list(frames)).sort_values("at", kind="stable").itertuples():
            error = None
            try:
                job = jb.apply_event(job, row.event, row.at, **(json.loads(row.fields) if isinstance(row.fields, str) and row.fields else {}))
            except (ValueError, KeyError, TypeError) as e:
                error = str(e)
            out.append((key[0], row.event, job and job["status"], job and job.get("stage"), error, row.at))
        if job is not None:
            state.update((_stamp(job),))
        yield pd.DataFrame(out, columns=["id", "event", "status", "stage", "error", "at"])

    return events.groupBy("id").applyInPandasWithState(step, JOB_OUT, "job string", "append", GroupStateTimeout.NoTimeout)


TURNS_OUT = "conversation string, question string, answer string, position int"


def conversation_memory(turns: DataFrame, ttl_seconds: int = fx.TTL_SECONDS) -> DataFrame:
    """(conversation, question, answer, position) of what each conversation remembers after each batch of turns
    (conversation, question, answer, at). Idle conversations are forgotten by event time. The cap on the number of
    conversations is one over all keys: ``operators.memory.memory_of`` over the table of turns."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"conversation": [], "question": [], "answer": [], "position": []}).astype({"position": "int32"})
            return
        seen, kept = json.loads(state.get[0]) if state.exists else (0.0, [])
        new = pd.concat(list(frames)).sort_values("at", kind="stable")
        new = new[new.answer.fillna("").str.strip() != ""]
        for row in new.itertuples():
            fresh = row.at.timestamp() - seen > ttl_seconds
            kept = [*([] if fresh else kept), (row.question, truncate_answer_py(row.answer))][-fx.MAX_TURNS :]
            seen = row.at.timestamp()
        state.update((json.dumps([seen, kept]),))
        state.setTimeoutTimestamp(max(int((seen + ttl_seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], q, a, n) for n, (q, a) in enumerate(kept)], columns=["conversation", "question", "answer", "position"])

    marked = turns.withWatermark("at", f"{ttl_seconds} seconds")
    return marked.groupBy("conversation").applyInPandasWithState(step, TURNS_OUT, "memory string", "append", GroupStateTimeout.EventTimeTimeout)


def idle_sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, started, ended, n): sessions of a stream that a pause ends; ended is the last event plus the gap."""
    window = F.session_window(ts, gap)
    grouped = events.withWatermark(ts, late).groupBy(key, window.alias("w")).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


__all__ = ["conversation_memory", "idle_sessions", "job_states"]
