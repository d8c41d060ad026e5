"""The queue of jobs as a stateful stream, and the desk between it and ingestion.

Commands (create, cancel, retry, ...) and what ingestion reports (claim, stage, finish) are events of one stream, keyed by job. Each
job is a state machine of its own (``operators.jobs.apply_event``), so the queue spreads over tasks by job:

- a job that can still change is kept as long as that holds; one that has ended is forgotten after ``keep_seconds``;
- events that come before their job does are held for ``early_seconds`` and applied in order of time when it comes;
- a job in work that is silent for ``silence_seconds`` is interrupted by a timer, as a restart would.

Times are those of the machines that process (timers and expiry of one stream share one clock). Within a micro-batch a job's events
are applied by their time ``at``, ties by place; over batches in order of arrival. A job is known by the digest of its file.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators import jobs as jb

EVENTS = "id string, event string, fields string, at timestamp"
STATES = "id string, event string, status string, stage string, cancel_requested boolean, reason_code string, error string, at timestamp"
_COLUMNS = [c.split()[0] for c in STATES.split(", ")]
_MICROS = STATES.replace("at timestamp", "at bigint")  # times pass Python as numbers, so that no time zone is asked
#: The store that state with timers and lists needs.
PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _step(job: dict | None, event: str, micros: int, fields: str | None) -> tuple[dict | None, str | None]:
    try:
        return jb.apply_event(job, event, datetime.fromtimestamp(micros / 1e6, timezone.utc), **(json.loads(fields) if isinstance(fields, str) and fields else {})), None
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        return job, str(e)


def _row(key: str, job: dict | None, event: str, error: str | None, micros: int) -> tuple:
    job = job or {}
    return key, event, job.get("status"), job.get("stage"), bool(job.get("cancel_requested")), job.get("reason_code"), error, micros


def _can_change(job: dict) -> bool:
    return job["status"] in ("queued", "processing", "no_text") or bool(job["status"] == "error" and job["retryable"])


class JobMachine(StatefulProcessor):
    def __init__(self, silence_seconds: float, keep_seconds: float, early_seconds: float):
        self.silence, self.keep, self.early_for = (int(s * 1000) for s in (silence_seconds, keep_seconds, early_seconds))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "job string")
        self.ended = handle.getValueState("ended", "job string", self.keep)
        self.early = handle.getListState("early", "event string, fields string, micros bigint", self.early_for)

    def _known(self) -> dict | None:
        kept = self.job.get() or self.ended.get()
        return json.loads(kept[0]) if kept else None

    def _keep(self, job: dict) -> None:
        for state, on in ((self.job, _can_change(job)), (self.ended, not _can_change(job))):
            state.update((json.dumps(job, default=str),)) if on else state.clear()

    def _watch(self, job: dict, now: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if job["status"] == "processing":
            self.handle.registerTimer(now + self.silence)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        events = [(r.event, r.fields if isinstance(r.fields, str) else None, int(r.at)) for r in new.itertuples()]
        job = self._known()
        if job is None:
            events = [*(tuple(e) for e in self.early.get()), *events]
            if all(event != "create" for event, _, _ in events):
                if events:
                    self.early.put(events)
                return
            self.early.clear()
        out = []
        for event, fields, micros in sorted(events, key=lambda e: e[2]):
            job, error = _step(job, event, micros, fields)
            out.append(_row(key[0], job, event, error, micros))
        if job is not None:
            self._keep(job)
            self._watch(job, timerValues.getCurrentProcessingTimeInMs())
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        job, micros = self._known(), timerValues.getCurrentProcessingTimeInMs() * 1000
        if job is not None and job["status"] == "processing":
            job, error = _step(job, "interrupt", micros, None)
            self._keep(job)
            yield pd.DataFrame([_row(key[0], job, "interrupt", error, micros)], columns=_COLUMNS)

    def close(self) -> None:
        pass


def job_queue(events: DataFrame, silence_seconds: float = 900, keep_seconds: float = 7 * 86_400, early_seconds: float = 3_600) -> DataFrame:
    """The state after each event of a stream of ``EVENTS``, and after each interruption: rows of ``STATES``. An event that is not
    legal changes nothing and says why. Events without an id or a time are none. The session needs ``PROVIDER``."""
    machine = JobMachine(silence_seconds, keep_seconds, early_seconds)
    known = events.where("id IS NOT NULL AND at IS NOT NULL").select("id", "event", "fields", F.unix_micros("at").alias("at"))
    states = known.groupBy("id").transformWithStateInPandas(machine, _MICROS, "append", "ProcessingTime")
    return states.withColumn("at", F.timestamp_micros("at"))


def start(spark: SparkSession, folder: str, available_now: bool = False, **waits):
    """The queue over a folder: events from ``folder/events`` (JSON lines), states to ``folder/states``. With ``available_now`` it ends when
    the events there are done; timers then fire in batches that have events, for state with timers always asks for one batch more."""
    own = {**PROVIDER, "spark.sql.streaming.noDataMicroBatches.enabled": "false" if available_now else "true"}
    before = {name: spark.conf.get(name, None) for name in own}
    for name, value in own.items():
        spark.conf.set(name, value)
    try:
        events = spark.readStream.schema(EVENTS).json(f"{folder}/events")
        writer = job_queue(events, **waits).writeStream.format("parquet").option("path", f"{folder}/states").option("checkpointLocation", f"{folder}/checkpoint")
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="2 seconds")).start()
    finally:  # a query keeps the settings it was started with
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def latest(states: DataFrame) -> DataFrame:
    """The last state of each job. Of states of one time one that has ended counts as last, then one whose end is asked for."""
    last = F.struct("at", ~F.coalesce("status", F.lit("")).isin("", "queued", "processing"), "cancel_requested")
    return states.groupBy("id").agg(F.max_by(F.struct("status", "stage", "cancel_requested", "reason_code"), last).alias("_s"), F.max("at").alias("at")).select("id", "_s.*", "at")


class Desk:
    """What ingestion tells the queue and asks of it. ``between`` and ``done`` are parameters of ``ingest.ingest_batch``."""

    def __init__(self, spark: SparkSession, folder: str, clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc)):
        self.spark, self.folder, self.clock = spark, folder.rstrip("/"), clock

    def put(self, events: DataFrame) -> None:
        """Add events (id, event, fields); one file set is seen whole or not at all, and is never written twice."""
        now = F.lit(self.clock().isoformat()).cast("timestamp")
        events.select("id", "event", "fields", now.alias("at")).write.mode("append").json(f"{self.folder}/events")

    def command(self, event: str, *ids: str, **fields) -> None:
        self.put(self.spark.createDataFrame([(i, event, json.dumps(fields)) for i in ids], "id string, event string, fields string"))

    def cancelled(self) -> DataFrame:
        """(md5) of jobs in work whose end is asked for, and of those cancelled before."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/states")
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], "md5 string")
        states = self.spark.read.schema(STATES).parquet(f"{self.folder}/states")
        return latest(states).where("status = 'cancelled' OR (status = 'processing' AND cancel_requested)").select(F.col("id").alias("md5"))

    def between(self, stage: str, files: DataFrame) -> DataFrame:
        if stage == "extracting":
            self.put(files.select(F.col("md5").alias("id"), F.lit("claim").alias("event"), F.lit("{}").alias("fields")))
        self.put(files.select(F.col("md5").alias("id"), F.lit("stage").alias("event"), F.to_json(F.struct(F.lit(stage).alias("stage"))).alias("fields")))
        return self.cancelled()

    def done(self, outcomes: DataFrame) -> None:
        fields = F.to_json(F.struct("status", "reason_code", "book_title", "book_slug", "duplicate_of"))
        self.put(outcomes.select(F.col("md5").alias("id"), F.lit("finish").alias("event"), fields.alias("fields")))


__all__ = ["Desk", "EVENTS", "JobMachine", "STATES", "job_queue", "latest", "start"]
