"""The ingestion queue as a table: pages, claims, legal transitions and what may be done with a job."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as fx

SCHEMA = (
    "id string, filename string, format string, size_bytes long, file_md5 string, status string, stage string, progress_current int, progress_total int, "
    "reason_code string, reason_detail string, retryable boolean, ocr_mode string, pages_total int, pages_without_text int, book_title string, book_slug string, "
    "lang string, n_chunks int, duplicate_of string, cancel_requested boolean, staged_path string, created_at timestamp, updated_at timestamp, finished_at timestamp"
)


class InvalidTransition(ValueError):
    pass


def transitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(fx.TRANSITIONS), "from_status string, to_status string")


def page(jobs: DataFrame, before: datetime | Column | None = None, limit: int = 50, created: str = "created_at", key: str = "id") -> DataFrame:
    """The newest jobs first, those created before ``before``; 1 to 200 of them. The cursor is the time alone."""
    source = jobs if before is None else jobs.where(F.col(created) < before)
    return source.orderBy(F.desc(created), F.desc(key)).limit(min(max(limit, 1), 200))


def next_cursor(rows: list, limit: int, created: str = "created_at"):
    return rows[-1][created] if rows and len(rows) == limit else None


def oldest_queued(jobs: DataFrame, created: str = "created_at", key: str = "id") -> DataFrame:
    return jobs.where(F.col("status") == "queued").orderBy(created, key).limit(1)


def has_active(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.coalesce(F.bool_or(F.col("status").isin(*fx.ACTIVE_STATUSES)), F.lit(False)).alias("active"))


def by_digest(jobs: DataFrame, md5: str, statuses=("added",), created: str = "created_at") -> DataFrame:
    return jobs.where((F.col("file_md5") == md5) & F.col("status").isin(*statuses)).orderBy(created).limit(1)


def illegal(changes: DataFrame, from_status: str = "from_status", to_status: str = "to_status") -> DataFrame:
    """Changes that are none of the legal transitions. Those are thirteen rows: broadcast."""
    legal = F.broadcast(transitions(changes.sparkSession).select(F.col("from_status").alias("_f"), F.col("to_status").alias("_t")))
    return changes.join(legal, (F.col(from_status) == F.col("_f")) & (F.col(to_status) == F.col("_t")), "left_anti")


def is_active() -> Column:
    """Jobs that wait or run; all others, those without a status too, are history."""
    return F.coalesce(F.col("status").isin(*fx.ACTIVE_STATUSES), F.lit(False))


def joined_pages(recent: DataFrame, older: DataFrame, key: str = "id") -> DataFrame:
    """The rows of a newer page and those of older pages that it does not hold: a job that has moved up is shown once, as it is now."""
    return recent.unionByName(older.join(recent.select(key), key, "left_anti"), allowMissingColumns=True)


def retitled(jobs: DataFrame, labels: DataFrame, title: str = "book_title") -> DataFrame:
    """Jobs that name a book by an old title name it by the new one; ``labels`` are (old, new), as ``maintenance.relabels`` gives them."""
    renamed = labels.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    return jobs.join(renamed, F.col(title) == F.col("_old"), "left").withColumn(title, F.coalesce("_new", title)).select(*jobs.columns)


def recovered(jobs: DataFrame, processed: DataFrame, meta: DataFrame, now: datetime | Column) -> DataFrame:
    """The queue after a restart. A running job whose file is in the index (``processed``: md5, slug, n_chunks, one row for each md5) was
    only not told so: it is added, named by ``meta`` (slug, title, lang) or else by its slug. Any other running job is cancelled if
    that was asked for, and else an error that may be retried. A second restart changes nothing."""
    now = now if isinstance(now, Column) else F.lit(now)
    titles = meta.select(F.col("slug").alias("_slug"), F.col("title").alias("_title"), F.col("lang").alias("_lang"))
    there = processed.where("n_chunks > 0").select(F.col("md5").alias("_md5"), F.col("slug").alias("_slug"), F.col("n_chunks").alias("_n")).join(titles, "_slug", "left")
    both = jobs.join(there, (F.col("file_md5") == F.col("_md5")) & (F.col("status") == "processing"), "left")
    running = F.coalesce(F.col("status") == "processing", F.lit(False))
    added = running & F.col("_md5").isNotNull()
    stopped = running & F.col("_md5").isNull()
    asked = stopped & F.coalesce("cancel_requested", F.lit(False))
    failed = stopped & ~asked
    titled = F.coalesce(F.when(F.col("_title") != "", F.col("_title")), "_slug")
    changed = {
        "status": F.when(added, F.lit("added")).when(asked, F.lit("cancelled")).when(failed, F.lit("error")).otherwise(F.col("status")),
        "reason_code": F.when(failed, F.lit("interrupted")).otherwise(F.col("reason_code")),
        "retryable": F.when(added | failed, failed).otherwise(F.col("retryable")),
        "updated_at": F.when(running, now).otherwise(F.col("updated_at")),
        "finished_at": F.when(added | asked, now).otherwise(F.col("finished_at")),
        **{c: F.when(~running, F.col(c)) for c in ("stage", "progress_current", "progress_total")},
        **{c: F.when(added, v).otherwise(F.col(c)) for c, v in (("book_title", titled), ("book_slug", F.col("_slug")), ("lang", F.col("_lang")), ("n_chunks", F.col("_n")))},
    }
    return both.withColumns(changed).select(*jobs.columns)


def actions(ocr_available: bool = True) -> Column:
    """What may be asked for a job."""
    status = F.col("status")
    words = lambda *w: F.array(*map(F.lit, w))
    offered = words("ocr") if ocr_available else F.array().cast("array<string>")
    paused = F.when(F.col("reason_code") == "partial_text", F.concat(offered, words("continue_without_ocr", "cancel"))).otherwise(F.concat(offered, words("cancel")))
    running = ~F.coalesce("cancel_requested", F.lit(False)) & ~F.coalesce(F.col("stage").isin(*fx.UNCANCELLABLE_STAGES), F.lit(False))
    return (
        F.when((status == "error") & F.col("retryable"), words("retry"))
        .when(status == "no_text", paused)
        .when((status == "queued") | ((status == "processing") & running), words("cancel"))
        .otherwise(F.array().cast("array<string>"))
    )


def for_api(jobs: DataFrame, ocr_available: bool = True) -> DataFrame:
    """The fields an interface shows, with progress and result as structs or null."""
    from ..functions.text import iso_micros

    progress = F.when(F.coalesce("progress_total", F.lit(0)) != 0, F.struct(F.coalesce("progress_current", F.lit(0)).alias("current"), F.col("progress_total").alias("total")))
    result = F.when(F.col("status") == "added", F.struct("book_title", "lang", "n_chunks", "pages_without_text"))
    plain = ["id", "filename", "format", "size_bytes", "status", "stage", "reason_code", "reason_detail", "retryable", "cancel_requested", "pages_total", "pages_without_text", "duplicate_of"]
    return jobs.select(*plain, progress.alias("progress"), actions(ocr_available).alias("actions"), result.alias("result"), *(iso_micros(F.col(c)).alias(c) for c in ("created_at", "updated_at", "finished_at")))


# ------------------------------------------------------------------ one job's state


def start(job: dict, now: datetime) -> dict:
    status = job.get("status", "queued")
    if ("new", status) not in fx.TRANSITIONS:
        raise InvalidTransition(f"new -> {status}")
    base = {"ocr_mode": "none", "retryable": False, "cancel_requested": False, "stage": None, "progress_current": None, "progress_total": None, "reason_code": None, "reason_detail": None}
    return {**base, **job, "status": status, "created_at": now, "updated_at": now, "finished_at": None if status in fx.ACTIVE_STATUSES else now}


def _moved(job: dict, to: str, now: datetime, **fields) -> dict:
    if (job["status"], to) not in fx.TRANSITIONS:
        raise InvalidTransition(f"{job['status']} -> {to}")
    return {**job, **fields, "status": to, "updated_at": now}


_IDLE = {"stage": None, "progress_current": None, "progress_total": None}


def apply_event(job: dict | None, event: str, now: datetime, **fields) -> dict:
    """The job after an event: create, claim, stage, finish, cancel, interrupt, retry, ocr, continue_without_ocr."""
    if event == "create":
        return start(fields, now)
    if job is None:
        raise KeyError("no such job")
    if event == "claim":
        return _moved(job, "processing", now, **_IDLE, reason_code=None, reason_detail=None, retryable=False)
    if event == "stage":
        if fields["stage"] not in fx.STAGES:
            raise ValueError(fields["stage"])
        if job["status"] != "processing" or job["cancel_requested"]:
            return job
        return {**job, "stage": fields["stage"], "progress_current": fields.get("current"), "progress_total": fields.get("total"), "updated_at": now}
    if event == "finish":
        status = fields.pop("status")
        if status in fx.ACTIVE_STATUSES:
            raise ValueError(status)
        retryable = bool(fields.pop("retryable", status == "error" and fields.get("reason_code") in fx.RETRYABLE_REASONS))
        resumable = status == "no_text" or (status == "error" and retryable)
        return _moved(job, status, now, **fields, **_IDLE, retryable=retryable, finished_at=job["finished_at"] if resumable else now)
    if event == "cancel":
        if job["status"] in ("queued", "no_text"):
            return _moved(job, "cancelled", now, reason_code=None, retryable=False, finished_at=now)
        if job["status"] == "processing" and job["stage"] not in fx.UNCANCELLABLE_STAGES:
            return {**job, "cancel_requested": True, "updated_at": now}
        raise InvalidTransition("too_late" if job["status"] == "processing" else f"cancel in {job['status']}")
    if event == "interrupt":
        if job["status"] != "processing":
            return job
        if job["cancel_requested"]:
            return _moved(job, "cancelled", now, **_IDLE, finished_at=now)
        return _moved(job, "error", now, **_IDLE, reason_code="interrupted", retryable=True)
    allowed = {"retry": job["status"] == "error" and job["retryable"], "ocr": job["status"] == "no_text", "continue_without_ocr": job["status"] == "no_text" and job["reason_code"] == "partial_text"}
    if not allowed.get(event):
        raise InvalidTransition(f"{event} in {job['status']}")
    mode = {"ocr": "ocr", "continue_without_ocr": "skip_ocr"}.get(event, job["ocr_mode"])
    return _moved(job, "queued", now, reason_code=None, reason_detail=None, retryable=False, finished_at=None, ocr_mode=mode)
