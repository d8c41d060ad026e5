"""Conversations: the turns remembered, and sessions that end with idleness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as fx
from ..functions import text as tx


def last_turns(turns: DataFrame, conversation: str, order: str, most: int = fx.MAX_TURNS) -> DataFrame:
    w = Window.partitionBy(conversation).orderBy(F.desc(order))
    return turns.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def remembered(turns: DataFrame, answer: str) -> DataFrame:
    """Turns with an answer, as memory keeps it: no citations, and not too long."""
    return turns.where(F.trim(answer) != "").withColumn(answer, tx.truncate_answer(F.col(answer)))


def sessions(events: DataFrame, key: str, ts: str, idle_seconds: int = fx.TTL_SECONDS) -> DataFrame:
    """(key, session, started, ended, n): a pause longer than ``idle_seconds`` ends a session."""
    w = Window.partitionBy(key).orderBy(ts)
    fresh = F.coalesce(F.timestamp_diff("MICROSECOND", F.lag(ts).over(w), F.col(ts)) > idle_seconds * 1_000_000, F.lit(True))
    numbered = events.withColumn("_new", fresh.cast("int")).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n"))


def memory_of(turns: DataFrame, now, conversation: str = "conversation", question: str = "question", answer: str = "answer", at: str = "at", most: int = fx.MAX_TURNS, ttl_seconds: int = fx.TTL_SECONDS, conversations: int = fx.MAX_CONVERSATIONS) -> DataFrame:
    """(conversation, question, answer, at, position) that is remembered at ``now``: of conversations whose last turn is not older than
    ``ttl_seconds``, the ``conversations`` of the latest last turns (ties by name), their last ``most`` answered turns since the
    last pause that made them forgotten. Turns without a conversation or an answer are none."""
    now = F.lit(now)
    told = remembered(turns.where(F.coalesce(F.col(conversation), F.lit("")) != ""), answer).where(F.col(at) <= now)
    w = Window.partitionBy(conversation).orderBy(at)
    pause = F.coalesce(F.timestamp_diff("MICROSECOND", F.lag(at).over(w), F.col(at)) > ttl_seconds * 1_000_000, F.lit(False))
    since = told.withColumn("_s", F.sum(pause.cast("int")).over(w))
    last = since.groupBy(conversation).agg(F.max(at).alias("_last"), F.max("_s").alias("_s"))
    live = last.where(F.timestamp_diff("MICROSECOND", F.col("_last"), now) <= ttl_seconds * 1_000_000).orderBy(F.desc("_last"), conversation).limit(conversations)
    kept = last_turns(since.join(F.broadcast(live.drop("_last")), [conversation, "_s"]), conversation, at, most)
    return kept.select(conversation, question, answer, at, (F.row_number().over(w) - 1).alias("position"))
