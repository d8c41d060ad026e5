"""Helpers shared by the training-data operators: tables, scratch space, worker paths, Arrow maps."""

from __future__ import annotations

import functools
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package and give the session a checkpoint folder if it has none.

    A cluster names its shared folder in ``spark.checkpoint.dir``; a temporary folder is used only
    where that is unset and all tasks run on this machine, as in tests.
    """
    sc = spark.sparkContext
    parts = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in parts:
        sc.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *parts])
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # the default; texts can be long
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="corpusloom-"))
    return spark


#: Tables whose rows are work: where a small file makes fewer partitions than there are cores, they are dealt out first.
TEXTS = ("documents", "pages", "embeddings")


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    df = df.select(*columns) if columns else df
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in TEXTS and df.rdd.getNumPartitions() < cores else df


def stored(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """Write ``df`` into the shared scratch folder and read it back: cuts lineage, survives lost executors. ``tidy`` has the shuffle
    files of this write removed at its end, where the session can do that."""
    spark = prepare(df.sparkSession)
    base = spark.sparkContext.getCheckpointDir() or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    path = f"{base.rstrip('/')}/corpusloom/{name}-{uuid.uuid4().hex}"
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(setting, None)
    if tidy:
        spark.conf.set(setting, "true")
    try:
        df.write.parquet(path)
    finally:
        if tidy:
            spark.conf.unset(setting) if was is None else spark.conf.set(setting, was)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)  # with the driver's end, not before
    return spark.read.schema(df.schema).parquet(path)


def smallest_hashes(df: DataFrame, column: str, n: int) -> DataFrame:
    """The distinct ``column`` values of the ``n`` smallest hashes, null aside. A first cut by the share of the hash range that
    holds about twice as many keeps what meets in one task small at any size and however often values repeat."""
    named = df.where(F.col(column).isNotNull()).select(column)
    held = named.agg(F.approx_count_distinct(column, 0.02)).first()[0]
    share = 2 * (n + 500) / max(held, 1)
    near = named.where(F.pmod(F.xxhash64(column), F.lit(1 << 40)) < int(min(share, 1.0) * (1 << 40)))
    return near.distinct().orderBy(F.pmod(F.xxhash64(column), F.lit(1 << 40)), column).limit(n)


def hot_keys(df: DataFrame, key: str, most: int = 1000, least: int = 1000, part: int = 100_000) -> DataFrame:
    """(key, parts): the values of ``key`` that hold a thousandth (1 / ``most``) of all rows and ``least`` rows at least, so
    ``most`` at most: their number bounds what is broadcast of them. ``parts`` deals their rows out at ``part`` each. A sketch of
    bounded size counts them in one pass, without a shuffle of rows."""
    top = df.agg(F.expr(f"approx_top_k({key}, {most}, {100 * most})").alias("top"), F.count(key).alias("n")).first()
    found = [(t["item"], -(-t["count"] // part)) for t in top.top or () if t["count"] >= max(top.n / most, least)]
    return df.sparkSession.createDataFrame(found, f"`{key}` {df.schema[key].dataType.simpleString()}, parts long")


def lookup(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each ``key``. Rows of hot keys stay where they are: what the table says of
    those keys, a thousand at most, is broadcast to them; the rest meets by a shuffle."""
    hot = hot_keys(rows, key, least=200).select(key)
    if hot.isEmpty():
        return rows.join(table, key, how)
    hot = F.broadcast(hot)
    few = rows.join(hot, key, "left_anti").join(table, key, how)
    return few.unionByName(rows.join(hot, key, "left_semi").join(F.broadcast(table.join(hot, key, "left_semi")), key, how))


def tag_of(df: DataFrame, tag: str = "_op_") -> str:
    """A beginning that no column of ``df`` has, for columns of an operator's own."""
    while any(c.lower().startswith(tag) for c in df.columns):
        tag = "_" + tag
    return tag


def by_size(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """``df``, of narrow rows and written before, marked for broadcast if it has ``rows`` rows at most; a shuffle join serves beyond."""
    return F.broadcast(df) if df.count() <= rows else df


def without_gc(f: Callable) -> Callable:
    """For functions that make many objects and no cycles: the collector would walk all of them again and again."""

    @functools.wraps(f)
    def run(*args, **named):
        was = gc.isenabled()
        gc.disable()
        try:
            return f(*args, **named)
        finally:
            if was:
                gc.enable()

    return run


def utf8(column: str):
    """The column as UTF-8 bytes; Python workers then get bytes without decoding."""
    return F.col(column).cast("binary").alias(column)


def map_rows(df: DataFrame, rows: Callable[..., list], schema: str, block: int = 2000) -> DataFrame:
    """mapInArrow over blocks of at most ``block`` rows: ``rows`` gets one list for each column and
    returns one list (or numpy array) for each output column."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                made = rows(*[part.column(i).to_pylist() for i in range(part.num_columns)])
                yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(made, out)], schema=out)

    return df.mapInArrow(run, schema)
