"""Ingestion as a stream: files arrive in a folder, each micro-batch is curated and committed as one version of the index.

A batch is idempotent: what is already processed (by content digest) is left out by an anti-join against the index's own
table of processed files, which one pointer commits together with the chunks, the books and the outcomes of jobs. A batch that
fails at any step before that pointer has added nothing, and one replayed after it adds nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors
from ..operators import catalog, curate, dedup, maintenance, postings
from ..operators.order import cut
from ..sources import readers

FILES = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, folder: str, per_batch: int = 100) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", per_batch).load(folder)


def named(files: DataFrame) -> DataFrame:
    name = F.url_decode(F.replace(F.regexp_replace("path", "^.*/", ""), F.lit("+"), F.lit("%2B")))
    kept = files.select(name.alias("name"), F.col("length").alias("size"), "content").where(~F.startswith("name", F.lit(".")))
    return kept.select("name", tx.extension(F.col("name")).alias("ext"), "size", F.md5("content").alias("md5"), "content")


def ingest_batch(files: DataFrame, index: maintenance.Snapshots, embed: Callable[[DataFrame, str], DataFrame] = vectors.with_hashed_embedding, fresh: bool = False, between: Callable[[str, DataFrame], DataFrame] | None = None, done: Callable[[DataFrame], None] | None = None) -> None:
    """Take in the files of a batch that are new: text, coverage, cleaning and tier, chunks, vectors (``embed`` adds ``embedding``),
    near copies of indexed books and of earlier ones of the batch, metadata and labels that are not taken. One commit appends ``chunks``, their ``postings`` and
    ``grams``, ``books``, ``processed`` and ``jobs``, the outcome of each file:

    added; error (unreadable, with its code); no_text (too many pages without text); discarded (with the curation's reason);
    duplicate (duplicate_content: by neighbours and shared text the book duplicate_of). Errors and files without text are not
    marked processed, so they may come again. Files of a batch count as if they came one after another, by name: one that an earlier one
    that is added contains enough of is its copy; inside a batch shared text alone says so. With ``fresh``
    all files count as new and the commit puts the tables in place of those there; ``jobs`` keeps its earlier rows.

    ``between`` is called before each stage that can still be cancelled with its name and the files (md5, name) that go into it, and
    says whose (md5) jobs are cancelled: those go no further, and their outcome is cancelled. They are not processed either, nor do they
    keep a later copy out. ``done`` gets the outcomes (rows of ``jobs``) after the commit. ``queue.Desk`` has both.

    All of it happens under the index's lock, so what it reads is what its commit builds on."""
    with index.lock():
        outcomes = _ingest(files, index, embed, fresh, between)
    if done:
        done(outcomes)


def _ingest(files: DataFrame, index: maintenance.Snapshots, embed: Callable[[DataFrame, str], DataFrame], fresh: bool, between: Callable[[str, DataFrame], DataFrame] | None) -> DataFrame:
    stopped: list[DataFrame] = []

    def going(stage: str, df: DataFrame) -> DataFrame:
        if between is None:
            return df
        in_work = cut(df.select("md5", "name"))
        asked = between(stage, in_work).select("md5").distinct()
        stopped.append(cut(in_work.join(asked, "md5", "left_semi")))
        return df.join(stopped[-1].select("md5"), "md5", "left_anti")

    # What several tables follow from is written once: plans stay short, and a lost executor costs a re-read.
    found = readers.candidates(named(files))
    if index.has("processed") and not fresh:
        found = maintenance.not_processed(found, index.read("processed"))
    found = going("extracting", dedup.preferred_copy(found))
    texts = cut(readers.extract_all(found).drop("content").withColumn("coverage", tx.text_coverage(F.col("pages_without_text"), F.col("pages_total"))))
    texts = going("cleaning", texts)
    known = index.has("chunks") and not fresh
    taken = index.read("processed").select("slug").where("slug IS NOT NULL") if known else texts.select(F.lit("").alias("slug")).limit(0)
    slugged = maintenance.unique_slugs(texts.withColumn("slug", tx.safe_slug(F.col("name"))), taken)
    readable = slugged.where("error IS NULL AND coverage = 'ok'")
    prepared = cut(curate.prepare(readable, "md5", "text").join(readable.select("md5", "name", "slug"), "md5"))
    prepared = going("embedding", prepared)
    rows = cut(embed(curate.chunk_rows(prepared.withColumn("book", F.col("slug")), "slug", "book", "md5", "name").withColumn("_e", tx.embed_text(F.col("title"), F.col("text"))), "_e").drop("_e"))
    prepared = going("checking_duplicates", prepared)
    rows = rows.join(stopped[-1].select("md5"), "md5", "left_anti") if stopped else rows
    same = dedup.find_duplicates(rows.withColumnRenamed("book", "new_book"), index.read("chunks")).select(F.col("new_book").alias("slug"), F.col("book").alias("duplicate_of")) if known else prepared.select("slug", F.lit("").alias("duplicate_of")).limit(0)
    same = cut(same)
    alone = prepared.where("discard_reason IS NULL").limit(2).count() < 2
    within = None if alone else dedup.copies_within(rows.withColumn("_place", F.struct("name", "md5")), "book", "id", "text", "_place")
    within = prepared.select("slug", F.lit("").alias("earlier")).limit(0) if alone else dedup.first_kept(within, same.select(F.col("slug").alias("later"))).select(F.col("later").alias("slug"), "earlier")
    within = cut(within)
    kept = prepared.where("discard_reason IS NULL").join(same, "slug", "left_anti").join(within, "slug", "left_anti").withColumn("n_chunks", F.size("pieces"))
    meta = catalog.book_meta(kept.withColumnRenamed("slug", "_slug").withColumn("_id", F.col("md5")), "name", "cleaned", "lang", "tier", "_id").withColumnRenamed("n_recipes", "md5")
    named_books = meta.join(kept.select("md5", "slug", F.col("name").alias("filename"), "n_chunks"), "md5")
    titles = index.read("books").select("title") if known else named_books.select("title").limit(0)
    books = cut(maintenance.distinct_labels(named_books, titles, among=True).drop("book"))
    chunks = rows.drop("book", "name").join(books.select("md5", F.col("title").alias("book"), "region", "dish_types"), "md5")
    same = same.unionByName(within.join(books.select(F.col("slug").alias("earlier"), F.col("title").alias("duplicate_of")), "earlier").select("slug", "duplicate_of"))
    cancelled = reduce(DataFrame.unionByName, stopped) if stopped else None
    slugged = slugged.join(cancelled.select("md5"), "md5", "left_anti") if stopped else slugged
    of = slugged.select("md5", "name", "slug", "error", "coverage", "pages_total", "pages_without_text").join(prepared.select("md5", "discard_reason"), "md5", "left").join(same, "slug", "left").join(books.select("md5", "title", "lang", "n_chunks"), "md5", "left")
    status = F.when(F.col("error").isNotNull(), F.lit("error")).when(F.col("coverage") != "ok", F.lit("no_text")).when(F.col("discard_reason").isNotNull(), F.lit("discarded")).when(F.col("duplicate_of").isNotNull(), F.lit("duplicate")).otherwise(F.lit("added"))
    reason = F.coalesce("error", F.when(F.col("coverage") != "ok", F.col("coverage")), "discard_reason", F.when(F.col("duplicate_of").isNotNull(), F.lit("duplicate_content")))
    jobs = of.select("md5", F.col("name").alias("filename"), status.alias("status"), reason.alias("reason_code"), "duplicate_of", F.col("title").alias("book_title"), F.when(status == "added", F.col("slug")).alias("book_slug"), "lang", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), "pages_total", "pages_without_text")
    done = jobs.where(F.col("status").isin("added", "discarded", "duplicate")).select("md5", F.col("book_slug").alias("slug"), "n_chunks", F.col("reason_code").alias("reason"))
    if stopped:
        jobs = jobs.unionByName(cancelled.select("md5", F.col("name").alias("filename"), F.lit("cancelled").alias("status"), F.lit(0).alias("n_chunks")), allowMissingColumns=True)
    told = jobs = cut(jobs)
    if fresh and index.has("jobs"):
        jobs = index.read("jobs").unionByName(jobs, allowMissingColumns=True)
    chunks = cut(chunks)
    # an index made before there were postings gets those of all its chunks
    posted = chunks.unionByName(index.read("chunks"), allowMissingColumns=True) if known and not index.has("postings") else chunks
    (index.commit if fresh else index.append)({"chunks": chunks, "books": books, "processed": done, "jobs": jobs, **postings.made(posted)})
    return told


def run(spark: SparkSession, folder: str, index: str, checkpoint: str, available_now: bool = True, on_batch: Callable[[int], None] | None = None):
    """Start the stream; with ``available_now`` it ends when the folder's files are done. What a broken run left is dropped first."""
    tables = maintenance.Snapshots(spark, index, "chunks")
    with tables.lock():
        tables.recover()

    def each(batch: DataFrame, number: int) -> None:
        ingest_batch(batch, tables)
        if on_batch:
            on_batch(number)

    writer = file_stream(spark, folder).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="2 seconds")).start()


class RebuildRefused(ValueError):
    """A rebuild would lose books whose files are not in the folder."""


def build(spark: SparkSession, folder: str, index: str, rebuild: bool = False, force: bool = False) -> dict:
    """Take in the files directly in a folder as one batch (``run`` makes a commit of every hundred files); the number of files of each outcome. Files the index
    has are left out. With ``rebuild`` all of the index is made anew from the folder, and is as before until
    that is done; it is refused where the folder lacks more than a tenth of the indexed books, unless ``force``."""
    tables = maintenance.Snapshots(spark, index, "chunks")
    with tables.lock():
        tables.recover()
    files = spark.read.format("binaryFile").schema(FILES).option("recursiveFileLookup", "false").load(folder)
    if rebuild and not force and tables.has("processed"):
        indexed = tables.read("processed").where("n_chunks > 0").count()
        there = dedup.preferred_copy(readers.candidates(named(files))).count()
        if not catalog.may_rebuild(there, indexed):
            raise RebuildRefused(f"{folder} has {there} files for {indexed} indexed books")
    before = tables.read("jobs").count() if tables.has("jobs") else 0
    told = {r.status: r.n for r in catalog.outcomes(tables.read("jobs"), "status").collect()} if before else {}
    ingest_batch(files, tables, fresh=rebuild)
    after = {r.status: r.n for r in catalog.outcomes(tables.read("jobs"), "status").collect()}
    return {status: n - told.get(status, 0) for status, n in sorted(after.items()) if n > told.get(status, 0)}


def first_uploads(uploads: DataFrame, digest: str = "md5", ts: str = "ts", within: str = "1 day") -> DataFrame:
    """The first upload of each content; state is kept as long as late copies are expected."""
    return uploads.withWatermark(ts, within).dropDuplicatesWithinWatermark([digest])
