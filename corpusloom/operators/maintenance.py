"""Index maintenance: anti-joins against what is known, upserts, removal of books, and versioned snapshots.

A commit writes folders of its own and then one numbered pointer file that names them: readers see the old version or the
new one of all tables, an interrupted commit leaves the old one, and a rollback is the version before. All paths go through
Hadoop's file system, so a snapshot lives wherever the cluster's tables do.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .jobs import retitled


def not_processed(files: DataFrame, processed: DataFrame, key: str = "md5") -> DataFrame:
    return files.join(processed.select(key), key, "left_anti")


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``table`` with the rows of ``changes`` in place of those of equal key; columns that changes lack become null."""
    return table.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def insert_absent(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Columns both know, and only rows whose key is new."""
    shared = [c for c in table.columns if c in rows.columns]
    return table.unionByName(rows.select(*shared).join(table.select(key), key, "left_anti"), allowMissingColumns=True)


def _as_known(column: str, to: str, kind: str) -> Column:
    """A value of an older table as the type the present one has: flags stand as numbers there, times as ISO text, in UTC if it names no
    zone."""
    if to == "boolean" and kind != "boolean":
        return F.coalesce(F.col(column).cast("double") != 0, F.lit(False))
    if to == "timestamp" and kind == "string":
        zoned = F.when(F.col(column).rlike(r"(Z|[+-]\d\d(:?\d\d)?)$") & (F.char_length(column) > 10), F.col(column)).otherwise(F.concat(column, F.lit("Z")))
        return F.when(F.col(column) != "", F.when(F.char_length(column) > 10, zoned).otherwise(F.concat(column, F.lit("T00:00:00Z")))).cast("timestamp")
    return F.col(column).cast(to)


def migrated(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` with the rows of an older table whose key it lacks, of the columns both know, in the types of ``table``. An empty
    time is null; text that is no time stops it."""
    kinds = dict(rows.dtypes)
    return insert_absent(table, rows.select(*(_as_known(c, to, kinds[c]).alias(c) for c, to in table.dtypes if c in kinds)), key)


def check_migrated(table: DataFrame, rows: DataFrame, key: str) -> int:
    """How many rows of the older table there are; stops if one of them has no row in ``table`` as it was written."""
    n = rows.count()
    present = rows.select(F.col(key).cast(table.schema[key].dataType)).join(table.select(key), key, "left_semi").count()
    if present != n:
        raise RuntimeError(f"migration is incomplete: {present} of {n} rows")
    return n


def set_aside(spark: SparkSession, path: str) -> str:
    """Rename what has been migrated, so that it is not taken again; the new path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    done = at.suffix(".migrated")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(at, done):
        raise RuntimeError(f"cannot rename {path}")
    return done.toString()


def original_names(files: DataFrame, stored: DataFrame, name: str = "name", digest: str = "md5") -> DataFrame:
    """``files`` with stored_name, under which the original is kept, and move, whether it has to be put there. A name that other bytes
    have, among ``stored`` or earlier (by digest) in the same table, gets the first six letters of the digest before its ending; bytes
    that are there already are not moved again."""
    kept = stored.groupBy(F.col(name).alias("_n")).agg(F.min(digest).alias("_d"))
    first = files.groupBy(F.col(name).alias("_f")).agg(F.min(digest).alias("_first"))
    both = files.join(first, F.col(name) == F.col("_f"), "left").join(kept, F.col(name) == F.col("_n"), "left")
    clash = F.coalesce(F.col("_d"), F.col("_first")) != F.col(digest)
    marked = F.concat(F.regexp_replace(name, r"(?s)(?<=.)\.[^.]+$", ""), F.lit(" ("), F.substring(digest, 1, 6), F.lit(")"), F.regexp_extract(name, r"(?s)(?<=.)\.[^.]+$", 0))
    put = both.withColumn("stored_name", F.when(clash, marked).otherwise(F.col(name)))
    there = stored.select(F.col(name).alias("stored_name")).distinct().withColumn("_there", F.lit(True))
    return put.join(there, "stored_name", "left").withColumn("move", F.col("_there").isNull()).select(*files.columns, "stored_name", "move")


def relabels(books: DataFrame, removed: DataFrame, book: str = "book") -> DataFrame:
    """(old, new): remaining titles of the form "T [file]" whose T is removed become T; each T serves its first by order."""
    left = books.select(F.col(book).alias("old")).distinct().join(removed.select(F.col(book).alias("old")), "old", "left_anti")
    bare = left.where(F.col("old").rlike(r"(?s) \[.*\]$"))
    parts = F.split("old", r" \[", -1)
    stems = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), " ["))
    offered = bare.select("old", F.explode(stems).alias("new")).join(removed.select(F.col(book).alias("new")).distinct(), "new", "left_semi")
    by_title = Window.partitionBy("new").orderBy("old")
    by_old = Window.partitionBy("old").orderBy(F.desc(F.char_length("new")))
    first = offered.withColumn("_r", F.row_number().over(by_title)).where("_r = 1")
    return first.withColumn("_s", F.row_number().over(by_old)).where("_s = 1").select("old", "new")


def remove_books(chunks: DataFrame, titles: Sequence[str], book: str = "book", key: str = "id") -> DataFrame:
    """``chunks`` without the books of these titles, and with colliding labels set back. Unknown titles stop it."""
    spark = chunks.sparkSession
    wanted = spark.createDataFrame([(t,) for t in dict.fromkeys(titles)], f"`{book}` string")
    missing = [r[0] for r in wanted.join(chunks.select(book).distinct(), book, "left_anti").collect()]
    if missing:
        raise ValueError(f"unknown titles: {sorted(missing)}")
    renamed = relabels(chunks, wanted, book)
    kept = chunks.join(wanted, book, "left_anti").join(renamed, F.col(book) == F.col("old"), "left")
    return kept.withColumn(book, F.coalesce("new", book)).select(*chunks.columns)


def removal_report(chunks: DataFrame, titles: DataFrame, book: str = "book", key: str = "id") -> DataFrame:
    marked = chunks.join(titles.select(F.col(book), F.lit(True).alias("_gone")), book, "left").withColumn("_gone", F.coalesce("_gone", F.lit(False)))
    slug = F.substring_index(key, "::", 1)
    return marked.agg(
        F.count_if("_gone").alias("chunks_removed"),
        F.count("*").alias("chunks_before"),
        F.count_if(~F.col("_gone")).alias("chunks_after"),
        F.count_distinct(F.when(F.col("_gone"), slug)).alias("slugs_removed"),
        F.count_distinct(F.when(~F.col("_gone"), F.col(book))).alias("books_after"),
    )


def mark_removed(processed: DataFrame, slugs: DataFrame) -> DataFrame:
    """Entries of removed books stay, with no chunks, so that their files are not taken in again."""
    gone = slugs.select("slug").distinct().withColumn("_gone", F.lit(True))
    before = F.coalesce("removed", F.lit(False)) if "removed" in processed.columns else F.lit(False)
    both = processed.join(gone, "slug", "left").withColumn("_gone", F.coalesce("_gone", F.lit(False)))
    changed: dict[str, Column] = {"n_chunks": F.when(F.col("_gone"), F.lit(0)).otherwise(F.col("n_chunks")), "removed": F.col("_gone") | before}
    return both.withColumns(changed).drop("_gone").select(*dict.fromkeys([*processed.columns, "removed"]))


class Snapshots:
    """Versions of a set of tables under one folder. A version is a numbered pointer file that lists the folders of each table; it
    is written aside and renamed to a number that nobody has, so one rename makes all tables of a commit seen at once, on any file
    system, and no reader ever finds no version. Appending writes the new rows only."""

    def __init__(self, spark: SparkSession, path: str, table: str = "rows"):
        self.spark, self.path, self.table = spark, path.rstrip("/"), table
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, prefix: str) -> list[str]:
        at = self._path(self.path)
        found = self._fs.listStatus(at) if self._fs.exists(at) else ()
        return sorted(n for n in (status.getPath().getName() for status in found) if n.startswith(prefix))

    def _load(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.path}/{name}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    @property
    def current(self) -> dict | None:
        names = self._names("CURRENT-")
        return self._load(names[-1]) if names else None

    def read(self, table: str | None = None) -> DataFrame:
        """A table as its last commit left it. Folders whose columns differ are read as one: what a folder lacks is null."""
        now, table = self.current, table or self.table
        if now is None or table not in now["parts"]:
            raise FileNotFoundError(f"no {table} in {self.path}")
        return self.spark.read.option("mergeSchema", "true").parquet(*(f"{self.path}/{p}" for p in now["parts"][table]))

    def has(self, table: str) -> bool:
        return table in (self.current or {"parts": {}})["parts"]

    def _number(self) -> int:
        return int((self._names("CURRENT-") or ["CURRENT-0"])[-1].rpartition("-")[2])

    def _point(self, made: dict) -> dict:
        number = made.get("after", self._number()) + 1
        aside, final = self._path(f"{self.path}/_CURRENT.{uuid.uuid4().hex}"), self._path(f"{self.path}/CURRENT-{number:020d}")
        out = self._fs.create(aside, True)
        out.write(bytearray(json.dumps(made).encode()))
        out.hsync()
        out.close()
        if self._fs.exists(final) or not self._fs.rename(aside, final):
            self._fs.delete(aside, False)
            raise RuntimeError(f"another writer committed to {self.path}: hold the lock")
        return made

    def _commit(self, tables: DataFrame | dict[str, DataFrame], keep: bool, facts: dict) -> dict:
        tables = tables if isinstance(tables, dict) else {self.table: tables}
        number = self._number()  # another commit that ends before this one takes the number after it, and this one fails
        before = self.current or {"parts": {}, "rows": {}}
        parts, rows = dict(before["parts"]), dict(before["rows"])
        for table, df in tables.items():
            part = f"v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}-{table}"
            df.write.parquet(f"{self.path}/{part}")
            parts[table] = [*(parts.get(table, ()) if keep else ()), part]
            rows[table] = (rows.get(table, 0) if keep else 0) + self.spark.read.parquet(f"{self.path}/{part}").count()
        return self._point({"parts": parts, "rows": rows, "n_rows": rows.get(self.table), "previous": {k: before[k] for k in ("parts", "rows")} if before["parts"] else None, "after": number, **facts})

    def commit(self, tables: DataFrame | dict[str, DataFrame], **facts) -> dict:
        """Write tables anew (those not named stay) and point to them. Until the pointer is there nothing has changed."""
        return self._commit(tables, False, facts)

    def append(self, tables: DataFrame | dict[str, DataFrame], **facts) -> dict:
        return self._commit(tables, True, facts)

    def rollback(self) -> dict:
        now = self.current
        if not now or not now["previous"]:
            raise ValueError("no earlier snapshot")
        return self._point({**now["previous"], "n_rows": now["previous"]["rows"].get(self.table), "previous": None})

    def recover(self) -> list[str]:
        """Drop folders that neither the last version nor the one before it names (what an interrupted commit left), and older
        pointers. Safe to repeat."""
        now = self.current or {"parts": {}, "previous": None}
        versions = [now["parts"], (now["previous"] or {"parts": {}})["parts"]]
        keep = {p for parts in versions for folders in parts.values() for p in folders} | set(self._names("CURRENT-")[-1:])
        gone = [n for prefix in ("v-", "_CURRENT.", "CURRENT-") for n in self._names(prefix) if n not in keep]
        for name in gone:
            self._fs.delete(self._path(f"{self.path}/{name}"), True)
        return sorted(n for n in gone if not n.startswith("CURRENT-"))

    def _owner(self, at) -> str | None:
        try:
            stream = self._fs.open(at)
        except Exception:  # gone meanwhile
            return None
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _break_lock(self, at, owner: str | None) -> None:
        """Remove the lock of a dead owner. Of several that try, one renames it; a lock taken meanwhile by another is put back."""
        aside = self._path(f"{self.path}/_LOCK.{uuid.uuid4().hex}")
        if self._fs.rename(at, aside):
            if self._owner(aside) == owner or not self._fs.rename(aside, at):
                self._fs.delete(aside, False)

    @contextmanager
    def lock(self, wait_seconds: float = 600, on_wait: Callable[[], None] | None = None, stale_seconds: float = 120):
        """One writer at a time: a file that only one of several can create. Its owner gives it a new time again and again; if the
        time does not change for ``stale_seconds`` of the waiting process's own clock, the owner has died and the lock is removed. Read what
        a commit builds on, and call ``recover``, inside it."""
        at, began, told = self._path(f"{self.path}/_LOCK"), time.monotonic(), False
        owner, seen, since = uuid.uuid4().hex, None, time.monotonic()
        while True:
            try:
                out = self._fs.create(at, False)
                out.write(bytearray(owner.encode()))
                out.close()
                break
            except Exception as e:
                if "already exists" not in str(e) and "FileAlreadyExists" not in str(e):
                    raise
                if on_wait and not told:
                    told = True
                    on_wait()
                if time.monotonic() - began > wait_seconds:
                    raise TimeoutError(f"{self.path} is locked") from e
            holder = self._owner(at)
            now = (holder, self._fs.getFileStatus(at).getModificationTime() if holder is not None and self._fs.exists(at) else None)
            if now != seen:
                seen, since = now, time.monotonic()
            elif holder is not None and time.monotonic() - since > stale_seconds:
                self._break_lock(at, holder)
            time.sleep(0.2)
        done = threading.Event()

        def beat() -> None:
            while not done.wait(stale_seconds / 4):
                try:
                    self._fs.setTimes(at, int(time.time() * 1000), -1)
                except Exception:  # the lock is gone or the file system keeps no times: nothing to renew
                    return

        renewing = threading.Thread(target=beat, daemon=True)
        renewing.start()
        try:
            yield self
        finally:
            done.set()
            renewing.join()
            if self._owner(at) == owner:
                self._fs.delete(at, False)


def remove_from_index(index: Snapshots, titles: Sequence[str], dry_run: bool = False) -> dict:
    """Take the books of these titles out of an index and say what that changes; with ``dry_run`` only say it. Unknown titles stop it.

    One commit rewrites the tables that know the books: their chunks (with their vectors) and their rows of ``books`` go, their files
    stay ``processed`` with no chunks, and labels set back are set back in ``books`` and ``jobs`` too. The report's lists are as
    long as ``titles`` at most, but for the slugs of the removed books."""
    chunks = index.read("chunks")
    wanted = index.spark.createDataFrame([(t,) for t in dict.fromkeys(titles)], "book string")
    kept = remove_books(chunks, titles)
    labels = relabels(chunks, wanted).collect()
    gone = chunks.join(wanted, "book", "left_semi").select(F.substring_index("id", "::", 1).alias("slug")).distinct()
    report = removal_report(chunks, wanted).first().asDict()
    report |= {"titles": sorted(set(titles)), "slugs": sorted(r.slug for r in gone.collect()), "relabelled": {r.old: r.new for r in labels}}
    if dry_run:
        return report
    renamed = index.spark.createDataFrame([(r.old, r.new) for r in labels], "old string, new string")
    tables = {"chunks": kept}
    if index.has("books"):
        tables["books"] = retitled(index.read("books").join(wanted.withColumnRenamed("book", "title"), "title", "left_anti"), renamed, "title")
    if index.has("processed"):
        tables["processed"] = mark_removed(index.read("processed"), gone)
    if index.has("jobs") and labels:
        tables["jobs"] = retitled(index.read("jobs"), renamed)
    if index.has("postings"):
        from .postings import without  # which reads snapshots itself

        tables |= without(index, kept)
    index.commit(tables)
    return report


def unique_slugs(files: DataFrame, taken: DataFrame, slug: str = "slug", digest: str = "md5") -> DataFrame:
    """``files`` with slugs that name one file each: one that is taken, or that an earlier file of the same table has (by
    digest), gets the first six letters of its file's digest."""
    known = taken.select(F.col(slug).alias("_s")).distinct().withColumn("_taken", F.lit(True))
    first = files.groupBy(F.col(slug).alias("_f")).agg(F.min(digest).alias("_first"))
    marked = files.join(first, F.col(slug) == F.col("_f"), "left").join(known, F.col(slug) == F.col("_s"), "left")
    clash = F.col("_taken").isNotNull() | (F.col(digest) > F.col("_first"))
    return marked.withColumn(slug, F.when(clash, F.concat(slug, F.lit("-"), F.substring(digest, 1, 6))).otherwise(F.col(slug))).select(*files.columns)


def distinct_labels(books: DataFrame, taken: DataFrame, title: str = "title", filename: str = "filename", slug: str = "slug", among: bool = False) -> DataFrame:
    """``books`` with titles that are not taken: else with the file's name in brackets, else with the slug. With ``among``, a title that another
    of the books has, whose slug comes first, is taken too."""
    known = taken.select(F.col(title).alias("_t")).distinct()
    labelled = books.withColumn("_file", F.format_string("%s [%s]", title, filename))
    for n, column in enumerate((title, "_file")):
        labelled = labelled.join(known.withColumnRenamed("_t", f"_t{n}"), F.col(column) == F.col(f"_t{n}"), "left")
        if among:
            first = labelled.groupBy(F.col(column).alias("_w")).agg(F.min(slug).alias("_s"))
            again = labelled.join(first, F.col(column) == F.col("_w"), "left")
            labelled = again.withColumn(f"_t{n}", F.coalesce(f"_t{n}", F.when(F.col(slug) > F.col("_s"), F.col(column)))).drop("_w", "_s")
    label = F.when(F.col("_t0").isNull(), F.col(title)).when(F.col("_t1").isNull(), F.col("_file")).otherwise(F.format_string("%s [%s]", title, slug))
    return labelled.withColumn(title, label).select(*books.columns)


def mark_uploads(uploads: DataFrame, known: DataFrame, pending: DataFrame, digest: str = "md5", order: str = "n") -> DataFrame:
    """``uploads`` with outcome: new, or duplicate_file for bytes that are in the index, wait for it, or stand earlier in this
    upload. (Near copies are known only once a book is read: ``streaming.ingest`` calls them duplicate_content.)"""
    first = uploads.groupBy(F.col(digest).alias("_d")).agg(F.min(order).alias("_first"))
    there = known.select(digest).unionByName(pending.select(digest)).distinct().withColumn("_there", F.lit(True))
    joined = uploads.join(first, F.col(digest) == F.col("_d"), "left").join(there, digest, "left")
    new = F.col("_there").isNull() & (F.col(order) == F.col("_first"))
    return joined.withColumn("outcome", F.when(F.coalesce(new, F.lit(True)), F.lit("new")).otherwise(F.lit("duplicate_file"))).select(*uploads.columns, "outcome")
