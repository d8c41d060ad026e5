"""Catalogue: tallies, facets, coverage and derived book metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as fx
from ..functions import text as tx


def totals(df: DataFrame, book: str) -> DataFrame:
    return df.agg(F.count("*").alias("chunks"), F.count_distinct(book).alias("books"))


def tally(df: DataFrame, column: str, explode: bool = False) -> DataFrame:
    """(column, n), most frequent first, ties by value; arrays are counted by element."""
    source = df.select(F.explode(column).alias(column)) if explode else df
    return source.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def facet(df: DataFrame, column: str, explode: bool = False) -> DataFrame:
    """Distinct values in order, without null."""
    source = df.select(F.explode(column).alias(column)) if explode else df.select(column)
    return source.where(F.col(column).isNotNull()).distinct().orderBy(column)


def slugs(df: DataFrame, key: str = "id") -> DataFrame:
    return df.select(F.substring_index(key, "::", 1).alias("slug")).distinct()


def facets(df: DataFrame, columns: dict[str, bool]) -> DataFrame:
    """One row with the sorted distinct values of each column (True: of its elements)."""
    parts = [F.sort_array(F.array_distinct(F.flatten(F.collect_set(c))) if arrays else F.collect_set(c)).alias(c) for c, arrays in columns.items()]
    return df.agg(*parts)


def known_title(jobs_title: Column, pending_name: Column, meta_title: Column, slug: Column) -> Column:
    """What to call a book: its added title, the file waiting for it, its metadata's title, or its slug."""
    blank = lambda c: F.when(c != "", c)
    return F.coalesce(blank(jobs_title), blank(pending_name), blank(meta_title), slug)


def book_meta(books: DataFrame, name: str, text: str, lang: str, tier: str, n_recipes: str) -> DataFrame:
    """Title, region and dish types from the file name and the first 8,000 letters, by keywords."""
    hay = tx.fold(F.concat_ws("\n", F.col(name), F.substring(text, 1, 8000)))
    with_hay = books.withColumn("_hay", hay)
    return with_hay.select(
        F.col(name).alias("book"),
        tx.book_title(F.col(name)).alias("title"),
        F.col(lang).alias("lang"),
        F.col(tier).alias("tier"),
        tx.heuristic_region(F.col("_hay"), F.col(lang)).alias("region"),
        tx.heuristic_dish_types(F.col("_hay"), F.col(tier)).alias("dish_types"),
        F.array().cast("array<string>").alias("tags"),
        F.col(n_recipes).alias("n_recipes"),
        F.lit("heuristica").alias("source"),
    )


def page_text(lines: DataFrame, doc: str = "doc_id", page: str = "page", n: str = "n", top: str = "top", left: str = "left", height: str = "height", text: str = "text") -> DataFrame:
    """(doc, page, text): the lines of each page in order of ``n``, a blank line where a paragraph begins: at a gap well over the page's
    usual one, at a line that stands higher (a new column), at a first line set in. Heights grow upwards. Lines without letters or
    signs do not count. All three windows and the grouping are by page, so rows are shuffled once."""
    whole = Window.partitionBy(doc, page)
    middle = lambda of: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {of} DESC) OVER (PARTITION BY `{doc}`, `{page}`)")
    stripped = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    own = lines.select(doc, page, F.col(n).alias("_n"), F.col(top).alias("_top"), F.col(left).alias("_left"), F.col(height).alias("_height"), stripped.alias("_text")).where("_text <> ''")
    ordered = whole.orderBy("_n")
    own = own.withColumns({"_above": F.lag("_top").over(ordered), "_before": F.lag("_left").over(ordered)})
    own = own.withColumn("_gap", F.when(F.col("_above") > F.col("_top"), F.col("_above") - F.col("_top")))
    own = own.withColumns({"_pitch": F.coalesce(F.nullif(middle("_gap"), F.lit(0)), F.lit(1.0)), "_margin": middle("_left"), "_em": F.coalesce(F.nullif(middle("_height"), F.lit(0)), F.lit(1.0))})
    column = F.col("_top") > F.col("_above") + F.col("_em")
    spaced = F.col("_above") - F.col("_top") > F.col("_pitch") * fx.PARAGRAPH_PITCH
    indented = (F.col("_left") > F.col("_margin") + F.col("_em")) & (F.col("_before") <= F.col("_margin") + F.col("_em") / 2)
    begins = F.coalesce(column | spaced | indented, F.lit(False))
    rows = own.withColumn("_text", F.when(begins, F.concat(F.lit("\n"), "_text")).otherwise(F.col("_text")))
    joined = rows.groupBy(doc, page).agg(F.sort_array(F.collect_list(F.struct("_n", "_text"))).alias("_p"))
    return joined.select(doc, page, F.array_join(F.transform("_p", lambda p: p["_text"]), "\n").alias("text"))


def page_coverage(pages: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, pages_total, pages_without_text, coverage)."""
    counted = pages.groupBy(doc).agg(F.count("*").alias("pages_total"), F.count_if(~F.coalesce(tx.page_has_text(F.col(text)), F.lit(False))).alias("pages_without_text"))
    return counted.withColumn("coverage", tx.text_coverage(F.col("pages_without_text"), F.col("pages_total")))


def merge_pages(pages: DataFrame, ocr: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """(doc, text): recognised text where there is some for a page, else its own; blank pages dropped; in page order."""
    other = ocr.select(doc, page, F.col(text).alias("_ocr"))
    both = pages.join(other, [doc, page], "left").withColumn("_t", F.coalesce("_ocr", text)).where(F.trim("_t") != "")
    ordered = both.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct(page, "_t"))).alias("_p"))
    return ordered.select(doc, F.array_join(F.transform("_p", lambda p: p["_t"]), "\n\n").alias("text"))


def may_rebuild(files: int, indexed: int) -> bool:
    """A rebuild is refused when fewer files are there than nine tenths of the books indexed."""
    return files >= fx.REBUILD_COVERAGE * indexed


def outcomes(jobs: DataFrame, outcome: str) -> DataFrame:
    return tally(jobs, outcome)
