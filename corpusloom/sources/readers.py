"""Document files as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as fx
from ..functions import text as tx
from ..functions.rows import per_row
from ..operators import catalog
from ..operators.order import cut
from . import extract as ex
from . import formats, pdf


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(name, ext, size, md5, content) of the files directly in ``folder``, hidden ones left out; ext is null for formats
    that are not supported."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    name = F.regexp_replace("path", "^.*/", "")
    named = files.select(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("name"), F.col("length").alias("size"), "content")
    return named.where(~F.startswith("name", F.lit("."))).select("name", tx.extension(F.col("name")).alias("ext"), "size", F.md5("content").alias("md5"), "content")


def candidates(files: DataFrame) -> DataFrame:
    return files.where(F.col("ext").isNotNull() & (F.col("size") >= fx.MIN_FILE_BYTES))


def extract_text(files: DataFrame) -> DataFrame:
    """``files`` without content, with text, error (a code; the row fails alone, not the job) and, of formats that have pages,
    pages_total and pages_without_text."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts, errors, pages, empty = [], [], [], []
            for ext, content in zip(batch.column("ext").to_pylist(), batch.column("content").to_pylist()):
                pages.append(None)
                empty.append(None)
                try:
                    found = ex.extract(content or b"", ext)
                    texts.append(found.text)
                    errors.append(None)
                    pages[-1], empty[-1] = found.pages_total, found.pages_without_text
                except ex.ExtractionError as e:
                    texts.append(None)
                    errors.append(e.code)
                except Exception as e:  # a broken file is a row with an error
                    texts.append(None)
                    errors.append(f"internal: {type(e).__name__}")
            kept = [c for c in batch.schema.names if c != "content"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string()), pa.array(errors, pa.string()), pa.array(pages, pa.int32()), pa.array(empty, pa.int32())], names=[*kept, "text", "error", "pages_total", "pages_without_text"])

    kept = [f for f in files.schema.fields if f.name != "content"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", text string, error string, pages_total int, pages_without_text int"
    return files.mapInArrow(run, schema)


def pdf_lines(files: DataFrame) -> DataFrame:
    """(md5, page, n, top, left, height, text, error): the lines of PDF files, ``n`` from 1 in each page; a page without lines is one row
    with n = 0 and empty text, a file that cannot be read one row with its error code and a null page. Equal files are read once."""
    schema = "md5 string, page int, n int, top double, left double, height double, text string, error string"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        import pyarrow as pa

        whole, real = pa.int32(), pa.float64()
        kinds = [pa.string(), whole, whole, real, real, real, pa.string(), pa.string()]
        for batch in batches:
            for md5, content in zip(batch.column("md5").to_pylist(), batch.column("content").to_pylist()):
                try:
                    if not formats.matches(content or b"", "pdf"):
                        raise ex.ExtractionError("corrupt", "not pdf")
                    rows = [(md5, p, n, *line, None) for p, found in enumerate(pdf.lines(content), 1) for n, line in enumerate(found or [(None, None, None, "")], 1 if found else 0)]
                except ex.ExtractionError as e:
                    rows = [(md5, None, None, None, None, None, None, e.code)]
                except Exception as e:  # a broken file is a row with an error
                    rows = [(md5, None, None, None, None, None, None, f"internal: {type(e).__name__}")]
                yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names=names)

    return files.dropDuplicates(["md5"]).select("md5", "content").mapInArrow(run, schema)


def pdf_pages(lines: DataFrame) -> DataFrame:
    """(md5, page, text) of every page; text is empty where a page has no lines. ``lines`` are what ``pdf_lines`` gives."""
    pages = lines.where("page IS NOT NULL").select("md5", "page").distinct()
    found = catalog.page_text(lines.where("n > 0"), doc="md5").withColumnRenamed("text", "_text")
    return pages.join(found, ["md5", "page"], "left").select("md5", "page", F.coalesce("_text", F.lit("")).alias("text"))


def extract_all(files: DataFrame, ocr: DataFrame | None = None) -> DataFrame:
    """As ``extract_text``, with PDF files read line by line: the text of their pages, how many they have and how many of them lack text.
    ``ocr`` (md5, page, text) holds recognised pages; each stands for the page's own text where there is some, and counts as a page with text."""
    other = extract_text(files.where(~F.col("ext").eqNullSafe("pdf")))
    of_pdf = files.where("ext = 'pdf'")
    if of_pdf.select("ext").isEmpty():
        return other
    lines = cut(pdf_lines(of_pdf))
    pages = cut(pdf_pages(lines))
    if ocr is None:
        ocr = pages.where("false")
    recognised = ocr.where(F.trim("text") != "").dropDuplicates(["md5", "page"])
    merged = catalog.merge_pages(pages, recognised, "md5", "page", "text")
    whole = pages.join(recognised.select("md5", "page", F.col("text").alias("_ocr")), ["md5", "page"], "left").select("md5", F.coalesce("_ocr", "text").alias("text"))
    counted = catalog.page_coverage(whole, "md5", "text").select("md5", F.col("pages_total").cast("int").alias("pages_total"), F.col("pages_without_text").cast("int").alias("pages_without_text"))
    errors = lines.where("error IS NOT NULL").select("md5", "error")
    read = counted.join(merged.withColumnRenamed("text", "_text"), "md5", "left").select("md5", F.coalesce("_text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("error"), "pages_total", "pages_without_text")
    failed = errors.select("md5", F.lit(None).cast("string").alias("text"), "error", F.lit(None).cast("int").alias("pages_total"), F.lit(None).cast("int").alias("pages_without_text"))
    return other.unionByName(of_pdf.drop("content").join(read.unionByName(failed), "md5").select(*other.columns))


def through_cache(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all texts, new ones): files whose md5 the cache (md5, text) lacks are extracted, the others are looked up."""
    known = files.drop("content").join(cache, "md5").withColumns({"error": F.lit(None).cast("string"), "pages_total": F.lit(None).cast("int"), "pages_without_text": F.lit(None).cast("int")})
    new = extract_all(files.join(cache.select("md5"), "md5", "left_anti"))
    return known.unionByName(new), new.where("error IS NULL").select("md5", "text")


def html_pages(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the text of their markup, in Arrow batches."""
    return per_row(pages, [F.col(html)], ex.html_to_text, out, "string")


__all__ = ["candidates", "extract_all", "extract_text", "formats", "html_pages", "pdf_lines", "pdf_pages", "scan", "through_cache"]
