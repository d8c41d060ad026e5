"""Line deduplication with DataFrame functions only.

Every line's key (the line stripped of ASCII white space at both ends, A-Z lower-cased) is hashed to
128 bits. Hashes are range-partitioned and sorted by document and position inside each partition, and
one streaming window marks the occurrences that belong to the first document of their hash. The result
is a compressed bitmap for each document, not text.

A single line may hold a third of all rows, so the range key is (hash, salt): the salt comes from the
document, so the first pass finds the first document of each salted run, in runs of bounded share. Rows
that lose there are settled and are scattered by a key of their own; the rows that win there (one document for each
salt at most) meet in a second pass over the hash alone.

Defined results for odd rows: null or empty text is one empty line; rows with equal doc_id count as one
document; a null doc_id neither claims a line nor loses one; equal (doc_id, text) rows share a bitmap;
columns of the input that are not named in the call pass through ``apply_keep_bitmaps`` unchanged; texts of any number of lines are read
whole; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import tag_of

ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """Strip ``[\\x20\\x09-\\x0D]`` at both ends and lower-case A-Z only."""
    bare = F.btrim(line, F.lit(ASCII_SPACE))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _first_document(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Range-partition by ``keys``, sort by document and position, stream the first document of each run."""
    window = Window.partitionBy(*keys).orderBy("_doc", "_pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.repartitionByRange(*keys).withColumn(name, F.first("_doc").over(window))


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 10, salts: int = 64) -> DataFrame:
    """(_doc, _text_key, drop_words, n_dropped): for each document that loses lines, the 64-line words of its
    bitmap that have a cleared keep bit, sorted, as (word, mask of dropped lines); all other lines are kept."""
    lines = docs.where(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).alias("_doc"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_text_key"),
        F.posexplode(lines_of(F.col(text))).alias("_pos", "_line"),
    )
    keyed = lines.select("_doc", "_text_key", "_pos", line_key(F.col("_line")).alias("_key")).where(F.char_length("_key") >= min_chars)
    hashed = keyed.select(
        "_doc",
        "_text_key",
        "_pos",
        F.xxhash64("_key").alias("_h1"),
        F.xxhash64(F.lit(1), "_key").alias("_h2"),
        F.pmod(F.xxhash64("_doc"), F.lit(salts)).cast("int").alias("_salt"),
    )
    near = _first_document(hashed, ["_h1", "_h2", "_salt"], "_near")
    settled = F.col("_doc") != F.col("_near")
    spread = near.select(
        "_doc",
        "_text_key",
        "_pos",
        settled.alias("_settled"),
        F.when(settled, F.xxhash64("_h1", "_doc", "_pos")).otherwise(F.col("_h1")).alias("_g1"),
        F.when(settled, F.xxhash64("_pos", "_h2", "_doc")).otherwise(F.col("_h2")).alias("_g2"),
    )
    far = _first_document(spread, ["_g1", "_g2", "_settled"], "_far")
    dropped = far.where(F.col("_settled") | (F.col("_doc") != F.col("_far")))
    words = dropped.groupBy("_doc", "_text_key", F.expr("_pos div 64").cast("int").alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, _pos % 64)")).alias("_mask")
    )
    return words.groupBy("_doc", "_text_key").agg(
        F.sort_array(F.collect_list(F.struct(F.col("_word").alias("word"), F.col("_mask").alias("mask")))).alias("drop_words"),
        F.sum(F.bit_count("_mask")).alias("n_dropped"),
    )


def apply_keep_bitmaps(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text", counts: tuple[str, str] | None = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with ``text`` reduced to its kept lines, and, unless ``counts`` is None, lines and dropped lines counted under
    those names (replacing columns that have them); all other columns pass through whatever their names. Null text without a dropped line becomes empty. The join is by a shuffle: bitmaps grow with the data."""
    my = tag_of(docs)
    by_word = F.map_from_entries("drop_words")
    dense = bitmaps.select(
        F.col("_doc").alias(my + "bd"),
        F.col("_text_key").alias(my + "bk"),
        F.col("n_dropped").alias(my + "bn"),
        F.transform(F.sequence(F.lit(0), F.element_at("drop_words", -1)["word"]), lambda w: F.coalesce(by_word[w], F.lit(0).cast("long"))).alias(my + "bits"),
    )
    keyed = docs.withColumn(my + "tk", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    joined = keyed.join(dense.hint("shuffle_hash"), (F.col(doc_id) == F.col(my + "bd")) & (F.col(my + "tk") == F.col(my + "bk")), "left")
    kept_line = lambda line, at: F.getbit(F.coalesce(F.get(F.col(my + "bits"), F.shiftright(at, 6)), F.lit(0).cast("long")), at % 64) == 0
    whole = F.coalesce(F.col(text), F.lit(""))
    kept = F.when(F.col(my + "bits").isNull(), whole).otherwise(F.array_join(F.filter(lines_of(F.col(text)), kept_line), "\n"))
    n_lines = (F.char_length(whole) - F.char_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("long")
    numbers = zip(counts or (), (n_lines, F.coalesce(F.col(my + "bn"), F.lit(0)).cast("long")))
    added = joined.withColumns({**dict(numbers), my + "kept": kept})
    return added.withColumn(text, F.col(my + "kept")).drop(my + "kept", my + "tk", my + "bd", my + "bk", my + "bn", my + "bits")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 10, salts: int = 64, counts: tuple[str, str] | None = ("n_lines", "n_dropped")) -> DataFrame:
    return apply_keep_bitmaps(docs, keep_bitmaps(docs, doc_id, text, min_chars, salts), doc_id, text, counts)


def query(spark, sf_dir: str) -> DataFrame:
    from ._common import table

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), firsts AS (
  SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10 GROUP BY k
), marked AS (
  SELECT keyed.doc_id, pos, line, first_doc IS NOT NULL AND keyed.doc_id <> first_doc AS dropped
  FROM keyed LEFT JOIN firsts ON keyed.k = firsts.k AND length(keyed.k) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
