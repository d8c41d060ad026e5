"""The corpus pipeline: documents pass through these stages, each written as Parquet and read by the next.

Defined results for odd rows, for every stage: a null doc_id is a document of its own; null text counts as empty and comes out of
line deduplication as the empty text; empty and very long texts pass whole; rows that repeat a doc_id are judged each by
its text; an empty table gives an empty one; further columns pass through whatever their names, up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, decontaminate, line_dedup, simhash, toxicity
from corpusloom.llm._common import stored, table


def _with_length(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*columns)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier scores 0.5 or more go. It learns as op4 does, from labels of rows that are
    not held out."""
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    model = toxicity.train(docs, labels.where(toxicity.remainder("doc_id", 5) != 0))
    return toxicity.drop_toxic(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from every document but the first that holds them; n_chars follows the text."""
    return _with_length(line_dedup.dedup_lines(docs, counts=None), docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: the one of smallest doc_id. Shingles are of five words; 8 bits of 64 are what texts
    with 0.8 to 0.85 of their shingles in common differ in on the average. A doc_id that stays, stays in all its rows, and so
    do null ones."""
    return simhash.keep_one(docs, shingle=5, threshold=8)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are little else go; n_chars follows the text."""
    clean = decontaminate.remove_spans(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))
    return _with_length(clean, docs.columns)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, decoded_sha256): what training reads, and the digest of the decoded text."""
    return bpe.encode_decode(docs, bpe.default_path(), outputs=("ids", "decoded_sha256"), keep=("lang", "source"), cache_pieces=200_000)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("simhash", dedup_near),
    ("decontaminate", decontaminate_benchmark),
    ("bpe", encode_bpe),
]
#: No SQL states a trained classifier or a tokenizer; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
