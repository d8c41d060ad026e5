"""Word postings of a chunk table, and character trigrams of its words: the terms of a query are found without reading any text.

Query terms are runs of ``[a-z0-9]`` and count as substrings. Such a run never crosses the end of a longer one, so what a term
counts in a chunk is the sum, over the words that hold it, of the word's count there times the term's count in the word. Two
tables say that exactly:

``postings`` (word, id, tf), sorted by word: a row for each word of each chunk;
``grams`` (gram, word, df, total), sorted by gram: each trigram of each word, with the chunks and the occurrences of the word.

Both are append-only: rows of several batches for one word are parts of its sums. Sorted tables let Parquet skip what a few
words or trigrams do not need. Chunks without text have no rows; equal ids count as one chunk; words under three letters
have no trigrams, and terms are never that short.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as fx
from ..functions import text as tx
from .maintenance import Snapshots
from .order import cut
from .retrieval import folded_text

GRAM = 3
#: Words that are put into a scan as values; beyond that they are joined.
MOST_VALUES = 1_000
#: Rows of a posting table that one task sorts, and gram rows for each of them (2.7 in the test tables).
SORTED, GRAMS = 1_000_000, 3


def _runs(words: Column) -> Column:
    """(word, tf) of an array of words: in the sorted array each word is one run."""
    once = lambda value, f: F.get(F.transform(F.array(value), f), 0)  # noqa: E731  # the value is computed once

    def counted(s: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return once(at, lambda a: F.transform(a, lambda i, k: F.struct(F.get(s, i).alias("word"), (F.coalesce(F.get(a, k + 1), F.size(s)) - i).alias("tf"))))

    return F.when(F.size(words) > 0, once(F.array_sort(words), counted))


def word_counts(chunks: DataFrame, key: str = "id", text: Column | None = None) -> DataFrame:
    """(word, id, tf) of each chunk; no shuffle."""
    words = F.regexp_extract_all(folded_text() if text is None else text, F.lit("([a-z0-9]+)"))
    return chunks.select(F.col(key).alias("id"), F.explode(_runs(words)).alias("_w")).select("_w.word", "id", "_w.tf")


def word_table(postings: DataFrame, unique: bool = False) -> DataFrame:
    """(word, df, total) of a posting table. ``unique``: no id stands twice with a word, so ids are counted where they are and words alone are shuffled."""
    df = F.count("id") if unique else F.count_distinct("id")
    return postings.where(F.char_length("word") >= GRAM).groupBy("word").agg(df.alias("df"), F.sum("tf").alias("total"))


def unique_ids(chunks: DataFrame, key: str = "id") -> bool:
    """Whether no key that is not null stands twice."""
    row = chunks.groupBy(key).agg(F.count(key).alias("_n")).agg(F.max("_n").alias("n")).first()
    return (row.n or 0) <= 1


def gram_table(postings: DataFrame, unique: bool = False) -> DataFrame:
    """(gram, word, df, total) of a posting table."""
    words = word_table(postings, unique)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("word") - (GRAM - 1)), lambda i: F.substring(F.col("word"), i, F.lit(GRAM))))
    return words.select(F.explode(grams).alias("gram"), "word", "df", "total")


def made(chunks: DataFrame, key: str = "id", text: Column | None = None) -> dict[str, DataFrame]:
    """Both tables of these chunks, laid out to be written. A word of any number of chunks spreads over ranges of ids."""
    return laid_out(cut(word_counts(chunks, key, text)), unique_ids(chunks, key))


def laid_out(postings: DataFrame, unique: bool = False) -> dict[str, DataFrame]:
    """Both tables of a written posting table. Ranges are as many as keep what one task sorts at about ``SORTED`` rows."""
    ranges = -(-postings.count() // SORTED) or 1
    return {
        "postings": postings.repartitionByRange(ranges, "word", "id").sortWithinPartitions("word", "id"),
        "grams": gram_table(postings, unique).repartitionByRange(GRAMS * ranges, "gram", "word").sortWithinPartitions("gram", "word"),
    }


def without(index: Snapshots, chunks: DataFrame) -> dict[str, DataFrame]:
    """The tables of an index for those of its chunks that are kept."""
    kept = index.read("postings").join(chunks.select("id").distinct(), "id", "left_semi").select("word", "id", "tf")
    return laid_out(cut(kept))


@dataclass(frozen=True)
class Postings:
    """The posting tables of ``n_chunks`` chunks. ``of`` reads those of an index, ``built`` makes those of a chunk table."""

    postings: DataFrame
    grams: DataFrame
    n_chunks: int

    @classmethod
    def of(cls, index: Snapshots) -> Postings | None:
        """Those of the last version, or none where it was written without."""
        now = index.current
        if not now or "postings" not in now["parts"]:
            return None
        return cls(index.read("postings"), index.read("grams"), now["rows"]["chunks"])

    @classmethod
    def built(cls, chunks: DataFrame, key: str = "id", text: Column | None = None) -> Postings:
        tables = {name: cut(df) for name, df in made(chunks, key, text).items()}
        return cls(tables["postings"], tables["grams"], chunks.count())

    def words_of(self, terms: Sequence[str]) -> DataFrame:
        """(term, word, times, df, total): the words that hold a term, by the intersection of its trigrams' words, verified."""
        spark = self.grams.sparkSession
        if short := [t for t in terms if len(t) < GRAM]:
            raise ValueError(f"terms under {GRAM} letters have no trigrams: {short}")
        parts = {t: list(dict.fromkeys(t[i : i + GRAM] for i in range(len(t) - GRAM + 1))) for t in terms}
        asked = spark.createDataFrame([(t, g, n == 0, len(gs)) for t, gs in parts.items() for n, g in enumerate(gs)], "term string, gram string, lead boolean, n int")
        read = self.grams.where(F.col("gram").isin(sorted({g for gs in parts.values() for g in gs})))
        # a row for each trigram of the query: broadcast. The sums of a word stand beside each of its trigrams; the term's first tells them.
        met = read.join(F.broadcast(asked), "gram").groupBy("term", "word", "n").agg(
            F.count_distinct("gram").alias("_m"), F.sum(F.when(F.col("lead"), F.col("df"))).alias("df"), F.sum(F.when(F.col("lead"), F.col("total"))).alias("total")
        )
        both = met.where((F.col("_m") == F.col("n")) & F.contains("word", "term"))
        return both.select("term", "word", tx.count_substring(F.col("word"), F.col("term")).alias("times"), "df", "total")

    def term_counts(self, terms: Sequence[str]) -> DataFrame:
        """(id, term, tf) of the terms that can be rare: what ``retrieval.term_counts`` has of them, without reading texts.

        A term with a word in more chunks than rare terms may have, or with more occurrences than their five a chunk, is common; its
        postings are not read. So what is read has at most a twentieth as many rows as there are chunks for each term."""
        spark = self.postings.sparkSession
        if not terms:
            return spark.createDataFrame([], "id string, term string, tf bigint").select(F.col("id").cast(self.postings.schema["id"].dataType), "term", "tf")
        cap = fx.RARE_TERM_MAX_DF * self.n_chunks
        words = cut(self.words_of(terms))
        common = words.groupBy("term").agg(F.max("df").alias("_df"), F.sum(F.col("times") * F.col("total")).alias("_n")).where((F.col("_df") > cap) | (F.col("_n") > cap * fx.MAX_TF))
        wanted = words.join(F.broadcast(common.select("term")), "term", "left_anti").select("term", "word", "times")
        some = [r.word for r in wanted.select("word").distinct().limit(MOST_VALUES + 1).collect()]
        read = self.postings.where(F.col("word").isin(some)) if len(some) <= MOST_VALUES else self.postings
        return read.join(wanted, "word").groupBy("id", "term").agg(F.sum(F.col("tf") * F.col("times")).alias("tf"))
