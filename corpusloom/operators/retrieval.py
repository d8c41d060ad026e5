"""Retrieval: filters before ranking, exact cosine top-k, rare-term lexical scores, reciprocal rank fusion, context packing."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass, fields
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as fx
from ..functions import text as tx
from ..functions.vectors import dot
from .order import cut, numbered


@dataclass(frozen=True)
class SearchFilters:
    """Conditions on chunks, all of which hold; empty strings are none."""

    kind: str | None = None
    ingredient: str | None = None
    book: str | None = None
    region: str | None = None
    dish_type: str | None = None

    def __post_init__(self):
        for f in fields(self):
            if not getattr(self, f.name):
                object.__setattr__(self, f.name, None)

    @property
    def active(self) -> bool:
        return any(getattr(self, f.name) for f in fields(self))

    @property
    def ingredients(self) -> list[str]:
        parts = (" ".join(tx.fold_py(p).split()) for p in re.split("[,;]", self.ingredient or ""))
        return [p for p in parts if p]

    def describe(self) -> str:
        labels = (("ingrediente", self.ingredient), ("tipo", self.kind), ("tipo de prato", self.dish_type), ("livro", self.book), ("regiao", self.region))
        return ", ".join(f"{name}: {value}" for name, value in labels if value)

    def condition(self, folded: Column) -> Column:
        """As a predicate over the chunk table, so that it stands before any ranking and reaches the scan where it can."""
        tests = [F.col(c) == v for c, v in (("kind", self.kind), ("region", self.region)) if v]
        if self.dish_type:
            tests.append(F.array_contains("dish_types", self.dish_type))
        if self.book:
            tests.append(F.contains(tx.fold(F.col("book")), F.lit(tx.fold_py(self.book))))
        tests += [word_prefix(folded, term) for term in self.ingredients]
        return reduce(Column.__and__, tests, F.lit(True))


def word_prefix(folded: Column, term: str) -> Column:
    """Whether a word begins with ``term`` (folded); white space between its words may be any."""
    words = r"\s+".join(re.escape(w) for w in term.split())
    return folded.rlike(rf"(?U)(?<![\p{{L}}\p{{N}}]){words}")


def folded_text() -> Column:
    return tx.fold(F.concat_ws("\n", F.coalesce("title", F.lit("")), "text"))


def query_terms(query: str) -> list[str]:
    """Distinct words of the query that could be rare terms, in order."""
    found = re.findall("[a-z0-9]+", tx.fold_py(query))
    return [t for t in dict.fromkeys(found) if len(t) >= fx.MIN_TERM_LEN and t not in fx.STOPWORDS]


def term_counts(chunks: DataFrame, key: str, folded: str, terms: Sequence[str]) -> DataFrame:
    """(key, term, tf) for the terms of one query; substrings count."""
    spark_terms = F.explode(F.array(*(F.lit(t) for t in terms)) if terms else F.array().cast("array<string>")).alias("term")
    return chunks.select(key, folded, spark_terms).select(key, "term", tx.count_substring(F.col(folded), F.col("term")).alias("tf")).where("tf > 0")


def rare_terms(counts: DataFrame, n_chunks: int) -> DataFrame:
    """(term, df, total, idf) of terms in at most one per cent of the whole collection. A term that occurs more than five
    times as often as that allows is common whatever its chunks."""
    cap = fx.RARE_TERM_MAX_DF * n_chunks
    stats = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    return stats.where((F.col("df") <= cap) & (F.col("total") <= cap * fx.MAX_TF)).withColumn("idf", F.log(F.lit(float(n_chunks)) / F.col("df")))


def rare_of(chunks: DataFrame, folded: str, terms: Sequence[str]) -> list[dict]:
    """What ``rare_terms`` says of the terms of one query, as rows for the driver (a row for each term at most): one pass counts the
    collection and every term in it."""
    if not terms:
        return []
    each = [tx.count_substring(F.col(folded), F.lit(t)) for t in terms]
    sums = [c for n, x in enumerate(each) for c in (F.count_if(x > 0).alias(f"df{n}"), F.sum(x).alias(f"total{n}"))]
    row = chunks.agg(F.count("*").alias("n"), *sums).first()
    cap = fx.RARE_TERM_MAX_DF * row.n
    counted = [{"term": t, "df": row[f"df{n}"], "total": row[f"total{n}"]} for n, t in enumerate(terms) if row[f"df{n}"]]
    return [c | {"idf": math.log(row.n / c["df"])} for c in counted if c["df"] <= cap and c["total"] <= cap * fx.MAX_TF]


def lexical_scores(counts: DataFrame, rare: DataFrame, key: str) -> DataFrame:
    """(key, lex): idf times term frequency (five at most), summed. ``rare`` has a row for each query term: broadcast."""
    return counts.join(F.broadcast(rare.select("term", "idf")), "term").groupBy(key).agg(F.sum(F.col("idf") * F.least("tf", F.lit(fx.MAX_TF))).alias("lex"))


def ranked(df: DataFrame, order: Sequence, limit: int, name: str) -> DataFrame:
    """The first ``limit`` rows with their rank from 0: a distributed top-k, then a rank over those rows only."""
    top = df.orderBy(*order).limit(limit)
    return top.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1)


def knn(chunks: DataFrame, query: Sequence[float], key: str, vector: str = "embedding", k: int = 8) -> DataFrame:
    """The ``k`` rows of largest inner product, with cos and rank from 0; ties by key."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return ranked(chunks.withColumn("cos", dot(F.col(vector), q)), [F.desc("cos"), F.col(key)], k, "rank")


def fuse(semantic: DataFrame, lexical: DataFrame, key: str, k: int) -> DataFrame:
    """(key, cos, rrf, sem_rank, lex_rank): reciprocal rank fusion of two rankings (key, cos, rank), the first ``k``.
    Equal sums keep the order of the semantic ranking, then of the lexical one."""
    both = semantic.select(key, "cos", F.col("rank").alias("sem_rank"), F.lit(None).cast("int").alias("lex_rank")).unionByName(
        lexical.select(key, "cos", F.lit(None).cast("int").alias("sem_rank"), F.col("rank").alias("lex_rank"))
    )
    share = lambda c: F.coalesce(F.lit(1.0) / (F.lit(fx.RRF_K) + F.col(c)), F.lit(0.0))
    one = both.groupBy(key).agg(F.max("cos").alias("cos"), F.max("sem_rank").alias("sem_rank"), F.max("lex_rank").alias("lex_rank"))
    one = one.withColumn("rrf", share("sem_rank") + share("lex_rank"))
    return one.orderBy(F.desc("rrf"), F.asc_nulls_last("sem_rank"), "lex_rank").limit(k)


def search(chunks: DataFrame, text: str, vector: Sequence[float], filters: SearchFilters | None = None, k: int = 8, key: str = "id", vector_column: str = "embedding", postings=None) -> DataFrame:
    """Hybrid search over the chunk table: (key, cos, rrf, sem_rank, lex_rank), best first.

    Filters hold before ranking. Whether a term is rare, and its idf, follow from the whole collection even when
    filters narrow what is ranked. The score to show is cos; the order is that of the fusion. With ``postings`` (``postings.Postings`` of
    the same chunks) terms are looked up there, and texts are read only where an ingredient is asked for."""
    filters = filters or SearchFilters()
    known = chunks if postings and not filters.ingredients else tx.held(chunks, "_folded", folded_text())
    terms = query_terms(" ".join([text, *filters.ingredients]))
    allowed = known.where(filters.condition(F.col("_folded") if known is not chunks else F.lit("")))
    counts = cut(postings.term_counts(terms)) if postings and terms else None
    found = rare_of(known, "_folded", terms) if not postings else [r.asDict() for r in rare_terms(counts, postings.n_chunks).collect()] if terms else []
    pool = max(k, fx.FUSION_POOL) if found else k
    semantic = knn(allowed.select(key, vector_column), vector, key, vector_column, pool)
    if not found:
        return semantic.select(key, "cos", (F.lit(1.0) / (F.lit(fx.RRF_K) + F.col("rank"))).alias("rrf"), F.col("rank").alias("sem_rank"), F.lit(None).cast("int").alias("lex_rank")).orderBy("sem_rank").limit(k)
    found.sort(key=lambda r: terms.index(r["term"]))
    weigh = lambda tf, r: F.least(tf, F.lit(fx.MAX_TF)) * F.lit(r["idf"])
    q = F.array(*(F.lit(float(x)) for x in vector))
    if postings:
        times = [F.coalesce(F.sum(F.when(F.col("term") == r["term"], F.col("tf"))), F.lit(0)) for r in found]
        lex = counts.where(F.col("term").isin([r["term"] for r in found])).groupBy(F.col("id").alias(key)).agg(reduce(Column.__add__, map(weigh, times, found)).alias("lex"))
        scored = allowed.select(key, vector_column).join(lex, key)
    else:
        scored = allowed.withColumn("lex", reduce(Column.__add__, (weigh(tx.count_substring(F.col("_folded"), F.lit(r["term"])), r) for r in found))).where("lex > 0")
    lexical = ranked(scored.select(key, "lex", dot(F.col(vector_column), q).alias("cos")), [F.desc("lex"), F.desc("cos"), F.col(key)], fx.FUSION_POOL, "rank")
    return fuse(semantic, lexical, key, k)


def pack_context(hits: DataFrame, partition: Sequence[str], order: Sequence, size: Column, limit: int = fx.CONTEXT_CHARS) -> DataFrame:
    """Hits in order up to the first that would pass ``limit`` letters; sizes are not negative, so a running sum says it."""
    for parts in (None, 512) if partition else ():
        # A sum over some of the rows is no larger than over all: what follows a row that passes the limit among its own part of the
        # rows is out. Parts are the rows' tasks, then few of them, so of a group of any size only heads meet in one task.
        dealt = hits.withColumn("_part", F.spark_partition_id() if parts is None else F.pmod(F.col("_part"), F.lit(parts)))
        before = F.sum(size).over(Window.partitionBy(*partition, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
        hits = dealt.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") <= limit).drop("_before")
    w = Window.partitionBy(*partition).orderBy(*order) if partition else Window.orderBy(*order)
    return hits.withColumn("packed_chars", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("packed_chars") <= limit).drop("_part")


def citation_line(number: Column, book: Column, title: Column, kind: Column) -> Column:
    return F.concat(F.lit("["), number.cast("string"), F.lit("] "), book, F.lit(" — "), F.when(F.coalesce(title, F.lit("")) == "", F.lit("trecho")).otherwise(title), F.lit("  ("), kind, F.lit(")"))


def pack_batches(sizes: Sequence[int], max_items: int = fx.BATCH_ITEMS, max_tokens: int = fx.BATCH_TOKENS) -> list[int]:
    """Batch numbers of texts of these lengths, in order: a batch closes before it would hold too many texts or tokens."""
    out, batch, items, tokens = [], 0, 0, 0
    for n in sizes:
        t = math.ceil(n / fx.CHARS_PER_TOKEN)
        if items and (items >= max_items or tokens + t > max_tokens):
            batch, items, tokens = batch + 1, 0, 0
        out.append(batch)
        items, tokens = items + 1, tokens + t
    return out


def _next_start(tokens: np.ndarray, max_items: int, max_tokens: int) -> np.ndarray:
    """For each text, where the batch that begins with it ends, if it is one of these."""
    total = np.concatenate([[0], np.cumsum(tokens)])
    at = np.arange(len(tokens))
    fits = np.searchsorted(total, total[:-1] + max_tokens, side="right") - 1
    return np.minimum(np.maximum(fits, at + 1), at + max_items)


def batched(df: DataFrame, group: str, order: str, text: str, max_items: int = fx.BATCH_ITEMS, max_tokens: int = fx.BATCH_TOKENS, block: int = 65_536) -> DataFrame:
    """(group, order, batch): texts of each group packed in order, as ``pack_batches`` does.

    Where a batch begins follows from where the one before ends, yet no group passes one task. Rows get their places, and blocks of
    ``block`` places are tasks. Every block says, for each place of its beginning where a batch could begin (``max_items`` at most), where the first batch
    of the next block would, and how many batches lie between; it sees the first rows of the next block for that. Such steps are
    composed by doubling until each block knows its real beginning and number; then blocks number their own batches."""
    block = max(block, max_items)
    sized = df.select(F.col(group).alias("_g"), F.col(order).alias("_o"), F.ceil(F.char_length(text) / fx.CHARS_PER_TOKEN).cast("long").alias("_t"))
    placed = numbered(sized, "_g", ["_o"]).withColumn("_t", F.coalesce("_t", F.lit(0)))
    name = F.when(F.col("_g").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("_g").cast("string")))  # joins without a rule for nulls
    own = F.expr(f"_at div {block}")
    blocks = F.explode(F.when((F.col("_at") % block < max_items) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own)))
    dealt = cut(placed.select("_g", name.alias("_n"), "_o", "_at", "_t", blocks.alias("_b")))

    def steps(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        at = rows.column("_at").to_numpy()
        by = np.argsort(at)
        first, n = int(key[1].as_py()) * block, len(at)
        after = _next_start(rows.column("_t").to_numpy()[by], max_items, max_tokens)
        inside = min(block, n)
        ends, hops = np.arange(n + max_items + 1), np.zeros(n + max_items + 1, np.int64)
        for i in range(inside - 1, -1, -1):
            ends[i], hops[i] = ends[after[i]], hops[after[i]] + 1
        m = inside if first and inside < max_items else 1 if not first else max_items
        return pa.table([pa.array([key[0].as_py()] * m), pa.array(first + np.arange(m)), pa.array(first + ends[:m]), pa.array(hops[:m])], names=["_n", "_at", "_end", "_hops"])

    entries = jump = cut(dealt.groupBy("_n", "_b").applyInArrow(steps, "_n string, _at bigint, _end bigint, _hops bigint"))
    known = cut(jump.where("_at = 0").select("_n", "_at", F.lit(0).cast("long").alias("_batch")))
    size = known.count()
    while size:
        further = known.join(jump, ["_n", "_at"]).select("_n", F.col("_end").alias("_at"), (F.col("_batch") + F.col("_hops")).alias("_batch"))
        known = cut(known.unionByName(further).distinct())
        ahead = jump.select("_n", F.col("_at").alias("_end"), F.col("_end").alias("_end2"), F.col("_hops").alias("_hops2"))
        jump = cut(jump.join(ahead, ["_n", "_end"]).select("_n", "_at", F.col("_end2").alias("_end"), (F.col("_hops") + F.col("_hops2")).alias("_hops")))
        size, before = known.count(), size
        if size == before:
            break
    begins = known.join(entries.select("_n", "_at"), ["_n", "_at"], "left_semi").select("_n", F.expr(f"_at div {block}").alias("_b"), F.col("_at").alias("_from"), "_batch")
    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema}

    def number(rows: pa.Table) -> pa.Table:
        at, start, batch = rows.column("_at").to_numpy(), rows.column("_from")[0].as_py(), rows.column("_batch")[0].as_py()
        by = np.argsort(at)
        first, after = int(at[by[0]]), _next_start(rows.column("_t").to_numpy()[by], max_items, max_tokens)
        out, i = np.full(len(at), -1, np.int32), start - first
        while i < min(block, len(at)):
            out[i : after[i]] = batch
            i, batch = int(after[i]), batch + 1
        mine = np.flatnonzero(out >= 0)
        return pa.table([rows.column("_g").take(pa.array(by[mine])), rows.column("_o").take(pa.array(by[mine])), pa.array(out[mine])], names=[group, order, "batch"])

    ready = dealt.join(begins, ["_n", "_b"])
    return ready.groupBy("_n", "_b").applyInArrow(number, f"`{group}` {kinds['_g']}, `{order}` {kinds['_o']}, batch int")
