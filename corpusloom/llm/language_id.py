"""Language identification by rank-order profiles.

A profile is the ``top`` most frequent character n-grams (1 to 3 letters, with word borders) in order of
frequency. Profiles of languages come from all training documents: n-grams are counted per block of documents,
summed by language and n-gram, and ranked. A document goes to the language whose profile is nearest to its own
by out-of-place distance: for each n-gram of the document the difference of ranks, or ``top`` if the language's
profile lacks it. Equal frequencies rank by code points, equal distances choose the language that sorts first.

Only finished profiles reach the driver: ``top`` n-grams for each language, of at most ``max_languages``.

Defined results for odd rows: null text and text without a letter are ``und`` with score 0, as is all text if
nothing was learned; documents with null lang or null text are not learned from; a null doc_id is learned from
only by callers that ask for it and is not held out; repeated rows count as often as they stand; texts of any length are
profiled whole; an empty table gives no row; further columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import map_rows, prepare, table, utf8
from ._ngrams import codes, packed
from .toxicity import remainder

TOP, LONGEST = 300, 3


def _grams(text) -> np.ndarray:
    a = codes(text)
    return np.concatenate([packed(a, n) for n in range(1, LONGEST + 1)])


def profile(text: str | bytes | None, top: int = TOP) -> np.ndarray:
    """The document's most frequent n-grams in order of rank."""
    grams, counts = np.unique(_grams(text), return_counts=True)
    return grams[np.argsort(-counts, kind="stable")[:top]]


class Profiles:
    def __init__(self, languages: dict[str, list[int]], top: int = TOP):
        self.names, self.top = sorted(languages), top
        self.grams = np.unique(np.array([g for v in languages.values() for g in v], np.uint64))
        self.ranks = np.full((len(self.names), len(self.grams) + 1), -1, np.int32)  # the last column: in no profile
        for k, name in enumerate(self.names):
            self.ranks[k, np.searchsorted(self.grams, np.array(languages[name], np.uint64))] = np.arange(len(languages[name]))

    def nearest(self, own: np.ndarray) -> tuple[str, float]:
        if not len(own) or not self.names:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        ranks = self.ranks[:, np.where(self.grams[at] == own, at, len(self.grams))]
        apart = np.where(ranks < 0, self.top, np.minimum(np.abs(ranks - np.arange(len(own))), self.top)).sum(1)
        best = int(np.argmin(apart))
        return self.names[best], 1 - float(apart[best]) / (self.top * len(own))


def learn(docs: DataFrame, lang: str = "lang", text: str = "text", top: int = TOP, max_languages: int = 5000) -> Profiles:
    """Profiles from all rows of ``docs`` with text and a language."""

    def count(batches):
        for batch in batches:
            by: dict[str, list[bytes]] = {}
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(name, []).append(t)
            for name, texts in by.items():
                at = 0
                while at < len(texts):  # a few million letters at a time
                    size, part = 0, []
                    while at < len(texts) and (not part or size + len(texts[at]) <= 1 << 21):
                        part.append(texts[at])
                        size += len(texts[at])
                        at += 1
                    grams, counts = np.unique(_grams(b" ".join(part)), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])

    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), utf8(text))
    totals = known.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = totals.withColumn("rank", rank).where(F.col("rank") <= top).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "gram"))).alias("p"))
    rows = best.limit(max_languages + 1).collect()
    if len(rows) > max_languages:
        raise ValueError(f"more than max_languages={max_languages} languages")
    return Profiles({r.lang: [g.gram for g in r.p] for r in rows}, top)


def identify(docs: DataFrame, profiles: Profiles, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): score is 1 less the distance as a share of the greatest possible."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(profiles)
    kind = docs.schema[doc_id].dataType.simpleString()

    def rows(ids, texts):
        p = shared.value
        found = [p.nearest(profile(t, p.top)) for t in texts]
        return ids, [x for x, _ in found], [s for _, s in found]

    return map_rows(docs.select(F.col(doc_id).alias("doc_id"), utf8(text)), rows, f"doc_id {kind}, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    profiles = learn(docs.where(remainder("doc_id", 4) != 2))
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    return identify(docs, profiles).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
