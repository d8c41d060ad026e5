"""Benchmark decontamination with a generalised suffix automaton of the test items.

Item words are numbered and the items' word sequences become one generalised suffix automaton. Each
document's words stream through it once: the automaton's state and the current match length say at each
word how long a passage of some item ends there. A window is ``window`` consecutive item words, or a whole
item of fewer; a document word inside any occurrence of a window is hit.

The automaton grows with the benchmark, so the benchmark's words are counted first and items are dealt into
shards of at most ``shard_words`` words; what is broadcast is one shard, of that bounded size. Documents pass
each shard in turn, one shard being held at a time, and what the shards find is merged by document. Items pass the driver one
by one while a shard is built.

Defined results for odd rows: null text, or text without a word, has no words and no hits; null item ids are
items named ``null``; items that are null or without words are none; items of equal id are separate
sequences that count once; an empty benchmark hits nothing; repeated documents get equal results; texts of any length are searched whole; an
empty table of documents gives no row; further columns pass through or are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_rows, prepare, stored, table, tag_of, utf8

SHARD = 200_000  # item words of a shard: about 220 MB in a worker
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` on bytes: A-Z lower-cased first, then all ASCII but digits and a-z is space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of word numbers; state 0 is the root."""

    def __init__(self, window: int = 10):
        self.window = window
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.ends: list[tuple[list[int], str]] = []

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:  # the sequence so far is already known, from another item
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def add(self, words: list[bytes], item: str) -> None:
        if not words:
            return
        ids = [self.words.setdefault(w, len(self.words)) for w in words]
        last = 0
        for w in ids:
            last = self._extend(last, w)
        self.ends.append((ids, item))

    def close(self) -> SuffixAutomaton:
        """Say for each state which items' windows end there: ``found[v]`` lists (length, items)."""
        own: dict[int, dict[int, set[str]]] = {}
        for ids, item in self.ends:
            k, v, size = min(self.window, len(ids)), 0, 0
            for w in ids:
                v, size = self.step(v, size, w)
                if size >= k:
                    u = v
                    while self.length[self.link[u]] >= k:
                        u = self.link[u]
                    own.setdefault(u, {}).setdefault(k, set()).add(item)
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        self.found: list[tuple[tuple[int, frozenset[str]], ...]] = [()] * len(self.link)
        for v in order:
            mine = tuple((k, frozenset(items)) for k, items in sorted(own.get(v, {}).items()))
            self.found[v] = self.found[self.link[v]] + mine
        self.ends = []
        return self

    def step(self, v: int, size: int, w: int) -> tuple[int, int]:
        while (t := self.next[v].get(w)) is None:
            if v == 0:
                return 0, 0
            v = self.link[v]
            size = self.length[v]
        return t, size + 1

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans (first word, one past the last) that windows cover, merged and in order; items found."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        next_, link, length, found = self.next, self.link, self.length, self.found
        v = size = 0
        for i, w in enumerate(map(self.words.get, words)):
            if w is None:
                v = size = 0
                continue
            t = next_[v].get(w)
            while t is None and v:
                v = link[v]
                size = length[v]
                t = next_[v].get(w)
            if t is None:
                continue
            v = t
            size += 1
            if found[v]:
                widest = 0
                for k, ids in found[v]:
                    if k <= size:
                        items |= ids
                        widest = max(widest, k)
                if widest:
                    begin = i + 1 - widest
                    while spans and spans[-1][1] >= begin:
                        begin = min(begin, spans.pop()[0])
                    spans.append((begin, i + 1))
        return spans, items


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def automata(items: DataFrame, item_id: str, text: str, window: int, shard_words: int) -> Iterator[SuffixAutomaton]:
    """Automata of at most ``shard_words`` words each (one longer item is a shard alone); rows arrive one partition at a time."""
    auto, held = SuffixAutomaton(window), 0
    for row in items.select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("binary").alias("t")).toLocalIterator():
        words = words_of(bytes(row.t)) if row.t is not None else []
        if held and held + len(words) > shard_words:
            yield auto.close()
            auto, held = SuffixAutomaton(window), 0
        auto.add(words, "null" if row.i is None else row.i)
        held += len(words)
    yield auto.close()


_HITS = "n_words long, spans array<struct<a:int,b:int>>, items array<string>"


def find_hits(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, shard_words: int = SHARD) -> DataFrame:
    """(doc_id, text_key, n_words, spans, items): spans are word positions [a, b) inside windows, merged."""
    spark = prepare(docs.sparkSession)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key"), utf8(text))
    kind = source.schema["doc_id"].dataType.simpleString()
    shards = automata(items, item_id, item_text, window, shard_words)

    def passed(shard):
        def rows(ids, keys, texts):
            n, spans, found = [], [], []
            for t in texts:
                words = words_of(t)
                s, i = shard.value.hits(words)
                n.append(len(words))
                spans.append([{"a": a, "b": b} for a, b in s])
                found.append(sorted(i))
            return ids, keys, n, spans, found

        return map_rows(source, rows, f"doc_id {kind}, text_key long, {_HITS}")

    auto, following = next(shards), next(shards, None)
    if following is None:
        return passed(spark.sparkContext.broadcast(auto))
    base = more = None
    while auto is not None:
        shard = spark.sparkContext.broadcast(auto)
        found = passed(shard)
        if base is None:
            base = stored(found, "hits")
        else:
            part = stored(found.where(F.size("spans") > 0).select("doc_id", "text_key", "spans", "items").distinct(), "hits")
            more = part if more is None else more.unionByName(part)
        shard.destroy()
        auto, following = following, next(shards, None)
    more = more.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("spans")).alias("_s"), F.flatten(F.collect_list("items")).alias("_i"))
    more = more.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"), "_s", "_i")
    none = F.array()
    joined = base.join(more, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_k")), "left").select(
        "doc_id", "text_key", "n_words", F.concat("spans", F.coalesce("_s", none)).alias("spans"), F.array_distinct(F.concat("items", F.coalesce("_i", none))).alias("items")
    )

    def merged(ids, keys, n, spans, found):
        return ids, keys, n, [[{"a": a, "b": b} for a, b in merge([(x["a"], x["b"]) for x in s])] for s in spans], [sorted(i) for i in found]

    return map_rows(joined, merged, f"doc_id {kind}, text_key long, {_HITS}")


def _cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """Cut the bytes from the first to the last word of each span; a line feed marks each cut."""
    folded = text.translate(_FOLD)
    at, begins, ends = 0, [], []
    for w in folded.split():
        at = folded.index(w, at)
        begins.append(at)
        at += len(w)
        ends.append(at)
    out, done = [], 0
    for a, b in spans:
        out += [text[done : begins[a]].rstrip(b" "), b"\n"]
        done = ends[b - 1]
    return b"".join([*out, text[done:].lstrip(b" ")])


def remove_spans(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, max_coverage: float = 0.8, shard_words: int = SHARD) -> DataFrame:
    """``docs`` without the spans of benchmark windows, and without documents of which more than ``max_coverage``
    of the words lie in such spans. Cutting goes on until no window is left, also none that a cut brought together.
    Documents without a hit come back as they were, null text included; other columns pass through."""
    spark = prepare(docs.sparkSession)
    names, out = docs.columns, docs.schema
    place = names.index(text)
    shards = automata(items, item_id, item_text, window, shard_words)
    auto, following = next(shards), next(shards, None)
    if following is None:
        shard = spark.sparkContext.broadcast(auto)

        def run(batches):
            for batch in batches:
                texts, keep = [], []
                for whole in batch.column(place).to_pylist():
                    t, total = (whole.encode() if whole is not None else None), None
                    drop = False
                    while t:
                        words = words_of(t)
                        spans = shard.value.hits(words)[0]
                        if not spans:
                            break
                        total = total or len(words)
                        if sum(b - a for a, b in spans) > max_coverage * total:
                            drop = True
                            break
                        t = _cut(t, spans)
                    texts.append(t.decode() if total and not drop else whole)
                    keep.append(not drop)
                columns = [pa.array(texts, type=batch.schema.field(place).type) if i == place else batch.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep))

        return docs.mapInArrow(run, out)

    # More shards than one: hits of all of them are merged and joined to the texts, until a round finds none.
    my = tag_of(docs)
    left = docs.withColumns({my + "total": F.lit(None).cast("long"), my + "key": F.xxhash64(F.coalesce(F.col(text), F.lit("")))})

    def cut(batches):
        for batch in batches:
            texts, totals, keep = [], [], []
            for whole, total, n, spans in zip(*(batch.column(name).to_pylist() for name in (text, my + "total", my + "n", my + "spans"))):
                spans = [(s["a"], s["b"]) for s in spans or ()]
                total = total or (n if spans else None)
                keep.append(not spans or sum(b - a for a, b in spans) <= max_coverage * total)
                texts.append(_cut(whole.encode(), spans).decode() if spans and keep[-1] else whole)
                totals.append(total)
            columns = {text: pa.array(texts, pa.string()), my + "total": pa.array(totals, pa.int64()), my + "cut": pa.array([bool(s) for s in batch.column(my + "spans").to_pylist()], pa.bool_())}
            made = [columns.get(name, batch.column(name) if name in batch.schema.names else None) for name in kept]
            yield pa.RecordBatch.from_arrays(made, names=kept).filter(pa.array(keep))

    kept = [*names, my + "total", my + "cut"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in out), f"`{my}total` long, `{my}cut` boolean"])
    while True:
        hits = find_hits(left, items, doc_id, text, item_id, item_text, window, shard_words).where(F.size("spans") > 0)
        hits = stored(hits.dropDuplicates(["doc_id", "text_key"]).select(F.col("doc_id").alias(my + "doc"), F.col("text_key").alias(my + "of"), F.col("n_words").alias(my + "n"), F.col("spans").alias(my + "spans")), "found")
        joined = left.join(hits, F.col(doc_id).eqNullSafe(F.col(my + "doc")) & (F.col(my + "key") == F.col(my + "of")), "left")
        done = stored(joined.select(*names, my + "total", my + "n", my + "spans").mapInArrow(cut, schema), "cut")
        if done.where(F.col(my + "cut")).isEmpty():
            return done.select(*names)
        left = done.drop(my + "cut").withColumn(my + "key", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))


def query(spark, sf_dir: str) -> DataFrame:
    hits = find_hits(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["b"] - s["a"])
    return hits.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


SQL = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, list_slice(w, i, i + least(10, len(w)) - 1) AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM item_words WHERE len(w) > 0)
), doc_words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), doc_windows AS (
  SELECT doc_id, k, i, list_slice(w, i, i + k - 1) AS win
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
        FROM doc_words, (SELECT DISTINCT k FROM windows) ks WHERE len(w) >= k)
), found AS (
  SELECT doc_id, item_id, i, d.k FROM doc_windows d JOIN windows USING (k, win)
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
