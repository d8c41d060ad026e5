"""Spelling variants: every word's frequent neighbour at one edit, found with Aho-Corasick automata of word halves.

Words are counted over all texts. If two words differ by one inserted, deleted or replaced code point, the edit touches one half of
either, so the other half stands unchanged in the other word: the first half at its beginning, the second at its end, and their
lengths differ by one at most. Automata therefore hold the two halves of every word, in shards of one length and of bounded
size. All words of lengths that fit pass each shard; where a half is met at the offset it must have, the distance is verified.
Each cell (a shard and a block of words) returns, for a word, how many near words there are and the best of them, never pairs.
What a common half is shared by is looked up by its other part less one code point, so that frequent endings are not compared
one with all.

Forms lead from a word to its best near word, where that is twice as frequent, so chains end after as many steps as counts can
double; roots are found by pointer doubling.

Defined results for odd rows: null and empty texts have no words; a null doc_id counts as empty text before the colon; rows that repeat a
doc_id count each; runs of any length are words; ties of counts go to the word that is first in code-point order; an empty table
gives no row; further columns are not read, whatever their names.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import by_size, lookup, stored, table, without_gc
from .line_dedup import UPPER

LETTERS = r"[a-zÀ-ÿ]"  # after A-Z are lower-cased
SHARD, BLOCK = 25_000, 50_000
#: Words that share a half are looked up by the other part, less one code point, if there are so many and it is no longer.
CROWD, LOOKED_UP = 16, 64


def occurrences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 5, drop_one_in: int = 97) -> DataFrame:
    """(word): one row for each run of ``min_chars`` letters at least, with one code point deleted from those whose hash with the
    document ``drop_one_in`` divides."""
    whole = F.col(text)
    low = F.when(F.octet_length(whole) == F.char_length(whole), F.lower(whole)).otherwise(F.translate(whole, UPPER, UPPER.lower()))
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("_d"), F.explode(F.regexp_extract_all(low, F.lit(LETTERS + f"{{{min_chars},}}"), 0)).alias("_run"))
    hashed = runs.select("_run", F.crc32(F.concat("_d", F.lit(":"), "_run").cast("binary")).alias("_h"))
    at = (F.col("_h") % F.char_length("_run")).cast("int")
    less = F.concat(F.substring(F.col("_run"), F.lit(1), at), F.substring(F.col("_run"), at + 2, F.char_length("_run")))
    words = hashed.select(F.when(F.col("_h") % drop_one_in == 0, less).otherwise(F.col("_run")).alias("word"))
    return words.where(F.char_length("word") >= min_chars)


def vocabulary(words: DataFrame, min_count: int = 3) -> DataFrame:
    """(word, n, size) of the words that occur ``min_count`` times at least; counts are added up before the shuffle."""
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count).withColumn("size", F.char_length("word"))


def one_edit(a: str, b: str) -> bool:
    """Whether the words differ by exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i, n = 0, len(a)
    while i < n and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


def _shorter(part: str) -> set[str]:
    return {part[:i] + part[i + 1 :] for i in range(len(part))} | {part}


class Shard:
    """An automaton of both halves of words of one length."""

    def __init__(self, words: list[str], counts: list[int]):
        import ahocorasick

        self.words, self.counts, self.size = words, counts, len(words[0])
        self.half = self.size // 2
        self.first: dict[str, list[int]] = {}
        self.last: dict[str, list[int]] = {}
        for k, w in enumerate(words):
            self.first.setdefault(w[: self.half], []).append(k)
            self.last.setdefault(w[self.half :], []).append(k)
        self.crowds: dict[tuple[bool, str], dict[str, list[int]]] = {}
        self.automaton = ahocorasick.Automaton()
        for segment in self.first.keys() | self.last.keys():
            self.automaton.add_word(segment, segment)
        self.automaton.make_automaton()

    def _sharing(self, begins: bool, segment: str, rest: str) -> list[int] | set[int]:
        """Words with this half, those whose other part cannot fit ``rest`` left out if they are many."""
        there = (self.first if begins else self.last).get(segment, ())
        if len(there) < CROWD or self.size > LOOKED_UP:
            return there
        by_part = self.crowds.get((begins, segment))
        if by_part is None:
            by_part = self.crowds[begins, segment] = {}
            for k in there:
                for part in _shorter(self.words[k][self.half :] if begins else self.words[k][: self.half]):
                    by_part.setdefault(part, []).append(k)
        return {k for part in _shorter(rest) for k in by_part.get(part, ())}

    def near(self, word: str) -> set[int]:
        """The words of the shard at one edit from ``word``."""
        found, seen, n = set(), set(), len(word)
        for end, segment in self.automaton.iter(word):
            size = len(segment)
            if end + 1 == size:  # at the beginning, where a first half has to be
                if size == self.half:
                    seen.update(self._sharing(True, segment, word[size:]))
            if end + 1 == n and size == self.size - self.half:  # at the end, where a last half has to be
                seen.update(self._sharing(False, segment, word[: n - size]))
        words = self.words
        found.update(k for k in seen if one_edit(words[k], word))
        return found


def near_words(known: DataFrame, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best_n, best) for each word of ``known`` (word, n, size; written before) that has near words: their number and
    the most frequent one, of equals the first."""
    sizes = stored(known.groupBy("size").agg(F.count("*").alias("_n")), "spelling-sizes")
    around = sizes.select("_n", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)).alias("size")).groupBy("size").agg(F.sum("_n").alias("_scanned"))
    dealt = stored(
        sizes.join(around, "size").select("size", F.ceil(F.col("_n") / shard).cast("int").alias("_shards"), F.ceil(F.col("_scanned") / block).cast("int").alias("_blocks")), "spelling-shards"
    )
    parts = lambda column, salt, n: F.pmod(F.xxhash64(F.lit(salt), column), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    held = known.join(by_size(dealt), "size").select("word", "n", "size", parts("word", 0, F.col("_shards")).alias("_s"), each(F.col("_blocks")).alias("_b"))
    asked = known.select(F.col("word").alias("asked"), F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)).alias("size")).join(by_size(dealt), "size")
    asked = asked.select("asked", "size", each(F.col("_shards")).alias("_s"), parts("asked", 1, F.col("_blocks")).alias("_b"))

    @without_gc
    def scan(patterns: pa.Table, words: pa.Table) -> pa.Table:
        out: tuple[list, list, list, list] = ([], [], [], [])
        if patterns.num_rows:
            one = Shard(patterns.column("word").to_pylist(), patterns.column("n").to_pylist())
            for word in words.column("asked").to_pylist():
                if found := one.near(word):
                    best = min(found, key=lambda k: (-one.counts[k], one.words[k]))
                    for column, value in zip(out, (word, len(found), one.counts[best], one.words[best])):
                        column.append(value)
        return pa.table([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], names=["word", "n_near", "best_n", "best"])

    def cell(patterns: pa.Table, words: pa.Table) -> pa.Table:
        return scan(patterns, words)

    key = ["size", "_s", "_b"]
    cells = held.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(cell, "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))).alias("_b")
    return cells.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("_b.less")).alias("best_n"), F.col("_b.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for each row of ``forms`` (word, form): where following forms ends. Forms never lead in a circle."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    open_ = -1
    while open_:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        now = stored(lookup(now, ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        open_ = now.where("_moved").count()
        now = now.select("word", "root")
    return now


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 5, min_count: int = 3, drop_one_in: int = 97, ratio: int = 2, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of all words."""
    known = stored(vocabulary(occurrences(docs, doc_id, text, min_chars, drop_one_in), min_count), "words")
    near = known.select("word", "n").join(near_words(known, shard, block), "word", "left")
    leads = F.col("best_n") >= ratio * F.col("n")
    found = stored(near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(leads, F.col("best")).alias("form"), F.when(leads, F.col("best_n")).alias("form_n")), "near")
    ends = roots(found.where("form IS NOT NULL"))
    return found.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def query(spark, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents", "doc_id", "text"))


SQL = r"""
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' AS head,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]{5,}')) AS run
  FROM documents
), bytes AS (
  SELECT run, list_transform(string_split(head || run, ''),
           lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [(192 + (ord(c) >> 6))::BIGINT, (128 + (ord(c) & 63))::BIGINT] END) AS b
  FROM runs
), hashed AS (
  SELECT run, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(b)),
           lambda h, b: list_reduce([xor(h, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS h
  FROM bytes
), words AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed
), known AS (
  SELECT word, count(*) AS n FROM words WHERE length(word) >= 5 GROUP BY word HAVING count(*) >= 3
), less AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS part FROM (SELECT word, n, unnest(range(length(word))) AS i FROM known)
), pairs AS (
  SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.part = b.part AND a.i = b.i AND a.word <> b.word AND length(a.word) = length(b.word)
  UNION
  SELECT a.word, k.word, k.n FROM less a JOIN known k ON a.part = k.word
  UNION
  SELECT k.word, a.word, a.n FROM less a JOIN known k ON a.part = k.word
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS other_n FROM pairs GROUP BY word
), formed AS (
  SELECT k.word, k.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * k.n THEN other END AS form, CASE WHEN other_n >= 2 * k.n THEN other_n END AS form_n
  FROM known k LEFT JOIN best b ON b.word = k.word
), followed AS (
  SELECT word, word AS root, 0 AS depth FROM formed
  UNION ALL
  SELECT f.word, g.form, depth + 1 FROM followed f JOIN formed g ON g.word = f.root WHERE g.form IS NOT NULL
)
SELECT f.word, f.n, n_near, form, form_n, root FROM formed f
JOIN (SELECT word, arg_max(root, depth) AS root FROM followed GROUP BY word) r ON r.word = f.word
"""
