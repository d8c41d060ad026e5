"""Token counts that follow edits.

A document is kept as its pre-tokens with their token counts, in leaves under a segment tree whose nodes hold
the sums of letters and tokens below them. An edit finds its leaf by the sums, cuts a region that starts
before the edit by as much as the pre-token pattern looks ahead, and scans forward from there until a border of
the new pre-tokens falls on a border of the old ones behind the edit: from there on nothing can differ. Only pre-tokens of
that region are encoded again, and only sums on the paths of its leaves change.

Counts are those of the tokenizers library with a byte-level BPE file whose path is a parameter; strings of special
tokens in a text are ordinary text.

Defined results for odd rows: null text is the empty text, which edits may fill; positions beyond either end
mean that end, negative lengths mean zero, null inserts mean none; edits of a document apply in the order of their
array (or of ``seq``, then by position, length and insert); edits of unknown documents and null ids are ignored; each
of several rows with the same doc_id gets that doc_id's edits; texts of any length are counted whole; an empty table gives no row;
further columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import os

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import prepare, table, utf8, without_gc

# Fixed value: the pre-token pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
AHEAD = 3  # letters behind its end that may decide where a pre-token ends
LEAF = 64


class Counter:
    """Token counts of pre-tokens; each distinct one is encoded once and remembered (bounded, for speed only)."""

    def __init__(self, spec: str, limit: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = True
        self.find = regex.compile(PATTERN)
        self.known: dict[str, int] = {}
        self.limit = limit

    @without_gc
    def learn(self, tokens: set[str]) -> None:
        new = tokens.difference(self.known)
        if new:
            if len(self.known) + len(new) > self.limit:
                self.known.clear()
                new = tokens
            ordered = list(new)
            self.known.update(zip(ordered, map(len, self.tokenizer.encode_batch_fast(ordered, add_special_tokens=False))))

    def counts(self, tokens: list[str]) -> list[int]:
        try:
            return list(map(self.known.__getitem__, tokens))
        except KeyError:
            self.learn(set(tokens))
            return list(map(self.known.__getitem__, tokens))


class TokenTree:
    def __init__(self, tokens: list[str], counter: Counter):
        self.counter, self.encoded = counter, 0
        counts = counter.counts(tokens)
        self.leaves = [(tokens[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(tokens), LEAF)] or [([], [])]
        self._sum()

    def _sum(self) -> None:
        n = self.size = 1 << max(0, len(self.leaves) - 1).bit_length()
        self.letters, self.tokens = [0] * (2 * n), [0] * (2 * n)
        for i, (tokens, counts) in enumerate(self.leaves):
            self.letters[n + i], self.tokens[n + i] = sum(map(len, tokens)), sum(counts)
        for i in range(n - 1, 0, -1):
            self.letters[i] = self.letters[2 * i] + self.letters[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _put(self, i: int, leaf: tuple[list[str], list[int]]) -> None:
        self.leaves[i] = leaf
        x = self.size + i
        self.letters[x], self.tokens[x] = sum(map(len, leaf[0])), sum(leaf[1])
        while x := x >> 1:
            self.letters[x] = self.letters[2 * x] + self.letters[2 * x + 1]
            self.tokens[x] = self.tokens[2 * x] + self.tokens[2 * x + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(t for tokens, _ in self.leaves for t in tokens)

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds letter ``at`` and the letters before it."""
        x, before = 1, 0
        while x < self.size:
            x *= 2
            if at - before >= self.letters[x]:
                before += self.letters[x]
                x += 1
        return min(x - self.size, len(self.leaves) - 1), before if x - self.size < len(self.leaves) else self.letters[1] - self.letters[self.size + len(self.leaves) - 1]

    def edit(self, at: int, delete: int, insert: str) -> None:
        whole = self.letters[1]
        at = min(max(at, 0), whole)
        delete = min(max(delete, 0), whole - at)
        if not delete and not insert:
            return
        first, before = self._leaf(max(at - AHEAD, 0))
        tokens, counts = self.leaves[first]
        keep = 0
        while keep < len(tokens) and before + len(tokens[keep]) + AHEAD <= at:
            before += len(tokens[keep])
            keep += 1
        old, old_counts, last = tokens[keep:], counts[keep:], first
        while True:
            region = "".join(old)
            done = last == len(self.leaves) - 1
            if not done and before + len(region) < at + delete + AHEAD + 1:
                last += 1
                old, old_counts = old + self.leaves[last][0], old_counts + self.leaves[last][1]
                continue
            new_text = region[: at - before] + insert + region[at + delete - before :]
            shift = len(insert) - delete
            borders, p = {0: 0}, 0
            for k, t in enumerate(old):
                p += len(t)
                borders[p] = k + 1
            found, p, joined = [], 0, len(old) if done else None
            limit = len(new_text) if done else len(new_text) - AHEAD
            while p < len(new_text):
                if p >= at - before + len(insert) and (k := borders.get(p - shift)) is not None and p <= limit:
                    joined = k
                    break
                m = self.counter.find.match(new_text, p)
                found.append(m.group())
                p = m.end()
            if joined is not None:
                break
            last += 1
            old, old_counts = old + self.leaves[last][0], old_counts + self.leaves[last][1]
        self.encoded += len(found)
        leaf = tokens[:keep] + found + old[joined:], counts[:keep] + self.counter.counts(found) + old_counts[joined:]
        self._put(first, leaf)
        for i in range(first + 1, last + 1):
            self._put(i, ([], []))
        if len(leaf[0]) > 8 * LEAF:  # a large insert: deal the leaves out again; nothing is encoded for that
            flat, numbers = [t for x, _ in self.leaves for t in x], [c for _, x in self.leaves for c in x]
            self.leaves = [(flat[i : i + LEAF], numbers[i : i + LEAF]) for i in range(0, len(flat), LEAF)]
            self._sum()


_COLUMNS = "n_pretokens long, n_tokens_before long, n_tokens_after long, n_edits long, n_reencoded long"


def recount(docs: DataFrame, path: str, edits: str = "edits", doc_id: str = "doc_id", text: str = "text", block: int = 500) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens_before, n_tokens_after, n_edits, n_reencoded, text_sha256) of documents whose column
    ``edits`` is an array of (pos, n_delete, insert); text_sha256 is that of the edited text."""
    with open(path, encoding="utf-8") as f:
        spec = prepare(docs.sparkSession).sparkContext.broadcast(f.read())  # a vocabulary file: of fixed size
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        counter = Counter(spec.value)
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                split = [counter.find.findall(t.decode()) if t else [] for t in part.column(1).to_pylist()]
                counter.learn(set().union(*split))
                rows = []
                for tokens, todo in zip(split, part.column(2).to_pylist()):
                    tree = TokenTree(tokens, counter)
                    before = tree.total
                    for e in todo or ():
                        if e is not None:
                            tree.edit(e["pos"] or 0, e["n_delete"] or 0, e["insert"] or "")
                    rows.append((len(tokens), before, tree.total, len(todo or ()), tree.encoded, hashlib.sha256(tree.text().encode()).hexdigest()))
                columns = [pa.array(c) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", "n_pretokens", "n_tokens_before", "n_tokens_after", "n_edits", "n_reencoded", "text_sha256"])

    source = docs.select(F.col(doc_id).alias("doc_id"), utf8(text), F.col(edits).alias("edits"))
    return source.mapInArrow(run, f"doc_id {kind}, {_COLUMNS}, text_sha256 string")


def recount_from(docs: DataFrame, edits: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``recount`` with edits from a table (doc_id, seq, pos, n_delete, insert). A document's edits meet in its row, so a
    document is asked to have no more of them than fit beside its text."""
    e = F.struct("seq", F.col("pos").cast("long").alias("pos"), F.col("n_delete").cast("long").alias("n_delete"), "insert")
    grouped = edits.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.sort_array(F.collect_list(e)).alias("_edits"))
    bare = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))  # without columns that could have the names made here
    joined = bare.join(grouped, F.col("doc_id") == F.col("_id"), "left")
    plain = F.transform(F.coalesce("_edits", F.array()), lambda x: F.struct(x["pos"].alias("pos"), x["n_delete"].alias("n_delete"), x["insert"].alias("insert")))
    return recount(joined.withColumn("_plain", plain), path, "_plain")


def scripted_edits(doc_id: str = "doc_id", text: str = "text"):
    """An edit script that follows from each row: a cut, an insert of the document's own words, and a replacement."""
    size = F.char_length(F.coalesce(F.col(text), F.lit("")))
    place = lambda k: F.pmod(F.xxhash64(F.lit(k), F.col(doc_id)), size + 1)
    edit = lambda pos, delete, insert: F.struct(pos.cast("long").alias("pos"), delete.cast("long").alias("n_delete"), insert.alias("insert"))
    piece = F.substring(F.coalesce(F.col(text), F.lit("")), (place(4) + 1).cast("int"), F.lit(120))
    return F.array(
        edit(place(1), F.pmod(F.xxhash64(F.lit(5), F.col(doc_id)), F.lit(80)), F.lit("")),
        edit(place(2), F.lit(0), piece),
        edit(place(3), F.lit(12), F.concat(F.lit(" edit "), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("'ll\n"))),
    )


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return recount(docs.withColumn("edits", scripted_edits()), default_path())
