"""BPE encoding and decoding by prefix-sharing trie traversal.

BPE has a property that makes prefixes worth sharing: the encoding of a prefix is the encoding of a shorter
prefix plus one last token, namely the one vocabulary suffix of the prefix that forms a stable pair with the last
token before it. So the distinct new words of a block of documents go into a trie, and one depth-first traversal
carries, for each prefix, its last token; the encodings of shared prefixes are computed once, and a word's ids
are read off backwards from its node. Pieces of text between white space are looked up in a table of what was
encoded before (bounded by ``cache_pieces``, for speed only); documents are looked up piece by piece.

The vocabulary is a file of the tokenizers library whose path is a parameter. The driver reads it and broadcasts
its tables: a vocabulary is of fixed size, independent of the data, and is refused above ``max_vocab`` entries.

Supported files: BPE with an end-of-word suffix, NFC / white space / lower case normalisation, a split pattern and
byte-level symbols, special tokens matched in the raw text, and no decoder (tokens joined by a space).

Defined results for odd rows: null text encodes as the empty text, to no ids; a null or repeated doc_id passes
through; ids and decoded text come back whole at any length; an empty table gives no row; further columns are not read
unless named, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import prepare, table, utf8, without_gc

_WIDE_SPACE = re.compile("[" + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]")

_UNSURE = re.compile("[\u0378-\U0010ffff]")


def byte_symbols() -> list[str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Vocabulary:
    """What the tokenizer file says, as plain tables."""

    def __init__(self, path: str, max_vocab: int = 1 << 20):
        with open(path, encoding="utf-8") as f:
            self.spec = f.read()
        spec = json.loads(self.spec)
        model, steps = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        normal = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        if model["type"] != "BPE" or normal != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in steps] != ["Split", "ByteLevel"] or spec["decoder"] is not None:
            raise ValueError(f"not a tokenizer of the supported kind: {path}")
        if len(model["vocab"]) > max_vocab:
            raise ValueError(f"{len(model['vocab'])} entries are over max_vocab={max_vocab}")
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.pattern: str = steps[0]["pattern"]["Regex"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}


class TrieEncoder:
    """Encodes words, as sequences of symbols, by depth-first traversal of a trie."""

    def __init__(self, vocabulary: Vocabulary):
        ids = vocabulary.ids
        self.rank: dict[int, int] = {}  # token -> merge rank; symbols of the alphabet have none
        self.pair: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for r, (left, right) in enumerate(vocabulary.merges):
            a, b, c = ids[left], ids[right], ids[left + right]
            self.pair.setdefault((a, b), (r, c))
            if c not in self.rank:
                self.rank[c], self.parts[c] = r, (a, b)
        self.ids, self.suffix = ids, vocabulary.suffix
        self.stable: dict[int, bool] = {}
        self.begun = {t[:k] for t in ids for k in range(1, len(t) + 1)}  # what tokens begin with
        self.moves: dict[str, tuple[str, list[tuple[int, int]]]] = {}

    def _is_stable(self, left: int, right: int) -> bool:
        """Whether BPE leaves this pair of tokens apart: undo their merges, latest first, and look for one across the
        border that would have come before."""
        pair, rank, parts = self.pair, self.rank, self.parts
        a, b, limit = left, right, len(pair)
        while True:
            over = pair.get((a, b))
            if over is not None and over[0] < limit:
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:  # the left token was made later: before that, its right part stood at the border
                limit, a = ra, parts[a][1]
            else:  # of equal pairs the left one is merged first, so one across the border would have come before
                limit, b = rb + 1, parts[b][0]

    def _move(self, key: str, symbol: str) -> tuple[str, list[tuple[int, int]]]:
        """The longest end of ``key`` that some token begins with, and the tokens that are ends of it, longest first,
        with their numbers of symbols. ``key`` ends in ``symbol``, which may carry the end-of-word suffix."""
        state, extra = key, len(symbol) - 1
        while state not in self.begun:
            state = state[1:]
        ends = [(len(state) - k - extra, t) for k in range(len(state) - extra) if (t := self.ids.get(state[k:])) is not None]
        if len(self.moves) > 300_000:
            self.moves.clear()
        made = self.moves[key] = (state, ends)
        return made

    def encode(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Ids of distinct byte-symbol words. In sorted order the words are the leaves of their trie as a depth-first
        traversal meets them; the branch to the current leaf is kept, with each prefix's last token, and the
        traversal returns to where the next word leaves it."""
        out: dict[str, list[int]] = {}
        moves, stable, suffix = self.moves, self.stable, self.suffix
        if len(stable) > 1_000_000:
            stable.clear()
        states: list[str] = []  # for each prefix on the branch: how far into tokens it reaches,
        last: list[int] = []  # the last token of its encoding,
        size: list[int] = []  # and that token's symbols
        before = ""
        for word in sorted(words):
            depth, most = 0, min(len(before), len(word)) - 1
            while depth < most and before[depth] == word[depth]:
                depth += 1
            before, end = word, len(word) - 1
            del states[depth:], last[depth:], size[depth:]
            state = states[-1] if depth else ""
            for at in range(depth, end + 1):
                symbol = word[at] if at < end else word[at] + suffix
                key = state + symbol
                move = moves.get(key)
                state, ends = move if move is not None else self._move(key, symbol)
                for k, token in ends:
                    if k > at:
                        break
                    pair = last[at - k] << 24 | token
                    ok = stable.get(pair)
                    if ok is None:
                        ok = stable[pair] = self._is_stable(pair >> 24, token)
                    if ok:
                        break
                else:
                    raise AssertionError(f"no last token for {word[: at + 1]}")
                states.append(state)
                last.append(token)
                size.append(k)
            at, found = end, []
            while at >= 0:
                found.append(last[at])
                at -= size[at]
            found.reverse()
            out[word] = found
        return out


class Codec:
    """Encodes and decodes whole texts; one for each Python worker."""

    def __init__(self, vocabulary: Vocabulary, cache_pieces: int = 600_000):
        self.encoder = TrieEncoder(vocabulary)
        self.table = dict(enumerate(byte_symbols()))
        self.byte_of = {s: b for b, s in self.table.items()}
        self.split, self.spec = regex.compile(vocabulary.pattern).findall, vocabulary.spec
        self.special = vocabulary.special
        self.specials = re.compile("|".join(sorted(map(re.escape, self.special), key=len, reverse=True))) if self.special else None
        self.names = {i: t.encode() for t, i in [*vocabulary.ids.items(), *vocabulary.special.items()]}
        self.as_bytes = [i.to_bytes(4, "little") for i in range(max(self.names) + 1)]
        self.marks = {t: b" " + t.encode() for t in self.special}
        self.limit = cache_pieces
        self.reset()

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.spec)

    @staticmethod
    def unknown(s: str) -> bool:
        """Whether it has letters of a later Unicode version than Python's: only the library knows what it makes of them."""
        return any(unicodedata.category(c) == "Cn" for c in set(s))

    def pieces(self, text: bytes) -> list[bytes]:
        """Normalised text, between white space."""
        if text.isascii():
            return text.lower().split()
        s = text.decode()
        if _UNSURE.search(s) and self.unknown(s):
            return self.library.normalizer.normalize_str(s).encode().split()
        if not unicodedata.is_normalized("NFC", s):
            s = unicodedata.normalize("NFC", s)
        s = _WIDE_SPACE.sub(" ", s).replace("Σ", "σ").lower()
        return s.encode().split()

    def words(self, piece: bytes) -> list[bytes]:
        """The pre-tokens of a piece."""
        s = piece.decode()
        if s.isalpha():
            return [piece]
        if s[-1] in ".,;:!?" and s[:-1].isalpha():
            return [piece[:-1], piece[-1:]]
        if _UNSURE.search(s) and self.unknown(s):
            return [bytes(map(self.byte_of.__getitem__, w)) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(s)]
        return [w.encode() for w in self.split(s)]

    def learn(self, new: set[bytes]) -> None:
        """Encode the words of new pieces that are no pieces yet, and put pieces of several words together."""
        found = {p: self.words(p) for p in new}
        unseen = {w for ws in found.values() for w in ws}.difference(self.ids)
        symbols = {w.decode("latin-1").translate(self.table): w for w in unseen}
        as_bytes, names, ids, text = self.as_bytes, self.names, self.ids, self.text
        for s, tokens in self.encoder.encode(symbols).items():
            w = symbols[s]
            ids[w] = b"".join([as_bytes[t] for t in tokens])
            text[w] = b" ".join([names[t] for t in tokens])
        for p, ws in found.items():
            if len(ws) > 1:
                ids[p] = b"".join([ids[w] for w in ws])
                text[p] = b" ".join([text[w] for w in ws])

    @without_gc
    def encode(self, texts: list[bytes | None]) -> tuple[list[bytes], list[bytes]]:
        """For each text its ids, as little-endian unsigned 32-bit integers, and its decoded text in UTF-8."""
        split: list[list[bytes]] = []
        for t in texts:
            if not t:
                split.append([])
            elif self.specials and b"<" in t and self.specials.search(s := t.decode()):
                row: list[bytes] = []
                for mark, part in zip(["", *self.specials.findall(s)], self.specials.split(s)):
                    row += [self.marks[mark], *self.pieces(part.encode())] if mark else self.pieces(part.encode())
                split.append(row)
            else:
                split.append(self.pieces(t))
        new = set().union(*split).difference(self.ids)
        if new:
            if len(self.ids) + len(new) > self.limit:
                self.reset()
                new = set().union(*split).difference(self.ids)
            self.learn(new)
        ids, text = self.ids.__getitem__, self.text.__getitem__
        return [b"".join(map(ids, row)) for row in split], [b" ".join(map(text, row)) for row in split]

    def reset(self) -> None:
        """Forget all pieces but the special tokens, whose names here hold a space, as no piece of text does."""
        self.ids = {m: self.as_bytes[self.special[t]] for t, m in self.marks.items()}
        self.text = {m: t.encode() for t, m in self.marks.items()}

    def decode(self, ids: bytes) -> bytes:
        return b" ".join([self.names[i] for i in np.frombuffer(ids, "<u4").tolist()])


_codecs: dict[tuple[str, int], Codec] = {}


def _codec(shared, mark: str, cache_pieces: int) -> Codec:
    """The worker's codec; it outlives a task, so that later tasks find the pieces of earlier ones."""
    key = (mark, cache_pieces)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(shared.value, cache_pieces)
    return _codecs[key]


def blocks(batch: pa.RecordBatch, text: int, rows: int, size: int = 1 << 20):
    """The rows of ``batch`` in pieces of at most ``rows`` rows and ``size`` bytes of column ``text``, a longer text alone: what is
    held of a block's pieces, ids and decoded texts is many times its bytes, and a worker keeps that memory."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
        stop = min(max(stop, at + 1), at + rows)
        yield batch.slice(at, stop - at)
        at = stop


_OUTPUTS = {"ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def encode_decode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", outputs: tuple[str, ...] = ("ids", "decoded"), keep: tuple[str, ...] = (), cache_pieces: int = 600_000, block: int = 1000) -> DataFrame:
    """(doc_id, the columns of ``keep``, n_tokens, and the ``outputs`` named of ids, decoded, ids_sha256 and
    decoded_sha256)."""
    spark: SparkSession = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(Vocabulary(path))
    with open(path, "rb") as f:
        mark = hashlib.md5(f.read()).hexdigest()
    source = docs.select(F.col(doc_id).alias("doc_id"), *keep, utf8(text).alias("_text"))
    names = [*source.columns[:-1], "n_tokens", *outputs]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), "n_tokens long", *(f"{x} {_OUTPUTS[x]}" for x in outputs)])

    def made(name: str, ids: list[bytes], decoded: list[bytes]) -> pa.Array:
        if name == "ids":
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))
        if name == "decoded":
            return pa.array([x.decode() for x in decoded], pa.string())
        return pa.array([hashlib.sha256(x).hexdigest() for x in (ids if name == "ids_sha256" else decoded)], pa.string())

    def run(batches):
        codec = _codec(shared, mark, cache_pieces)
        for batch in batches:
            for part in blocks(batch, batch.num_columns - 1, block):
                ids, decoded = codec.encode(part.column(part.num_columns - 1).to_pylist())
                n = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], n, *(made(x, ids, decoded) for x in outputs)], names=names)

    return source.mapInArrow(run, schema)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents", "doc_id", "text"), default_path(), outputs=("ids_sha256", "decoded_sha256"))
