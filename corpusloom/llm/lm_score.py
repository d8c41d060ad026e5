"""Language-model scoring with a causal self-attention model trained in numpy on subword ids.

Text is its words (A-Z lower-cased, between ASCII white space) and one end. Each word becomes subword ids of a public
byte-level vocabulary, without loss, so the model's probability of the ids is one of the text. The ``active``
subwords most frequent in all training documents are predicted in two steps, class and then member; all others share
one more class and are told apart by their corpus counts.

The logits of both steps start from smoothed bigram counts of the whole training corpus; one causal self-attention layer
with a small feed-forward layer adds what the context says. It is fitted to every subword of every training document: a
start is fitted in one task on ``start_docs`` documents, then each task goes on from there through the windows of its own
documents, and the mean of all tasks' weights over all their steps is the model. What a target itself adds to the counts is
left out of its bias while fitting. ``every`` takes one window in so many for that pass, for who must save time; all
counting is over all training documents whatever it is.

Scoring cuts each document into overlapping windows: each holds ``CONTEXT`` subwords of context and scores the next ones,
so each subword is scored once, and windows of many documents go through masked attention together.

Word counts grow with the corpus, so only the ``hot`` most frequent words are broadcast; the rest of a document's words
meet their counts in a shuffle join, summed by document.

Defined results for odd rows: null text is the empty text, one end token; very long texts pass in windows like any other;
rows with null doc_id are training rows; rows that repeat a whole (doc_id, text) come back as often as they stand; an empty
table gives an empty one; columns other than the two are not read; with no training text counts are zero and the model is
uniform over its classes.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import prepare, smallest_hashes, stored, table, utf8, without_gc
from .token_counts import PATTERN
from .toxicity import remainder

ACTIVE, CLASSES, MEMBERS = 2048, 32, 64
REST = ACTIVE  # local id of all other subwords; as a class it is number CLASSES
PAD = ACTIVE + 1
DIM, WIDE = 16, 32
CONTEXT, SCORED = 8, 24
WINDOW = CONTEXT + SCORED
END = b""  # as a word: no word of a text is empty
BLOCK = 1024  # windows of a training step
PIECE = 256  # windows that pass the model together: their tables stay in the cache, and no large ones are allotted anew each time
_CAUSAL = np.where(np.arange(WINDOW)[None, :] <= np.arange(CONTEXT, WINDOW)[:, None], 0, -1e9).astype(np.float32)

_SEEN = (_CAUSAL == 0).astype(np.float32)


class _Numbers(dict):
    """Words to numbers in order of appearance."""

    def __init__(self, names: list[bytes]):
        super().__init__(zip(names, range(len(names))))
        self.names = names

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.names)
        self.names.append(word)
        return n


class Subwords:
    """Numbers for words and, by number, their subword ids; each distinct word is encoded once and remembered (bounded, for
    speed only). Number 0 is the end. ``ranks`` is the text of a vocabulary file: base64 of the bytes and the rank on each line."""

    def __init__(self, ranks: str, limit: int = 500_000):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(str.split, ranks.splitlines())}
        self.end = max(table.values()) + 1
        self.size = self.end + 1
        self.code = "H" if self.size <= 1 << 16 else "I"
        self.encode = tiktoken.Encoding("subwords", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.bytes = np.zeros(self.size, np.int64)
        self.bytes[list(table.values())] = [len(b) for b in table]
        self.limit = limit
        self.age = 0  # grows when all numbers become void
        self.clear()

    def clear(self) -> None:
        self.age += 1
        self.names: list[bytes] = [END]
        self.number = _Numbers(self.names)
        self._flat, self._starts = array(self.code, [self.end]), array("q", [0, 1])

    @without_gc
    def numbers(self, docs: list[list[bytes]], before_clear=None) -> np.ndarray:
        """The words of all documents in one row, an end behind each document."""
        if len(self.names) > self.limit:
            if before_clear:
                before_clear()
            self.clear()
        flat: list[bytes] = []
        for words in docs:
            flat += words
            flat.append(END)
        first = len(self.names)
        found = np.fromiter(map(self.number.__getitem__, flat), np.int32, len(flat))
        for at in range(first, len(self.names), 50_000):
            # Encoded in a row: no subword reaches across the space before a word, so bytes tell where each word's end.
            new = self.names[at : at + 50_000]
            ids = np.array(self.encode(" " + b" ".join(new).decode()), np.int64)
            ends = np.cumsum(self.bytes[ids])
            wanted = np.cumsum(np.fromiter(map(len, new), np.int64, len(new)) + 1)
            starts = np.searchsorted(ends, wanted) + 1
            if (ends[starts - 1] != wanted).any():  # white space of another kind at a border: one by one
                made = [self.encode(" " + w.decode()) for w in new]
                ids = np.array([t for m in made for t in m], np.int64)
                starts = np.cumsum(np.fromiter(map(len, made), np.int64, len(made)))
            self._starts.frombytes((starts + len(self._flat)).astype(np.int64).tobytes())
            self._flat.frombytes(ids.astype(self.code).tobytes())
        return found

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each word's begin (and the last one's end); copies, so that the tables may grow."""
        return np.array(self._flat, self.code), np.array(self._starts, np.int64)


def spread(flat: np.ndarray, starts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The ids of a row of words."""
    sizes = (starts[1:] - starts[:-1])[words]
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts[words] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def windows(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, document of each window) of local ids. The input of a position is the subword before it; before
    the text stand ends. Targets past a document's end are PAD and count nothing; causality keeps their inputs apart."""
    inputs, targets, owner = [], [], []
    for k, s in enumerate(sequences):
        n = -(-len(s) // SCORED)
        x = np.full(CONTEXT + n * SCORED, s[-1], np.int32)  # every sequence ends in the end subword
        x[CONTEXT + 1 : CONTEXT + len(s)] = s[:-1]
        y = np.full(n * SCORED, PAD, np.int32)
        y[: len(s)] = s
        inputs.append(x[np.arange(n)[:, None] * SCORED + np.arange(WINDOW)])
        targets.append(y.reshape(n, SCORED))
        owner.append(np.full(n, k, np.int32))
    return np.concatenate(inputs), np.concatenate(targets), np.concatenate(owner)


def log_softmax_at(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    if len(logits) and logits.max() > 60:  # else no exponent can overflow; biases are log-probabilities, so no sum vanishes
        logits -= logits.max(1)[:, None]
    chosen = logits[np.arange(len(at)), at]
    np.exp(logits, out=logits)
    return chosen - np.log(logits @ np.ones(logits.shape[1], np.float32))


class Bias:
    """Logits of class and member from bigram counts, smoothed by the counts of single subwords."""

    def __init__(self, bigrams: np.ndarray, strength: float = 20.0):
        n = bigrams.astype(np.float64)
        single = n.sum(0) + 0.1
        by_class = np.concatenate([single[:ACTIVE].reshape(CLASSES, MEMBERS).sum(1), single[ACTIVE:]])
        of_class = np.concatenate([n[:, :ACTIVE].reshape(-1, CLASSES, MEMBERS).sum(2), n[:, ACTIVE:]], 1)
        share = single[:ACTIVE] / np.repeat(by_class[:CLASSES], MEMBERS)
        self.of_class, self.strength = of_class, strength
        self.class_floor, self.member_floor = strength * by_class / by_class.sum(), strength * share
        self.classes = np.log((of_class + self.class_floor) / (of_class.sum(1, keepdims=True) + strength)).astype(np.float32)
        members = n[:, :ACTIVE]
        members += self.member_floor
        members /= np.repeat(of_class[:, :CLASSES], MEMBERS, 1) + strength
        self.members = np.log(members, out=members).astype(np.float32)
        self.pairs = self.members.reshape(-1, MEMBERS)  # by subword before and class

    def less_class(self, before: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """How much lower the class's logit were, had this target not been counted."""
        own, floor = self.of_class[before, cls], self.class_floor[cls]
        return np.log((np.maximum(own - 1, 0) + floor) / (own + floor)).astype(np.float32)

    def less_member(self, before: np.ndarray, target: np.ndarray) -> np.ndarray:
        whole = np.exp(self.members[before, target].astype(np.float64)) * (self.of_class[before, target // MEMBERS] + self.strength)
        return np.log(np.maximum(whole - 1, self.member_floor[target]) / whole).astype(np.float32)


class Attention:
    """One causal self-attention layer and a feed-forward layer; logits are added to the bias's."""

    SHAPES = {"E": (REST + 1, DIM), "P": (WINDOW, DIM), "Q": (DIM, DIM), "K": (DIM, DIM), "V": (DIM, DIM), "A": (DIM, WIDE), "B": (WIDE, DIM), "C": (DIM, CLASSES + 1), "U": (ACTIVE, DIM)}

    def __init__(self, weights: dict[str, np.ndarray] | None = None, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.w = weights or {k: (rng.standard_normal(s) * (0.05 if k in ("C", "U") else 0.3)).astype(np.float32) for k, s in self.SHAPES.items()}
        self.tables = None

    def hidden(self, x: np.ndarray) -> tuple:
        w = self.w
        e = w["E"].take(x, 0)
        e += w["P"]
        # One product of many rows instead of one for each window.
        late, flat = np.ascontiguousarray(e[:, CONTEXT:]), e.reshape(-1, DIM)
        q = (late.reshape(-1, DIM) @ w["Q"]).reshape(late.shape)
        k, v = (flat @ w["K"]).reshape(e.shape), (flat @ w["V"]).reshape(e.shape)
        a = q @ k.transpose(0, 2, 1)
        a *= DIM**-0.5
        if a.size and max(a.max(), -a.min()) > 60:  # else no exponent can overflow and no sum vanish
            a += _CAUSAL
            a -= a.max(2, keepdims=True)
            np.exp(a, out=a)
        else:
            np.exp(a, out=a)
            a *= _SEEN
        a *= 1 / (a.reshape(-1, WINDOW) @ np.ones(WINDOW, a.dtype)).reshape(a.shape[0], SCORED, 1)
        g = a @ v
        g += late
        g = g.reshape(-1, DIM)
        r = np.maximum(g @ w["A"], 0)
        return e, q, k, v, a, g, r, g + r @ w["B"]

    def context(self, x: np.ndarray) -> np.ndarray:
        """What ``hidden`` gives last, for scoring only: projections are looked up, and exponents, which the norms of queries
        and keys bound, need no maximum (else ``hidden`` serves)."""
        if self.tables is None:
            w = self.w
            self.tables = [(w["E"] @ m, w["P"] @ m) for m in (w["Q"] * np.float32(DIM**-0.5), w["K"], w["V"], np.eye(DIM, dtype=np.float32))]
            longest = [np.sqrt((t**2).sum(1).max()) + np.sqrt((p**2).sum(1).max()) for t, p in self.tables]
            self.bounded = longest[0] * longest[1] < 80
        if not self.bounded:
            return self.hidden(x)[-1]
        late = x[:, CONTEXT:]
        (tq, pq), (tk, pk), (tv, pv), (te, pe) = self.tables
        q, k, v, g = tq.take(late, 0), tk.take(x, 0), tv.take(x, 0), te.take(late, 0)
        q += pq[CONTEXT:]
        k += pk
        v += pv
        g += pe[CONTEXT:]
        a = q @ k.transpose(0, 2, 1)
        np.exp(a, out=a)
        a *= _SEEN
        total = a.reshape(-1, WINDOW) @ np.ones(WINDOW, np.float32)
        found = (a @ v).reshape(-1, DIM)
        found /= total[:, None]
        g = g.reshape(-1, DIM)
        g += found
        r = g @ self.w["A"]
        np.maximum(r, 0, out=r)
        r = r @ self.w["B"]
        r += g
        return r

    def log_probabilities(self, x: np.ndarray, y: np.ndarray, bias: Bias) -> np.ndarray:
        """ln of the probability of class and member for each position; 0 at PAD."""
        target, before = y.ravel(), x[:, CONTEXT:].ravel()
        cls = (target // MEMBERS).astype(np.int8)
        cls[target == PAD] = CLASSES + 1
        order = np.argsort(cls, kind="stable")  # a counting sort; PAD comes last
        edges = np.searchsorted(cls[order], np.arange(CLASSES + 2))
        order = order[: edges[-1]]
        h, target, before, cls = self.context(x)[order], target[order], before[order], cls[order].astype(np.int32)
        logits = bias.classes.take(before, 0)
        logits += h @ self.w["C"]
        found = log_softmax_at(logits, cls)
        inner = edges[CLASSES]
        logits = bias.pairs.take(before[:inner] * CLASSES + cls[:inner], 0)
        u = self.w["U"]
        for c in range(CLASSES):
            own = slice(edges[c], edges[c + 1])
            logits[own] += h[own] @ u[c * MEMBERS : (c + 1) * MEMBERS].T
        found[:inner] += log_softmax_at(logits, target[:inner] % MEMBERS)
        out = np.zeros(y.size, np.float32)
        out[order] = found
        return out.reshape(y.shape)

    def gradient(self, x: np.ndarray, y: np.ndarray, bias: Bias, own: bool = True) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss and its gradient; ``own`` leaves each target's own count out of its bias."""
        w = self.w
        e, q, k, v, a, g, r, h = self.hidden(x)
        target, before = y.ravel(), x[:, CONTEXT:].ravel()
        cls = target // MEMBERS
        cls[target == PAD] = CLASSES + 1
        order = np.argsort(cls.astype(np.int8), kind="stable")
        edges = np.searchsorted(cls[order], np.arange(CLASSES + 2))
        order = order[: edges[-1]]  # PAD, which counts nothing, comes last
        total = max(len(order), 1)
        hs, target, before, cls = h[order], target[order], before[order], cls[order]
        rows = np.arange(len(order))
        grad = {}
        p = bias.classes.take(before, 0)
        p += hs @ w["C"]
        if own:
            p[rows, cls] += bias.less_class(before, cls)
        loss = _softmax(p, cls)
        p /= total
        grad["C"] = hs.T @ p
        ds = p @ w["C"].T
        inner = edges[CLASSES]
        m = bias.pairs.take(before[:inner] * CLASSES + cls[:inner], 0)
        for c in range(CLASSES):
            at = slice(edges[c], edges[c + 1])
            m[at] += hs[at] @ w["U"][c * MEMBERS : (c + 1) * MEMBERS].T
        if own:
            m[rows[:inner], target[:inner] % MEMBERS] += bias.less_member(before[:inner], target[:inner])
        loss += _softmax(m, target[:inner] % MEMBERS)
        m /= total
        grad["U"] = np.zeros_like(w["U"])
        for c in range(CLASSES):
            at, part = slice(edges[c], edges[c + 1]), slice(c * MEMBERS, (c + 1) * MEMBERS)
            grad["U"][part] = m[at].T @ hs[at]
            ds[at] += m[at] @ w["U"][part]
        dh = np.zeros_like(h)
        dh[order] = ds
        grad["B"] = r.T @ dh
        dr = (dh @ w["B"].T) * (r > 0)
        grad["A"] = g.T @ dr
        dg = (dh + dr @ w["A"].T).reshape(len(x), SCORED, DIM)
        da = dg @ v.transpose(0, 2, 1)
        da *= a  # then a * (da - sum(da * a)) is this less a times its sum
        da -= a * (da.reshape(-1, WINDOW) @ np.ones(WINDOW, da.dtype)).reshape(a.shape[0], SCORED, 1)
        da *= DIM**-0.5
        dv, dq, dk = a.transpose(0, 2, 1) @ dg, da @ k, da.transpose(0, 2, 1) @ q
        flat, late = e.reshape(-1, DIM), e[:, CONTEXT:].reshape(-1, DIM)
        dq, dk, dv = dq.reshape(-1, DIM), dk.reshape(-1, DIM), dv.reshape(-1, DIM)
        grad["Q"], grad["K"], grad["V"] = late.T @ dq, flat.T @ dk, flat.T @ dv
        de = dk @ w["K"].T
        de += dv @ w["V"].T
        de = de.reshape(e.shape)
        dg += (dq @ w["Q"].T).reshape(dg.shape)
        de[:, CONTEXT:] += dg
        grad["P"] = de.sum(0)
        at = x.ravel()
        by = np.argsort(at.astype(np.int16 if REST < 1 << 15 else np.int32), kind="stable")
        first = np.flatnonzero(np.diff(at[by], prepend=-1))
        grad["E"] = np.zeros_like(w["E"])
        grad["E"][at[by[first]]] = np.add.reduceat(de.reshape(-1, DIM)[by], first, axis=0)
        return loss / total, grad


def _softmax(logits: np.ndarray, at: np.ndarray) -> float:
    """Turn logits into their softmax less one at the target, in place; the sum of the targets' losses."""
    rows = np.arange(len(at))
    if len(logits) and logits.max() > 60:
        logits -= logits.max(1, keepdims=True)
    np.exp(logits, out=logits)
    logits *= 1 / (logits @ np.ones(logits.shape[1], logits.dtype))[:, None]
    loss = -float(np.log(logits[rows, at] + 1e-30).sum())
    logits[rows, at] -= 1
    return loss


class Trainer:
    """Adam; ``mean`` is the mean of the weights after each of ``steps`` steps."""

    def __init__(self, model: Attention, bias: Bias, rate: float):
        self.model, self.bias, self.rate, self.steps = model, bias, rate, 0
        self.m, self.v, self.mean = ({k: np.zeros_like(w) for k, w in model.w.items()} for _ in range(3))
        self.losses: list[float] = []

    def whole(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss and its gradient over all windows, added up over pieces of them."""
        loss, grad, n = 0.0, {}, np.float32(max(np.count_nonzero(y != PAD), 1))
        for at in range(0, len(x), PIECE):
            own = np.float32(np.count_nonzero(y[at : at + PIECE] != PAD)) / n
            part, made = self.model.gradient(x[at : at + PIECE], y[at : at + PIECE], self.bias)
            loss += part * float(own)
            for k, g in made.items():
                g *= own
                grad[k] = g if k not in grad else np.add(grad[k], g, out=grad[k])
        return loss, grad

    def step(self, x: np.ndarray, y: np.ndarray, share: float = 1.0) -> None:
        loss, grad = self.whole(x, y)
        self.losses.append(loss)
        self.steps += 1
        now = self.rate * share * min(1, self.steps / 50)
        for k, g in grad.items():
            m, v, w = self.m[k], self.v[k], self.model.w[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= now * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.99**self.steps)) + 1e-8)
            self.mean[k] += (w - self.mean[k]) / self.steps


def local_sequences(subwords: Subwords, local: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
    """Local ids of each document of a row of words, its end last."""
    flat, starts = subwords.tables()
    ends = np.cumsum((starts[1:] - starts[:-1])[words])[words == 0]
    return np.split(local[spread(flat, starts, words)], ends[:-1]) if len(ends) else []


class Counts:
    """Words and subwords counted, or, given the map to local ids, bigrams: pairs between words as they come, pairs within words
    once for each distinct word."""

    def __init__(self, subwords: Subwords, local: np.ndarray | None = None):
        self.subwords, self.local = subwords, local
        self.bigrams = np.zeros((REST + 1) ** 2 if local is not None else 0, np.int64)
        self.singles = np.zeros(subwords.size, np.int64)
        self.words: list[tuple[list[bytes], np.ndarray]] = []
        self.n = np.zeros(0, np.int64)

    def add(self, docs: list[list[bytes]]) -> None:
        words = self.subwords.numbers(docs, self.settle)
        n = np.bincount(words, minlength=max(len(self.n), len(self.subwords.names)))
        n[: len(self.n)] += self.n
        self.n = n
        if self.local is None:
            return
        flat, starts = self.subwords.tables()
        first, last = self.local[flat[starts[:-1]]], self.local[flat[starts[1:] - 1]]
        self.bigrams += np.bincount(last[np.concatenate([[0], words[:-1]])] * (REST + 1) + first[words], minlength=len(self.bigrams))

    def settle(self) -> None:
        """Carry over what hangs on word numbers."""
        seen = np.flatnonzero(self.n)
        if len(seen):
            flat, starts = self.subwords.tables()
            sizes = (starts[1:] - starts[:-1])[seen]
            ids = spread(flat, starts, seen)
            times = np.repeat(self.n[seen], sizes)
            if self.local is None:
                self.singles += np.bincount(ids, weights=times, minlength=len(self.singles)).astype(np.int64)
                self.words.append(([self.subwords.names[k] for k in seen], self.n[seen]))
            else:
                inner = np.ones(len(ids), bool)
                inner[np.cumsum(sizes) - 1] = False
                at = np.flatnonzero(inner)
                pairs = self.local[ids[at]] * (REST + 1) + self.local[ids[at + 1]]
                self.bigrams += np.bincount(pairs, weights=times[at], minlength=len(self.bigrams)).astype(np.int64)
        self.n = np.zeros(0, np.int64)


def active(singles: np.ndarray, end: int) -> np.ndarray:
    """The map from vocabulary ids to local ids: the most frequent ones by rank, the end always among them, REST for all others."""
    counts = singles.copy()
    counts[end] = max(counts.max(), 1) + 1
    local = np.full(len(counts), REST, np.int32)
    local[np.argsort(-counts, kind="stable")[:ACTIVE]] = np.arange(ACTIVE)
    return local


def start(docs: list[list[bytes]], subwords: Subwords, local: np.ndarray, bias: Bias, steps: int = 500, batch: int = 256, rate: float = 0.01, seed: int = 7) -> Attention:
    """Attention fitted to random windows of these documents; without documents it adds nothing to the bias."""
    model, rng = Attention(), np.random.default_rng(seed)
    if not docs:
        model.w["C"][:] = 0
        model.w["U"][:] = 0
        return model
    x, y, _ = windows(local_sequences(subwords, local, subwords.numbers(docs)))
    trainer = Trainer(model, bias, rate)
    for step in range(1, steps + 1):
        rows = rng.integers(0, len(x), batch)
        trainer.step(x[rows], y[rows], 1 - step / (steps + 1))
    return model


def go_on(trainer: Trainer, docs, subwords: Subwords, local: np.ndarray, every: int = 1, batch: int = BLOCK) -> None:
    """Fit to the windows (one in ``every``) of documents as they come, each once, ``batch`` at a time."""
    held, at = [], 0
    for part in docs:
        x, y, _ = windows(local_sequences(subwords, local, subwords.numbers(part)))
        took = slice(-at % every, None, every)
        at += len(x)
        held.append((x[took], y[took]))
        if sum(len(x) for x, _ in held) >= batch:
            x, y = (np.concatenate(c) for c in zip(*held))
            whole = len(x) // batch * batch
            for k in range(0, whole, batch):
                trainer.step(x[k : k + batch], y[k : k + batch])
            held = [(x[whole:], y[whole:])]
    if held and sum(len(x) for x, _ in held):
        trainer.step(*(np.concatenate(c) for c in zip(*held)))


def _flat(w: dict[str, np.ndarray]) -> bytes:
    return b"".join(w[k].astype(np.float32).tobytes() for k in Attention.SHAPES)


def _weights(flat: bytes) -> dict[str, np.ndarray]:
    sizes = [a * b for a, b in Attention.SHAPES.values()]
    return {k: v.reshape(Attention.SHAPES[k]).copy() for k, v in zip(Attention.SHAPES, np.split(np.frombuffer(flat, np.float32), np.cumsum(sizes)[:-1]))}


def _mean(rows: DataFrame, fan: int = 64) -> bytes | None:
    """The mean of models (steps, value) by steps. Each round adds up ``fan`` of them in a task; the last few meet in the driver."""

    def add(batches):
        total, steps = 0.0, 0
        for batch in batches:
            for n, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total, steps = total + np.frombuffer(value, np.float32) * float(n), steps + n
        if steps:
            yield pa.RecordBatch.from_arrays([pa.array([steps]), pa.array([(total / steps).astype(np.float32).tobytes()], pa.binary())], names=["steps", "value"])

    n = rows.count()
    while n > fan:
        n = -(-n // fan)
        rows = stored(rows.repartition(n).mapInArrow(add, "steps long, value binary"), "models")
    made = list(add([rows.toArrow().combine_chunks().to_batches()[0]] if n else []))
    return made[0].column(1)[0].as_py() if made else None


_subwords: dict[str, Subwords] = {}


def _known_subwords(ranks: str) -> Subwords:
    """The worker's subwords; they outlive a task, so that later tasks find the words of earlier ones."""
    name = hashlib.md5(ranks.encode()).hexdigest()
    if name not in _subwords:
        _subwords.clear()
        _subwords[name] = Subwords(ranks)
    return _subwords[name]


class Scorer:
    """``common``: words and the log10 of their share in training; nan is kept for words that are not among them."""

    def __init__(self, ranks: str, local: np.ndarray, weights: dict[str, np.ndarray], bigrams: np.ndarray, rest: np.ndarray, common: dict[bytes, float]):
        self.subwords, self.local, self.model, self.bias, self.common = _known_subwords(ranks), local, Attention(weights), Bias(bigrams), common
        alone = np.where(local == REST, rest + 0.1, 0)
        self.alone = np.log(np.where(alone > 0, alone / max(alone.sum(), 1e-9), 1))
        self.age, self.value = 0, array("d")

    def score(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each document the log10 of the model's probability and the sum over common words; then the words that are not
        common, each with its document."""
        words = self.subwords.numbers(docs)
        if self.age != self.subwords.age:
            self.age, self.value = self.subwords.age, array("d")
        names, nan, get = self.subwords.names, float("nan"), self.common.get
        self.value.extend([get(w, nan) for w in names[len(self.value) :]])
        owner = np.repeat(np.arange(len(docs)), [len(d) + 1 for d in docs])
        value = np.array(self.value)[words]
        rare = np.flatnonzero(np.isnan(value))
        base = np.bincount(owner, weights=np.nan_to_num(value), minlength=len(docs))
        known = local_sequences(self.subwords, self.local, words)
        flat, starts = self.subwords.tables()
        per_word = np.add.reduceat(self.alone[flat], starts[:-1])
        total = np.bincount(owner, weights=per_word[words], minlength=len(docs))
        x, y, of = windows(known)
        for at in range(0, len(x), PIECE):
            found = self.model.log_probabilities(x[at : at + PIECE], y[at : at + PIECE], self.bias)
            total += np.bincount(of[at : at + PIECE], weights=found.sum(1, dtype=np.float64), minlength=len(docs))
        return total / np.log(10), base, owner[rare], words[rare]


_scorers: dict[str, Scorer] = {}


def _blocks(batch: pa.RecordBatch, rows: int = 500):
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _pairs(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=names)


def score(docs: DataFrame, path: str, training, doc_id: str = "doc_id", text: str = "text", start_docs: int = 1500, steps: int = 500, every: int = 1, rate: float = 0.002, hot: int = 400_000) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of all rows; ``training`` is the condition on rows of
    ``docs`` that may be learned from."""
    spark = prepare(docs.sparkSession)
    with open(path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # a vocabulary file: of fixed size
    own = docs.where(training)

    def count(batches):
        counts = Counts(_known_subwords(spec.value))

        def settled():
            while counts.words:
                keys, values = counts.words.pop()
                yield _pairs(["word", "n"], pa.array(keys, pa.binary()), pa.array(values, pa.int64()))

        for batch in batches:
            for part in _blocks(batch):
                counts.add([words_of(t) for t in part.column(0).to_pylist()])
                yield from settled()
        counts.settle()
        yield from settled()
        at = np.flatnonzero(counts.singles)
        yield _pairs(["word", "n"], pa.array([b" 1" + k.to_bytes(4, "little") for k in at.tolist()], pa.binary()), pa.array(counts.singles[at]))

    counted = own.select(utf8(text)).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = stored(counted, "counts")
    is_word = ~F.coalesce(F.hex("word").startswith("20"), F.lit(False))
    # One row for each subword of the vocabulary at most, which is a file of fixed size.
    table = counted.where(~is_word).toArrow()
    end = max(int(line.split()[1]) for line in spec.value.splitlines()) + 1
    rest = np.zeros(end + 1, np.int64)
    rest[[int.from_bytes(k[2:], "little") for k in table.column(0).to_pylist()]] = table.column(1).to_numpy()
    local = active(rest, end)
    shared_local = spark.sparkContext.broadcast(local)

    def count_pairs(batches):
        counts = Counts(_known_subwords(spec.value), shared_local.value)
        for batch in batches:
            for part in _blocks(batch):
                counts.add([words_of(t) for t in part.column(0).to_pylist()])
        counts.settle()
        at = np.flatnonzero(counts.bigrams)
        yield _pairs(["pair", "n"], pa.array(at, pa.int32()), pa.array(counts.bigrams[at]))

    # At most (active + 1) squared rows: bounded by the model, not the data.
    table = own.select(utf8(text)).mapInArrow(count_pairs, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    bigrams = np.zeros((REST + 1) ** 2, np.float32)
    bigrams[table.column(0).to_numpy()] = table.column(1).to_numpy()
    bigrams = bigrams.reshape(REST + 1, REST + 1)
    shared_bigrams = spark.sparkContext.broadcast(bigrams)
    chosen = smallest_hashes(own.select(F.col(doc_id).alias("_id")), "_id", start_docs)
    sample = docs.select(F.col(doc_id).alias("_id"), utf8(text)).join(F.broadcast(chosen), "_id").select(text).repartition(1)

    def learn(batches):
        texts = sorted(t or b"" for b in batches for t in b.column(0).to_pylist())
        model = start([words_of(t) for t in texts], _known_subwords(spec.value), shared_local.value, Bias(shared_bigrams.value), steps)
        yield _pairs(["steps", "value"], pa.array([1]), pa.array([_flat(model.w)], pa.binary()))

    model = "steps long, value binary"
    begun = _mean(sample.mapInArrow(learn, model)) or _flat(start([], None, local, None).w)
    shared_start = spark.sparkContext.broadcast(begun)

    def train(batches):
        trainer = Trainer(Attention(_weights(shared_start.value)), Bias(shared_bigrams.value), rate)
        parts = ([words_of(t) for t in part.column(0).to_pylist()] for batch in batches for part in _blocks(batch))
        go_on(trainer, parts, _known_subwords(spec.value), shared_local.value, every)
        if trainer.steps:
            yield _pairs(["steps", "value"], pa.array([trainer.steps]), pa.array([_flat(trainer.mean)], pa.binary()))

    fitted = _mean(stored(own.select(utf8(text)).mapInArrow(train, model), "models")) or begun
    weights = _weights(fitted)
    words = counted.where(is_word)
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    space = 0.1 * (distinct + 1)
    scale = float(np.log10(total + space))
    # The hot words are those counted at least so often that ``hot`` of them at most are.
    sizes = {r.k: r["count"] for r in words.groupBy(F.least("n", F.lit(4096)).alias("k")).count().collect()}
    least, held = 4096, sizes.get(4096, 0)
    while least > 1 and held + sizes.get(least - 1, 0) <= hot:
        least -= 1
        held += sizes.get(least, 0)
    frequent = words.where(F.col("n") >= least).toArrow() if held <= hot else words.orderBy(F.desc("n"), "word").limit(hot).toArrow()
    parts = spark.sparkContext.broadcast((local, weights, bigrams, rest))
    common = spark.sparkContext.broadcast(dict(zip(frequent.column(0).to_pylist(), (np.log10(frequent.column(1).to_numpy() + 0.1) - scale).tolist())))
    mark = hashlib.md5(b"".join(v.tobytes() for v in (local, bigrams, rest)) + fitted + repr((total, distinct, least)).encode()).hexdigest()
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, text_key long, word binary, tf long, main int, n_tokens long, n_known long, base double, score double"

    def measure(batches):
        if mark not in _scorers:
            _scorers.clear()
            _scorers[mark] = Scorer(spec.value, *parts.value, common.value)
        scorer = _scorers[mark]
        names = ["doc_id", "text_key", "word", "tf", "main", "n_tokens", "n_known", "base", "score"]

        def rows(ids, keys, words, tf, main, n, known, base, score):
            return pa.RecordBatch.from_arrays([ids, keys, pa.array(words, pa.binary()), pa.array(tf, pa.int64()), pa.array(main, pa.int32()), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())], names=names)

        for batch in batches:
            for part in _blocks(batch):
                ids, keys = part.column(0), part.column(1)
                docs = [words_of(t) for t in part.column(2).to_pylist()]
                scores, base, who, rare = scorer.score(docs)
                n = np.array([len(w) + 1 for w in docs], np.int64)
                pairs, tf = np.unique(who << 32 | rare, return_counts=True)
                who, word = pairs >> 32, scorer.subwords.names
                marks = [b" " + k.to_bytes(8, "little", signed=True) for k in keys.to_pylist()]
                yield rows(ids, keys, marks, n * 0, n * 0 + 1, n, n - np.bincount(who, weights=tf, minlength=len(n)).astype(np.int64), base, scores)
                zero, at = tf * 0, pa.array(who)
                yield rows(ids.take(at), keys.take(at), [word[k] for k in (pairs & 0xFFFFFFFF).tolist()], tf, zero, zero, zero, zero * 0.0, zero * 0.0)

    source = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key"), utf8(text))
    measured = source.mapInArrow(measure, schema)
    joined = measured.join(words.select("word", "n"), "word", "left")
    cold = F.col("tf") * (F.log10(F.coalesce("n", F.lit(0)) + 0.1) - scale)
    summed = joined.groupBy("doc_id", "text_key").agg(
        F.sum("main").alias("times"),
        F.max("n_tokens").alias("n_tokens"),
        (F.sum("n_known") + F.sum(F.when(F.col("n").isNotNull(), F.col("tf")).otherwise(0))).alias("known"),
        F.sum(F.col("base") + cold).alias("base"),
        F.max(F.when(F.col("main") == 1, F.col("score"))).alias("score"),
    )
    return summed.select(
        "doc_id",
        "n_tokens",
        (F.col("known") / F.col("times")).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("times")).alias("base_score"),
        "score",
        F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))).alias("_copy"),
    ).drop("_copy")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    learned = F.coalesce(remainder("doc_id", 10) != 0, F.lit(True))
    held_out = F.coalesce(remainder("doc_id", 10) == 0, F.lit(False))
    return score(docs, default_path(), learned).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
