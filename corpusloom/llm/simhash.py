"""SimHash near-duplicate detection by anchor-point covering.

A fingerprint is 64 bits in three blocks of 22, 21 and 21 bits. Each block, padded with zeros to 23 bits, is a
point of the space that the binary Golay code covers with radius 3: its 4,096 code words are the anchors. Of two
fingerprints at most ``threshold`` (4) bits apart, some g of the three blocks together differ in at most
t = floor(threshold * g / 3) bits (g = 1: one block, t = 1; g = 2: two blocks, t = 2). So for each choice of g blocks
a fingerprint stays at home at its nearest anchor and visits every anchor within covering radius plus t; each
linked pair meets at the home anchor of either. Anchors number 4096^g for each choice of blocks; g follows the
counted number of distinct fingerprints, so that a home holds few of them at any size (thresholds over 4 have one block only), and either g finds every link.

Equal fingerprints are one point from the start. At each anchor homes are compared with visitors in blocks of
bounded size, and only a spanning forest of the links found leaves the task, never all pairs. An anchor with
more than ``home_limit`` homes is dealt out: its homes by hash over several tasks, to each of which its
visitors go.

Defined results for odd rows: null or empty text, and text of white space, has fingerprint zero, linked like any
other; rows with equal doc_id are one document wherever they link; a null doc_id gets a fingerprint, takes no
part in links and has a null component; very long texts are hashed in pieces of bounded size; an empty table gives an
empty one; columns other than the two are not read, or pass through ``keep_one`` whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import lookup, map_rows, stored, table, tag_of, utf8
from .components import components

BLOCKS = ((0, 22), (22, 21), (43, 21))
GOLAY = 0b101011100011  # fixed value: generator polynomial of the binary Golay code of length 23
_PIECE = 1 << 16


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """A-Z lower-cased, words between ASCII white space; bit i is set if it is in over half the shingles' XXH64."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    last = max(len(words) - shingle, 0)
    spans = zip(begins[: last + 1], ends[min(shingle, len(words)) - 1 :])
    digest = xxhash.xxh64_intdigest
    total, bits = last + 1, np.zeros(64, np.int64)
    hashes = (digest(line[a:b], 42) for a, b in spans)
    while last >= 0:
        part = np.fromiter(hashes, np.uint64, min(_PIECE, last + 1))
        bits += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
        last -= len(part)
    return int(np.packbits(2 * bits > total, bitorder="little").view(np.uint64)[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def rows(ids, texts):
        return ids, [signed(fingerprint(t, shingle)) for t in texts]

    return map_rows(docs.select(F.col(doc_id).alias("doc_id"), utf8(text)), rows, f"doc_id {kind}, fp long")


class Golay:
    """Per syndrome of the (23, 12) code, the error patterns of weight up to 5, by the flips they cost beyond radius 3."""

    def __init__(self, cost: int):
        unit = []
        for i in range(23):
            r = 1 << i
            for b in range(22, 10, -1):
                if r >> b & 1:
                    r ^= GOLAY << (b - 11)
            unit.append(r)
        self.unit = unit
        near: list[list[tuple[int, int]]] = [[] for _ in range(2048)]
        for weight in range(3 + cost + 1):
            for bits in combinations(range(23), weight):
                s = e = 0
                for b in bits:
                    s ^= unit[b]
                    e |= 1 << b
                near[s].append((max(0, weight - 3), e))
        self.near = near
        low = [0] * 4096
        high = [0] * 2048
        for x in range(1, 4096):
            b = (x & -x).bit_length() - 1
            low[x] = low[x & (x - 1)] ^ unit[b]
            if x < 2048:
                high[x] = high[x & (x - 1)] ^ unit[12 + b]
        self.low, self.high = low, high

    def anchors(self, x: int) -> list[tuple[int, int]]:
        """(cost, anchor) of the code words within radius 3 plus the cost; the first has cost 0 and is the nearest."""
        s = self.low[x & 4095] ^ self.high[x >> 12]
        return [(c, (x ^ e) >> 11) for c, e in self.near[s]]  # the 12 upper bits of a code word name it


def anchor_keys(fp: int, g: int, threshold: int, code: Golay) -> tuple[list[int], list[int]]:
    """Home keys and visited keys of a fingerprint: the choice of blocks, then 12 bits for each block."""
    t = threshold * g // 3
    blocks = [code.anchors(fp >> at & (1 << size) - 1) for at, size in BLOCKS]
    homes, visits = [], []
    for k, choice in enumerate(combinations(range(3), g)):
        reach = [(0, k)]
        for i in choice:
            reach = [(c + d, key << 12 | a) for c, key in reach for d, a in blocks[i] if c + d <= t]
        homes.append(reach[0][1])
        visits += [key for _, key in reach]
    return homes, visits


def forest(a: np.ndarray, b: np.ndarray, threshold: int, piece: int = 1024) -> list[tuple[int, int]]:
    """Links between ``a`` and ``b`` at most ``threshold`` bits apart, reduced to a spanning forest."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    kept = []
    for i in range(0, len(a), piece):
        for j in range(0, len(b), piece):
            x, y = a[i : i + piece], b[j : j + piece]
            apart = np.bitwise_count(x[:, None] ^ y[None, :])
            near = (apart <= threshold) & (apart > 0)
            todo = near.any(1)
            while todo.any():
                first = int(np.argmax(todo))
                rows = near[first : first + 1]
                while True:
                    columns = rows.any(0)
                    members = near[:, columns].any(1)
                    if members.sum() == len(rows):
                        break
                    rows = near[members]
                todo &= ~members
                whole = [*x[members].tolist(), *y[columns].tolist()]
                for v in whole[1:]:
                    if (r := root(whole[0])) != (s := root(v)):
                        parent[max(r, s)] = min(r, s)
                        kept.append((min(r, s), max(r, s)))
    return kept


def links(points: DataFrame, threshold: int = 4, home_limit: int = 4096, small: int = 1 << 26) -> DataFrame:
    """(a, b): links between the distinct fingerprints ``points.fp`` that span every component of the links at most
    ``threshold`` bits apart."""
    n = points.count()
    # Two blocks hold fewer homes at an anchor, and ten times the rows: worth it where comparing costs more than moving them.
    g = 2 if n > small and threshold * 2 // 3 <= 2 else 1
    if threshold * g // 3 > 2:
        raise ValueError("the anchors of this code serve thresholds up to 8")
    cost = threshold * g // 3

    def deal(batches):
        code = Golay(cost)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                keys, home, fps = [], [], []
                for fp in batch.column(0)[at : at + 4096].to_pylist():
                    h, v = anchor_keys(fp & (1 << 64) - 1, g, threshold, code)
                    keys += h + v
                    home += [True] * len(h) + [False] * len(v)
                    fps += [fp] * (len(h) + len(v))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(home), pa.array(fps, pa.int64())], names=["anchor", "home", "fp"])

    dealt = points.select("fp").mapInArrow(deal, "anchor long, home boolean, fp long")
    dealt = stored(dealt, "anchors")
    large = dealt.where("home").groupBy("anchor").count().where(F.col("count") > home_limit)
    parts = large.select("anchor", F.ceil(F.col("count") / home_limit).cast("int").alias("parts"))
    sized = dealt.join(parts, "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    spread = sized.select(
        "anchor", "home", "fp", F.explode(F.when(F.col("home"), F.array(F.pmod(F.xxhash64("fp"), "parts").cast("int"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))).alias("part")
    )

    def meet(batches):
        def found(homes, visitors):
            a = np.concatenate(homes).view(np.uint64) if homes else np.zeros(0, np.uint64)
            for b in visitors:
                for i, j in forest(a, b.view(np.uint64), threshold) if len(a) else ():
                    yield signed(i), signed(j)

        now, homes, visitors, held, out = None, [], [], 0, []

        def flush():
            nonlocal homes, visitors, held
            out.extend(found(homes, [np.concatenate(visitors)] if visitors else []))
            visitors, held = [], 0

        for batch in batches:
            anchor, part, home, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            change = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(part) != 0)) + 1
            edges = [0, *change.tolist(), len(anchor)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if (anchor[lo], part[lo]) != now:
                    flush()
                    now, homes = (anchor[lo], part[lo]), []
                split = lo + int(np.count_nonzero(home[lo:hi]))
                if split > lo:
                    homes.append(fp[lo:split].copy())
                if hi > split:
                    visitors.append(fp[split:hi].copy())
                    held += hi - split
                if held > 1 << 20:
                    flush()
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])
                out.clear()
        flush()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    ordered = spread.repartition("anchor", "part").sortWithinPartitions("anchor", "part", F.desc("home")).select("anchor", "part", "home", "fp")
    return ordered.mapInArrow(meet, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, threshold: int = 4, home_limit: int = 4096) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that links reach, itself included."""
    prints = stored(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    points = stored(prints.where(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("first")), "points")
    members = components(links(points, threshold, home_limit))
    named = points.join(stored(members, "members").select(F.col("node").alias("fp"), "component"), "fp", "left")
    named = named.select("fp", "first", F.coalesce("component", "fp").alias("component"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = stored(lookup(named, smallest, "component").select("fp", "component_id"), "classes")
    joined = lookup(prints, classes, "fp", "left")
    return joined.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, threshold: int = 4) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one of smallest doc_id. Rows that share that doc_id
    are one document and stay; so do rows with a null doc_id. Fingerprints of ``threshold`` bits that are 4 or 5 serve exact and all but
    exact copies; 8 bits are what texts of 0.8 to 0.85 of shingles in common differ in on the average."""
    found = near_duplicates(docs, doc_id, text, shingle, threshold)
    name = tag_of(docs) + "gone"
    gone = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col(doc_id) == F.col(name), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
