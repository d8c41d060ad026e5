from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from corpusloom.llm import simhash as sh
from corpusloom.llm.components import components


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(points):
    parent = dict.fromkeys(points)
    root = lambda x: x if parent[x] is None else root(parent[x])
    for a, b in combinations(points, 2):
        if (a ^ b).bit_count() <= 4 and root(a) != root(b):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {p: root(p) for p in points}


def test_fingerprints():
    rng = random.Random(1)
    texts = [None, "", " \n\t", "one", "Two WORDS", "a\x0bb\x0cc d\x85e f", "É é É", " ".join(rng.choice("abcdef") for _ in range(200_00))] + [" ".join(rng.choice(["x", "Y", "zé", "w"]) for _ in range(n)) for n in range(12)]
    for t in texts:
        assert sh.fingerprint(None if t is None else t.encode()) == slow_fingerprint(t)


def test_code_covers_with_radius_three():
    code = sh.Golay(2)
    assert all(sum(c == 0 for c, _ in near) == 1 for near in code.near)
    for e, s in [(1 << i, u) for i, u in enumerate(code.unit)]:
        assert code.low[e & 4095] ^ code.high[e >> 12] == s


@pytest.mark.parametrize("g", [1, 2])
def test_linked_pairs_meet(g):
    rng, code = random.Random(g), sh.Golay(4 * g // 3)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(1, 4)):
            b ^= 1 << bit
        home, visits = sh.anchor_keys(a, g, 4, code)[0], sh.anchor_keys(b, g, 4, code)[1]
        assert set(home) & set(visits)


@pytest.mark.parametrize(("limit", "small"), [(4096, 1 << 22), (2, 1 << 22), (4096, 1)])
def test_components_against_brute_force(spark, limit, small):
    rng, points = random.Random(5), set()
    for _ in range(40):
        p = rng.getrandbits(64)
        points.add(p)
        for _ in range(rng.choice([0, 0, 1, 6])):  # chains and clusters
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                p ^= 1 << bit
            points.add(p)
    df = spark.createDataFrame([(sh.signed(p),) for p in points], "fp long")
    found = {r.node: r.component for r in components(sh.links(df, 4, limit, small)).collect()}
    expected = slow_components(sorted(points))
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
    assert groups(found) == {frozenset(map(sh.signed, g)) for g in groups(expected) if len(g) > 1}


def test_forest_spans():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 3, dtype=np.uint64)
    points = np.unique(np.concatenate([base ^ (np.uint64(1) << np.uint64(b)) for b in range(64)]))
    kept = sh.forest(points, points, 4, piece=50)
    assert len(kept) == len(points) - 3


def test_documents(spark):
    long = " ".join(f"word{n}" for n in range(3000))
    near = long.replace("word1500 ", "")
    docs = [(5, long), (3, near), (9, long.upper()), (1, "something else entirely here today"), (7, None), (8, ""), (4, "  "), (None, long), (9, long.upper())]
    df = spark.createDataFrame([(a, b, 0) for a, b in docs], "doc_id long, text string, fp int")
    rows = sh.near_duplicates(df).collect()
    assert len(rows) == len(docs)
    assert {(r.doc_id, r.component_id) for r in rows} == {(5, 3), (3, 3), (9, 3), (1, 1), (7, 4), (8, 4), (4, 4), (None, None)}
    assert sorted(r.doc_id for r in sh.keep_one(df).where("doc_id IS NOT NULL").collect()) == [1, 3, 4]
    assert sh.near_duplicates(df.where("false")).count() == 0


def test_components_shapes(spark):
    edges = [(n, n + 1) for n in range(1, 40)] + [(100, n) for n in range(101, 160)] + [(7, 7), (None, 3), (201, 200), (200, 201)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(1, 41), 1), **dict.fromkeys(range(100, 160), 100), 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_wide_thresholds_and_hot_centres(spark):
    """Links of up to 8 bits against all pairs; a star whose centre is a hot key; columns with names like the operator's own."""
    import random

    from corpusloom.llm import components as cc

    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(40)]
    points = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 9))) for b in base for _ in range(8)})
    df = spark.createDataFrame([(sh.signed(p),) for p in points], "fp long")
    found = {(r.node, r.component) for r in cc.components(sh.links(df, threshold=8)).collect()}
    parent = {p: p for p in points}
    root = lambda p: p if parent[p] == p else root(parent[p])
    for i, a in enumerate(points):
        for b in points[:i]:
            if (a ^ b).bit_count() <= 8 and root(a) != root(b):
                parent[root(a)] = root(b)
    groups = {}
    for p in points:
        groups.setdefault(root(p), []).append(sh.signed(p))
    assert found == {(p, min(g)) for g in groups.values() if len(g) > 1 for p in g}
    star = spark.range(1, 3000).selectExpr("0L as a", "id as b").union(spark.range(5000, 5100).selectExpr("id as a", "id + 1 as b"))
    assert {(r.component, r.n) for r in cc.components(star).groupBy("component").agg(sh.F.count("*").alias("n")).collect()} == {(0, 3000), (5000, 101)}
    docs = spark.createDataFrame([(1, "a b c d e", "x"), (2, "a b c d e", "y"), (3, "other words that stand here", "z")], "doc_id long, text string, _op_gone string")
    assert sorted((r.doc_id, r._op_gone) for r in sh.keep_one(docs).collect()) == [(1, "x"), (3, "z")]
