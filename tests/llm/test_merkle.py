from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import merkle
from tests.conftest import assert_same

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def slow_leaf(row, text):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(*map(field, (row[0], row[3], row[2], row[4], text)))


def slow_levels(nodes, fan):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + fan]) for i in range(0, len(levels[-1]), fan)])
    return levels


def slow_path(levels, at, fan):
    path = []
    for nodes in levels[:-1]:
        run = nodes[at // fan * fan : at // fan * fan + fan]
        path.append((run[: at % fan], run[at % fan + 1 :]))
        at //= fan
    return path


def slow(rows, fan=8):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, slow_leaf(row, row[1]), row))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: slow_levels([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], fan) for g in names}
    over = slow_levels([trees[g][-1][0] for g in names], fan)
    out = []
    for n, g in enumerate(names):
        for at, (_, _, leaf, row) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            path = slow_path(trees[g], at, fan) + slow_path(over, n, fan)
            text = row[1]
            if text is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            d = slow_leaf(row, text)
            for left, right in path:
                d = h(*left, d, *right)
            out.append((row[0], leaf, trees[g][-1][0], over[-1][0], h(*(s for left, right in path for s in left + right)), d, d == over[-1][0]))
    return sorted(out, key=str)


def found(spark, rows, tmp_path, schema=SCHEMA):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in merkle.query(spark, str(tmp_path)).collect()), key=str)


def test_brute_force_over_odd_rows(spark, tmp_path):
    rows = [(i, f"Text {i} É" if i % 7 else None, ("en", None, "", "é", "zz")[i * i % 5], None if i % 11 == 0 else f"s{i % 3}", i if i % 13 else None) for i in range(300)]
    rows += [(None, "lost", "en", "a", 1), (None, None, None, None, None), (5, "Other", "en", "a", 1), (5, "Other", "en", "a", 1), (5, "Other", "en", "a", 1), (900, "", "alone", "", 0), (901, "Y" * 300_000, "en", "x", 2)]
    assert found(spark, rows, tmp_path) == slow(rows)


@pytest.mark.parametrize("n", [1, 8, 9, 65])
def test_one_group(spark, tmp_path, n):
    rows = [(i, f"A{i}", "en", "s", i) for i in range(n)]
    assert found(spark, rows, tmp_path) == slow(rows)


def test_empty_table(spark, tmp_path):
    assert found(spark, [], tmp_path) == []


def test_other_fans_and_clashing_names(spark):
    rows = [(i, f"A{i}", ("en", "fr")[i % 2], "s", i) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("_g", "_at", "_size", "_proof", "_row", "_kid", "_tie")})
    made = merkle.manifest(docs, merkle.leaf({c: F.col(c) for c in merkle.FIELDS}), fan=3)
    proved = merkle.with_proofs(made, 3).select(merkle.folded(F.col("_digest"), F.col("_proof")).alias("f"))
    assert {r.f for r in proved.collect()} == {made.root} == {slow(rows, 3)[0][3]}
    assert proved.count() == 40


def test_changed_row_and_missing_row_are_told(spark):
    rows = [(i, f"A{i}", "en", "s", i) for i in range(20)]
    digest = merkle.leaf({c: F.col(c) for c in merkle.FIELDS})
    roots = {merkle.manifest(spark.createDataFrame(r, SCHEMA), digest).root for r in (rows, rows[:-1], [*rows[:3], (3, "B3", "en", "s", 3), *rows[4:]])}
    assert len(roots) == 3


def test_sql(spark, duck, sf):
    assert_same(merkle.query(spark, sf), duck, merkle.SQL)
