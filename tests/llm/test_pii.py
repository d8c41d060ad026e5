from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from corpusloom.llm import pii

SCHEMA = "doc_id long, text string"
BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= sum(map(str.isdigit, v)) <= 19 and luhn(v)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= sum(map(str.isdigit, v)) <= 15),
}


def luhn(s):
    digits = [int(c) for c in reversed(s) if c.isdigit()]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0


def slow(text):
    return [f"{kind}:{m.start()}:{m.end()}" for kind, (p, good) in BASE.items() for m in re.finditer(p, text or "") if good(m.group())]


def card(rng, n=16):
    head = "4" + "".join(rng.choice("0123456789") for _ in range(n - 2))
    return next(head + d for d in "0123456789" if luhn(head + d))


def run(spark, rows, **named):
    found = pii.spans_of(spark.createDataFrame(rows, SCHEMA), **named)
    return [(r.doc_id, r.s.split(",") if r.s else [], r.b.split(",") if r.b else []) for r in found.select("doc_id", pii.as_text(F.col("spans")).alias("s"), pii.as_text(F.col("bases")).alias("b")).collect()]


def personal(rng, n):
    """Documents with data of every kind and numbers that are none."""
    rows = []
    for i in range(n):
        parts = ["é word " * rng.randint(0, 4)]
        for _ in range(rng.randint(0, 4)):
            parts.append(rng.choice([f"mail a{i}.b@mail.example.com", f"{rng.randint(1, 255)}.{rng.randint(0, 255)}.3.{rng.randint(0, 255)}", card(rng), "+1 (555) 555-%04d" % rng.randint(0, 9999), "token 1%015d" % rng.randint(0, 10**15), "300.1.2.3", "7"]))
        rows.append((i, " text ".join(parts)))
    return rows


def test_base_spans_of_random_texts(spark):
    rng = random.Random(1)
    pieces = ["a", "Z", "9", "1", "42", "0", ".", "-", " ", "@", "+", "(", ")", "%", "_", "é", "😀", "\n", "x@y.zz", "1.2.3.4", "4111111111111111", "+1 555"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 60)))) for i in range(1500)]
    got = {d: b for d, s, b in run(spark, rows)}
    assert got == {d: slow(t) for d, t in rows}


def test_odd_rows(spark):
    def texts(n):
        return ["a" * n, "1" * n, "1." * n, "a." * n + "@x", "x@" + "a." * n + "b", "+1" + " " * n, "1 " * n, "1-" * n + "2", "a:" * n, "(at)" * n]

    long = texts(1000)
    rows = [(None, None), (None, "m@x.org"), (1, ""), (1, ""), (2, "m@x.org"), (2, "n 10.0.0.1")] + [(10 + i, t) for i, t in enumerate(long)]
    got = sorted(((d, b) for d, _, b in run(spark, rows)), key=str)
    assert got == sorted(((d, slow(t)) for d, t in rows), key=str)
    n = 100_000  # where brute force would take hours
    got = {d: (len(b), b[:1]) for d, _, b in run(spark, list(enumerate(texts(n))))}
    assert got == {i: (0, []) for i in range(10)} | {2: (n // 4, ["ip:0:7"]), 4: (1, [f"email:0:{2 + 2 * n + 1}"])}


def test_many_spans_in_one_text(spark):
    text = " ".join(f"10.0.{i % 256}.{i % 250}" for i in range(20_000))
    assert run(spark, [(1, text)])[0][2] == slow(text)


def test_added_spans(spark):
    rng = random.Random(2)
    rows = personal(rng, 1500)
    a, b, c = card(rng), card(rng), card(rng)
    planted = {
        5001: (f"two {a} {b} end", [a, b]), 5002: ("ring +1 (826) 555-4081 190.137.223.204 now", ["+1 (826) 555-4081"]), 5003: ("mail bob.ray (at) mail.example (dot) com today", ["bob.ray (at) mail.example (dot) com"]),
        5004: ("mail bob at example dot com today", ["bob at example dot com"]), 5005: (f"card {c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:]} paid", [f"{c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:]}"]),
        5006: ("host 10[.]0[.]3[.]7 down", ["10[.]0[.]3[.]7"]), 5007: ("call (555) 555-0199 now", ["(555) 555-0199"]),
    }
    clean = {6000 + i: t for i, t in enumerate(["meet at home. Then go", "version 1.2.3 of 2024-01-02", "std::vector a::b 10:30:15", "order 1234567890123456 of 12 items", "the dot at noon", "1 2 3 4 5 6", "call 12-34", "www.example.com"])}
    got = {d: (s, b) for d, s, b in run(spark, rows + [(d, t) for d, (t, _) in planted.items()] + list(clean.items()))}
    for d, (text, wanted) in planted.items():
        found = [text[int(x.split(":")[1]) : int(x.split(":")[2])] for x in got[d][0]]
        assert set(wanted) <= set(found), (text, found)
    for d in clean:
        assert got[d] == ([], []), clean[d]
    for d, t in rows:  # what stands alone is found as it is; decoys are left alone
        assert got[d][0] == got[d][1] == slow(t)


def test_given_model_empty_table_and_names(spark):
    assert run(spark, []) == []
    docs = spark.createDataFrame(personal(random.Random(3), 60), SCHEMA)
    model = pii.train(pii.candidates(docs, "text", [F.col("doc_id").alias("doc_id")]))
    more = docs.withColumns({c: F.lit("x") for c in ("_row", "_gen", "_i", "kind", "f_kind", "spans", "start")})
    got = pii.spans_of(more, model=model)
    assert got.columns == ["doc_id", "spans", "bases"] and got.count() == 60


def test_steps_never_fall():
    steps = pii.monotone([(0, 5, 10), (1, 2, 10), (2, 9, 10), (3, 8, 10), (-1, 0, 4)])
    assert [at for at, _ in steps] == [-1, 0, 2] and [round(r, 2) for _, r in steps] == [0.0, 0.35, 0.85]


def test_no_python_worker(spark, sf):
    plan = pii.query(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = pii.query(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = slow(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b.startswith(k + ":") for b in base) for k in pii.KINDS]
        assert set(base) <= set(r.spans.split(",")) | {""}
