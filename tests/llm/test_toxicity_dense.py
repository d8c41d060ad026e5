from __future__ import annotations

import math
import random

import numpy as np

from corpusloom.llm import toxicity as tox

BUCKETS = 1 << 10


def slow_features(text, sizes=tox.SIZES):
    letters = [ord(c) if c.isalpha() else 32 for c in f" {(text or '').lower()} "]
    found = set()
    for n in sizes:
        for i in range(len(letters) - n + 1):
            window = letters[i : i + n]
            if 32 not in window[1:-1]:
                h = n
                for c in window:
                    h = (h ^ c) * 0x01000193 & 0xFFFFFFFF
                    h ^= h >> 15
                found.add(h & (BUCKETS - 1))
    return sorted(found)


def slow_model(texts, labels, smooth=4.0, penalty=1e-2, rounds=80, min_docs=3):
    """Dense matrices, one column for each bucket."""
    x, y = np.zeros((len(texts), BUCKETS)), np.array(labels, float)
    for row, text in zip(x, texts):
        row[slow_features(text)] = 1
    n, n1, df, toxic = len(y), y.sum(), x.sum(0), (x * y[:, None]).sum(0)
    share = n1 / n
    ratio = np.log((toxic + smooth * share) / n1) - np.log((df - toxic + smooth * (1 - share)) / (n - n1))
    x = x * np.where(df >= min_docs, ratio, 0)
    each = np.where(y > 0, 0.5 / n1, 0.5 / (n - n1))
    theta = np.append(np.zeros(BUCKETS), math.log(share / (1 - share)))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        error = each * (1 / (1 + np.exp(-(x @ theta[:-1] + theta[-1]))) - y)
        gradient = np.append(x.T @ error + penalty * theta[:-1], error.sum())
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return lambda row: 1 / (1 + math.exp(-(sum(theta[f] * (ratio[f] if df[f] >= min_docs else 0) for f in row) + theta[-1])))


def test_against_a_dense_fit(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    bad, good = [word() for _ in range(20)], [word() for _ in range(60)]
    rows, labels = [], []
    for n in range(240):
        toxic = n % 3 == 0
        text = [rng.choice(good) for _ in range(rng.randint(0, 30))] + [rng.choice(bad) for _ in range(3 * toxic)]
        rng.shuffle(text)
        rows.append((n, None if n == 5 else " ".join(text).upper() if n % 4 else "-".join(text)))
        labels.append((n, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = tox.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), buckets=BUCKETS)
    dense = slow_model([t for _, t in rows], [y for _, y in labels])
    scores = {r.doc_id: r.score for r in tox.score(docs, model).collect()}
    worst = max(abs(scores[n] - dense(slow_features(t))) for n, t in rows)
    assert worst < 2e-3 and max(scores.values()) > 0.7 and min(scores.values()) < 0.3


def test_repeated_rows_long_texts_and_names(spark):
    """Repeated rows are scored each; texts of any length are read whole; own names may be columns of the table."""
    from pyspark.sql import functions as F

    rows = [(n, ("vile nasty scum " if n % 2 else "kind gentle people ") * 3) for n in range(60)]
    docs = spark.createDataFrame([*rows, rows[1], rows[1], (100, "kind gentle people " * 20_000), (101, "plain " * 20_000 + "vile nasty scum " * 20_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(n, n % 2) for n in range(60)], "doc_id long, toxic int")
    model = tox.train(docs, labels)
    clash = docs.withColumns({c: F.lit(1) for c in ("_id", "_y", "score", "features")})
    scores = [(r.doc_id, r.score) for r in tox.score(clash, model).collect()]
    assert len(scores) == 64 and len({s for d, s in scores if d == 1}) == 1
    by = dict(scores)
    assert by[100] < 0.5 < by[101]
    assert set(tox.drop_toxic(clash, model).columns) == set(clash.columns)
