"""What a worker holds at once, and how many files a round of small tables makes."""

import numpy as np
import pyarrow as pa

from corpusloom.llm import bpe, components
from corpusloom.llm import lm_score as lm


def test_blocks_are_bounded_by_bytes():
    texts = [b"x" * n for n in (300, 300, 300, 5000, 1, 0, 999)] + [None, b"y"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts, pa.binary())], names=["doc_id", "text"])
    parts = [p.column(0).to_pylist() for p in bpe.blocks(batch.slice(1), 1, 3, 1000)]
    assert parts == [[1, 2], [3], [4, 5, 6], [7, 8]]
    assert list(bpe.blocks(batch.slice(0, 0), 1, 3)) == []


def test_encoding_takes_bounded_blocks(spark, monkeypatch):
    seen = []
    encode = bpe.Codec.encode
    monkeypatch.setattr(bpe.Codec, "encode", lambda self, texts: seen.append(sum(map(len, texts))) or encode(self, texts))
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array([b"one two " * 16_000] * 40, pa.binary())], names=["doc_id", "_text"])
    run = []

    class Frame:
        columns, sparkSession = ["doc_id", "_text"], spark
        schema = spark.createDataFrame([], "doc_id long, _text binary").schema

        def select(self, *columns):
            return self

        def mapInArrow(self, f, schema):
            run.append(f)

    bpe.encode_decode(Frame(), bpe.default_path())
    n = [x for part in run[0](iter([batch])) for x in part.column(1).to_pylist()]
    assert n == [n[0]] * 40 and n[0] >= 32_000
    assert max(seen) <= 1 << 20


def test_rounds_of_few_links_write_few_files(spark, monkeypatch):
    found = []

    def stored(df, name, store=components.stored):
        out = store(df, name)
        found.append((name, len(out.inputFiles())))
        return out

    monkeypatch.setattr(components, "stored", stored)
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = spark.createDataFrame([(k, k + 1) for k in range(100)], "a long, b long")
        assert {r.component for r in components.components(edges).collect()} == {0}
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert len(found) > 2 and all(n == 1 for name, n in found if name == "stars")


def test_a_training_step_in_pieces_is_the_step_of_the_whole(monkeypatch):
    rng = np.random.default_rng(1)
    bias = lm.Bias(rng.integers(0, 9, (lm.REST + 1, lm.REST + 1)).astype(np.float32))
    x, y, _ = lm.windows([rng.integers(0, lm.REST + 1, n) for n in (5, 700, 24, 9000, 1)])
    model, most = lm.Attention(), []
    loss, grad = model.gradient(x, y, bias)
    gradient = lm.Attention.gradient
    monkeypatch.setattr(lm.Attention, "gradient", lambda self, x, *more: most.append(len(x)) or gradient(self, x, *more))
    trainer = lm.Trainer(model, bias, 0.002)
    trainer.step(x, y)
    assert sum(most) == len(x) > lm.PIECE >= max(most)
    assert np.isclose(trainer.losses[0], loss, rtol=1e-5)
    for k, g in grad.items():
        assert np.allclose(trainer.m[k] / 0.1, g, rtol=1e-3, atol=1e-6), k


def test_attention_of_large_weights_stays_finite():
    rng = np.random.default_rng(2)
    x, y, _ = lm.windows([rng.integers(0, lm.REST + 1, 300)])
    model = lm.Attention()
    for k in ("Q", "K"):
        model.w[k] *= 100
    loss, grad = model.gradient(x, y, lm.Bias(np.ones((lm.REST + 1, lm.REST + 1), np.float32)))
    assert np.isfinite(loss) and all(np.isfinite(g).all() for g in grad.values())
