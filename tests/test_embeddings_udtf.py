from __future__ import annotations

import books
import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from corpusloom.functions import tables
from corpusloom.operators import curate
from corpusloom.sources import embeddings as em


class Service:
    """Refuses more than ``most`` letters, fails every third time, answers out of order."""

    def __init__(self, most, failing=3):
        self.most, self.failing, self.calls, self.sizes = most, failing, 0, []

    def __call__(self, texts):
        self.calls += 1
        if self.failing and self.calls % self.failing == 0:
            raise em.Transient("busy")
        if sum(map(len, texts)) > self.most:
            raise em.TooLarge
        self.sizes.append(len(texts))
        return [(i, [float(len(t)), 1.0]) for i, t in reversed(list(enumerate(texts)))]


def test_halves_and_tries_again_in_order():
    service, pauses = Service(50), []
    texts = ["x" * (n % 20) for n in range(64)]
    assert [v[0] for v in em.request_vectors(texts, service, pause=pauses.append)] == [len(t) for t in texts]
    assert sum(service.sizes) == 64 and max(service.sizes) < 64 and set(pauses) == {1.0}
    assert em.request_vectors([], service) == []


def test_calls_are_counted_and_bounded():
    service = Service(10**9, failing=0)
    em.request_vectors(["a"] * 9, service)
    assert service.calls == 1
    pauses = []
    for texts, tries in ((["a", "b"], 4), (["a"], 6)):
        down = Service(0, failing=1)
        with pytest.raises(RuntimeError, match=f"after {tries} tries"):
            em.request_vectors(texts, down, pause=pauses.append)
        assert down.calls == tries
    assert pauses == [1, 2, 4, 1, 2, 4, 8, 16]
    one = Service(3, failing=0)  # one text that will never pass
    with pytest.raises(RuntimeError):
        em.request_vectors(["four"], one, pause=lambda s: None)
    with pytest.raises(ValueError, match="1 vectors came for 2"):
        em.request_vectors(["a", "b"], lambda t: [(0, [1.0])])


def test_rows_get_their_vectors(spark):
    df = spark.createDataFrame([(n, "x" * (n % 9) if n % 10 else None) for n in range(200)], "id long, text string").repartition(3)
    calls = [0]

    def transport(texts):  # as Service, but of this function, so that workers get it by value
        calls[0] += 1
        if calls[0] % 3 == 0:
            raise em.Transient("busy")
        if sum(map(len, texts)) > 40:
            raise em.TooLarge
        return [(i, [float(len(t)), 1.0]) for i, t in reversed(list(enumerate(texts)))]

    made = em.with_remote_embedding(df, "text", transport, max_items=16, pause=lambda s: None)
    assert made.columns == ["id", "text", "embedding"]
    for r in made.collect():
        v = np.array([len(r.text or ""), 1.0])
        assert np.allclose(r.embedding, v / np.linalg.norm(v), atol=1e-6)
    assert em.with_remote_embedding(df.where("false"), "text", transport).collect() == []


def test_chunks_in_sql(spark):
    rows = [(1, books.recipe_text(1), "receita"), (2, " ".join(["Uma frase de prosa comum."] * 400), "tecnica"), (3, None, "tecnica"), (4, "", "receita")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tier string")
    tables.register(spark)
    docs.createOrReplaceTempView("docs_for_chunks")
    found = spark.sql("SELECT d.doc_id, c.* FROM docs_for_chunks d, LATERAL chunks(d.text, d.tier) c")
    same = curate.chunk_documents(docs.where("doc_id < 3"), "text", "tier").select("doc_id", F.posexplode("pieces").alias("position", "p")).select("doc_id", "position", "p.*")
    assert found.columns == same.columns
    key = lambda r: (r.doc_id, r.position)
    assert sorted(found.collect(), key=key) == sorted(same.collect(), key=key) and found.count() > 2
    with pytest.raises(AnalysisException, match="must be a string"):
        spark.sql("SELECT * FROM chunks(1, 'receita')").collect()
