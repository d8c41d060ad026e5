"""Vectors from a remote service: requests of bounded size, halved when they are too large, tried again when they fail.

The service is a parameter: ``transport`` takes a list of texts and returns (index, vector) pairs in any order. Requests are made where the rows
are, one Arrow batch at a time; nothing passes the driver and no row is shuffled.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as fx
from ..operators.retrieval import pack_batches

Transport = Callable[[list[str]], Sequence[tuple[int, Sequence[float]]]]


class TooLarge(ValueError):
    """The service refuses a request for its size: the same request will never pass."""


class Transient(RuntimeError):
    """The service could not answer now: the same request may pass later."""


def request_vectors(texts: Sequence[str], transport: Transport, tries: int = 4, tries_of_one: int = 6, longest_pause: float = 20, pause: Callable[[float], None] = time.sleep) -> list[Sequence[float]]:
    """The vectors of ``texts`` in order. What is too large is asked for in halves, down to one text; a failure is tried again after a pause
    that doubles, ``tries`` times (``tries_of_one`` for a single text, which cannot be halved)."""
    out: list[Sequence[float] | None] = [None] * len(texts)
    todo = [(0, len(texts))] if texts else []
    while todo:
        begin, end = todo.pop()
        alone = end - begin == 1
        allowed = max(tries, tries_of_one) if alone else tries
        for attempt in range(allowed):
            try:
                answer = transport(list(texts[begin:end]))
            except TooLarge as e:
                if not alone:
                    middle = (begin + end) // 2
                    todo += [(middle, end), (begin, middle)]
                    break
                last: Exception = e
            except Transient as e:
                last = e
            else:
                if sorted(i for i, _ in answer) != list(range(end - begin)):
                    raise ValueError(f"{len(answer)} vectors came for {end - begin} texts")
                for i, vector in answer:
                    out[begin + i] = vector
                break
            if attempt + 1 < allowed:
                pause(min(2.0**attempt, longest_pause))
        else:
            raise RuntimeError(f"no vectors after {allowed} tries") from last
    return out


def with_remote_embedding(df: DataFrame, text: str, transport: Transport, out: str = "embedding", max_items: int = fx.BATCH_ITEMS, max_tokens: int = fx.BATCH_TOKENS, **retry) -> DataFrame:
    """``df`` with the unit vectors of ``text`` (null counts as empty), one more column. Requests hold ``max_items`` texts and about ``max_tokens`` tokens
    at most. A task that is lost asks again for its rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

    schema = StructType([*df.schema.fields, StructField(out, ArrayType(FloatType()))])
    typed, width = to_arrow_schema(schema), len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(width).to_pylist()]
            numbers, vectors = pack_batches([len(t) for t in texts], max_items, max_tokens), []
            for n in range(numbers[-1] + 1 if numbers else 0):
                vectors += request_vectors([t for t, at in zip(texts, numbers) if at == n], transport, **retry)
            unit = []
            for v in vectors:
                a = np.asarray(v, np.float32)
                unit.append(a / (float(np.linalg.norm(a)) or 1.0))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).cast(typed.field(i).type) for i in range(width)), pa.array(unit, typed.field(width).type)], schema=typed)

    return df.select(*df.columns, F.col(text).alias("_in")).mapInArrow(run, schema)
