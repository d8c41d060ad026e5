"""Python functions over rows, in Arrow batches without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame


#: Rows that are Python objects at once.
BLOCK = 256


def per_row(df: DataFrame, inputs: list[Column], make: Callable, name: str, kind: str, block: int = BLOCK) -> DataFrame:
    """``df`` and one more column that ``make`` computes from ``inputs`` row by row; batches stay in Arrow, and ``block`` rows at a
    time become Python objects and go on, so what a worker holds does not grow with the rows of a batch."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    out = StructType([*df.schema.fields, StructField(name, _parse_datatype_string(kind))])
    typed = to_arrow_schema(out)
    width, extra = len(df.columns), [f"_in{i}" for i in range(len(inputs))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(at, block) for batch in batches for at in range(0, batch.num_rows, block)):
            columns = [part.column(width + i).to_pylist() for i in range(len(extra))]
            made = pa.array([make(*row) for row in zip(*columns)], type=typed.field(width).type)
            yield pa.RecordBatch.from_arrays([*(part.column(i).cast(typed.field(i).type) for i in range(width)), made], schema=typed)

    return df.select(*df.columns, *(c.alias(a) for c, a in zip(inputs, extra))).mapInArrow(run, out)
