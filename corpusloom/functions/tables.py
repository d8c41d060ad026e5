"""Table functions for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

PIECES = StructType([
    StructField("position", IntegerType()), StructField("title", StringType()), StructField("kind", StringType()),
    StructField("text", StringType()), StructField("ingredients", ArrayType(StringType())),
])


@udtf
class Chunks:
    """``SELECT d.doc_id, c.* FROM docs d, LATERAL chunks(d.text, d.tier) c``: the pieces of a cleaned text, in order; none of a null one."""

    @staticmethod
    def analyze(text: AnalyzeArgument, tier: AnalyzeArgument) -> AnalyzeResult:
        for name, given in (("text", text), ("tier", tier)):
            if given.dataType.simpleString() not in ("string", "void"):
                raise ValueError(f"chunks: {name} must be a string, not {given.dataType.simpleString()}")
        return AnalyzeResult(schema=PIECES)

    def eval(self, text: str, tier: str):
        from corpusloom.operators import curate

        for n, piece in enumerate(curate.chunk(text, tier) if text else ()):
            yield n, piece.title, piece.kind, piece.text, list(piece.ingredients)


def register(spark: SparkSession) -> None:
    spark.udtf.register("chunks", Chunks)
