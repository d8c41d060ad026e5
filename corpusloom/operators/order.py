"""Places of rows in an order, at any size: range partitions, counts of earlier partitions, places inside."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the folder of ``spark.checkpoint.dir`` and read from there, so that its plan ends here and lost executors cost
    a re-read. Where that is unset, a temporary folder serves if all tasks run on this machine."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="corpusloom-"))
    path = f"{sc.getCheckpointDir().rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(at)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, group: str, order: list[str], name: str = "_at") -> DataFrame:
    """``rows`` with their place in their group from 0. No group meets in one task: a task holds a range of rows, and ranges are counted.
    Rows equal in ``order`` are told apart by where they stood, so equal rows of any number spread too."""
    tied = cut(rows.withColumn("_tie", F.monotonically_increasing_id()))
    spread = cut(tied.repartitionByRange(group, *order, "_tie").withColumn("_part", F.spark_partition_id()))
    counts = spread.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(group).alias("_og"), F.col("_part").alias("_op"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part", group).orderBy(*order, "_tie"))
    joined = spread.withColumn("_row", inside).join(offsets, F.col(group).eqNullSafe(F.col("_og")) & (F.col("_part") == F.col("_op")))
    return joined.withColumn(name, F.col("_before") + F.col("_row") - 1).drop("_og", "_op", "_part", "_tie", "_row", "_before")
