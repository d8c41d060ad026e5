"""Settings from the environment, and a session with settings for large inputs."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Config:
    """Each field is read from CORPUSLOOM_<NAME> if that is set."""

    index_dir: str = "data/index"
    inbox_dir: str = "data/inbox"
    checkpoint_dir: str = "data/checkpoints"
    embedding_column: str = "embedding"
    files_per_batch: int = 100
    top_k: int = 8

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Config:
        env = os.environ if env is None else env
        found = {f.name: env[key] for f in fields(cls) if (key := f"CORPUSLOOM_{f.name.upper()}") in env}
        return cls(**{k: int(v) if cls.__dataclass_fields__[k].type in ("int", int) else v for k, v in found.items()})


#: Partitions that fit executors at any input size are left to adaptive execution; what is set here is what it starts from.
LARGE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(name: str = "corpusloom", **settings: str) -> SparkSession:
    return SparkSession.builder.appName(name).config(map={**LARGE, **settings}).getOrCreate()
