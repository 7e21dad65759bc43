"""What the text operators share: scratch tables, null-safe text and the learning folds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_own: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Where it is unset, a folder of our own:
    in the warehouse, which a cluster shares, or a temporary one if all of Spark is this one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        sc = spark.sparkContext
        if sc.applicationId not in _own:
            alone = sc.master == "local" or sc.master.startswith("local[")
            _own[sc.applicationId] = tempfile.mkdtemp(prefix="tidemark-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir')}/tidemark-scratch"
        root = _own[sc.applicationId]
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends there and survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(name), F.lit(""))


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo a number of parts; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(parts))


def bounded_sample(df: DataFrame, key: str, most: int, seed: int = 7) -> DataFrame:
    """At most `most` rows, the same ones for any partitioning: those whose seeded key hash is least."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), F.col(key)).limit(most)
