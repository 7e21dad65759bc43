"""Tables that cut lineage, in the folder that a cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or one in the warehouse where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/tidemark-scratch"
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write a table and read it again: lineage ends there and survives lost executors."""
    path = f"{folder(df.sparkSession)}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
