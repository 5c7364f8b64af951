"""Cutting lineage in loops: a written table in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_path(spark: SparkSession) -> str:
    """A new place in spark.checkpoint.dir; a folder is made only where none is set and driver and executors are one
    process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/graphloom/loop-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once and read back."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Levels:
    """A table that grows by whole levels: each is written once, in a folder of its own, and all are read as one table."""

    def __init__(self, first: DataFrame) -> None:
        self.spark, self.schema, self.paths = first.sparkSession, first.schema, []
        self.last = self.add(first)

    def add(self, df: DataFrame) -> DataFrame:
        self.paths.append(new_path(self.spark))
        df.write.parquet(self.paths[-1])
        self.last = self.spark.read.schema(self.schema).parquet(self.paths[-1])
        return self.last

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths)
