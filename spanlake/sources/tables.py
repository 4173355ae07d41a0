"""Results that several later steps read are written once to the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share. Only a local session without one (tests) gets a folder of this process; on a cluster its lack is an error.

    Tables that jobs write there are not removed by them: that is left to the folder's owner.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own:
            _own.append(f"file://{tempfile.mkdtemp(prefix='spark-')}")
        found = _own[0]
    return found.rstrip("/")


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """df written to the shared folder and read from there: its lineage ends, and a lost executor costs a read, not a rerun."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
