"""Tables that a job writes for itself and reads again: in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; a local session that has none gets one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="leafmill-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/leafmill/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written and read again: later plans start from its rows."""
    path = folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
