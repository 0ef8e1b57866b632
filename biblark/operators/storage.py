"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which the cluster or the caller sets. Where it is unset, a temporary folder is made and set on one
    machine; on a cluster there is none that all executors see, so that is an error."""
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (own.get() if own.isDefined() else None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='biblark-')}"
    if not own.isDefined():
        spark.sparkContext.setCheckpointDir(folder)
        folder = folder if spark.conf.get("spark.checkpoint.dir", None) else spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: what follows reads it as often as it likes."""
    path = f"{shared_folder(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()
