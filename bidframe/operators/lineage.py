"""Cutting the lineage of small results that many later plans read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def _folder(df: DataFrame) -> str:
    """The checkpoint folder of this application. It is in the cluster's ``spark.checkpoint.dir``; where that is unset, one is made if all runs on this machine."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read from there, so that later plans don't carry how it came about."""
    _folder(df)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as parquet in the checkpoint folder, in one evaluation, and read from there. For tables of any size; column names stay."""
    path = f"{_folder(df).rstrip('/')}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
