"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: The folder made for runs on this machine alone, once it is needed.
_own_dir: list[str] = []


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its file system, as a URI: Hadoop's default file system where the path names none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    return re.sub("^file:/+", "file:///", uri).rstrip("/")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``, as a URI. Where it is unset, one is made here if all runs on this machine; a cluster must name its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="spark-shared-"))
        path = _own_dir[0]
    return qualified(spark, path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Hand freed memory back to the system. Python workers live on from stage to stage, and would keep what an earlier one needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # only some C libraries have it
        pass


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function of batches, followed by ``give_back`` at the end of the task."""

    def inner(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return inner


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unit_hash(*cols, seed: int = 0):
    """A number in [0, 1) that depends only on the columns' values: 52 bits of their md5."""
    text = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in cols], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
