"""Written intermediates in the folder the cluster shares.

A two-pass operator must see the same rows in both passes. Range bounds are
sampled anew for each execution and a lost executor makes Spark recompute, so
such operators write their placed rows once and read them back. The folder is
``spark.checkpoint.dir``; only a session of one process (``local``, ``local[n]``)
without it gets a temp folder. :func:`release` removes what one job has left.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallyforge-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path, never used before; what is written there stays until the folder's owner expires it."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def release(spark: SparkSession, path: str) -> None:
    """Remove one path below the scratch folder, once nothing reads it any more."""
    root = scratch_root(spark)
    if not path.startswith(f"{root}/") or ".." in path:
        raise ValueError(f"{path} is not below {root}")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialize_at(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` once to a fresh :func:`scratch_path`, which the caller may release, and read it back."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, label: str = "rows") -> DataFrame:
    """Write ``df`` once as Parquet and read it back, cutting the lineage.

    Parquet rather than ``checkpoint()``: a later pass over a few columns then
    reads only those columns.
    """
    return materialize_at(df, scratch_path(df.sparkSession, label))
