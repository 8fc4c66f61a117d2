"""Tables that the engine writes for itself, in the folder that all machines share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """Below ``spark.checkpoint.dir``; in local mode a folder is made where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/marlstone"


def scratch(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` once and read it back."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a written table that are broadcast at most, a few MB of ids and scores.
SMALL_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """``df``, broadcast in joins if it has ``SMALL_ROWS`` rows at most, so that the texts it is joined with stay where they are."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def version(spark: SparkSession, path: str) -> str:
    """A name for what a table's files hold now: their count, length and latest change. A changed table gets another name."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    seen = fs.getContentSummary(p)
    changed = max([fs.getFileStatus(p).getModificationTime(), *([s.getModificationTime() for s in fs.listStatus(p)] if fs.getFileStatus(p).isDirectory() else [])])
    return hashlib.sha256(f"{path}|{seen.getFileCount()}|{seen.getLength()}|{changed}".encode()).hexdigest()[:16]
