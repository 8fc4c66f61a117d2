"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every word rule here: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\x0c\r"
#: Several columns carry whole texts, so Arrow batches are kept small.
BATCH_ROWS = 2000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; in local mode one is made where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/marlstone-llm"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` once as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def discard(table: DataFrame) -> None:
    """Delete a table of ``materialize`` that nothing reads any more."""
    if path := getattr(table, "_scratch", None):
        at = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Delete every table that ``materialize`` and the archive writers left. Results read from them end with it."""
    root = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def small_batches(df: DataFrame) -> None:
    """Bound the rows of an Arrow batch, unless the session already has a smaller bound."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000") or 10000)
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def slot_map(slots: DataFrame, bits: int) -> np.ndarray:
    """A bit for each value of the long column ``s`` in ``[0, 2 ** bits)``, as ``2 ** (bits - 6)`` words.

    The words are packed into blocks of 32 KB by the executors, so the driver gets ``2 ** (bits - 3)`` bytes at most, whatever the input.
    """
    block = 12
    words = slots.groupBy(F.shiftright("s", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(s & 63 AS INT))) AS b"))

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(1 << block, dtype=np.int64)
        held[rows["w"].to_numpy(dtype=np.int64) & ((1 << block) - 1)] = rows["b"].to_numpy(dtype=np.int64)
        return pd.DataFrame({"k": [key[0]], "data": [held.tobytes()]})

    packed = words.withColumn("k", F.shiftright("w", block)).groupBy("k").applyInPandas(pack, "k long, data binary").collect()
    out = np.zeros(1 << max(bits - 6, block), dtype=np.int64)
    for r in packed:
        out[r["k"] << block : (r["k"] + 1) << block] = np.frombuffer(r["data"], dtype=np.int64)
    return out.view(np.uint64)
