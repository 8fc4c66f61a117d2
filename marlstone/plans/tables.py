"""Reading the catalogue's tables and their roles: documents as chunks, benchmark items as queries, and so on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.index import Index, open_index, write_index
from marlstone.scratch import scratch_root, version


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.col("source").alias("file_path"), F.col("lang").alias("entity_type"))


def stored_postings(spark: SparkSession, sf_dir: str) -> Index:
    """The stored lexical index of the documents: written once for what the table's files hold, then read by every query."""
    path = f"{scratch_root(spark)}/index-{version(spark, f'{sf_dir}/documents.parquet')}"
    found = open_index(spark, path)
    if found is None:
        write_index(chunks(spark, sf_dir), path)
        found = open_index(spark, path)
    return found


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set of a vector search: every row whose id is divisible by 20, against all rows."""
    return vectors(spark, sf_dir).where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "embedding", "label")


#: Foreign keys as a typed graph: table, source prefix and column, relationship, target prefix and column.
FOREIGN_KEYS = (
    ("nation", "nation", "n_nationkey", "contains", "region", "n_regionkey"),
    ("customer", "customer", "c_custkey", "references", "nation", "c_nationkey"),
    ("supplier", "supplier", "s_suppkey", "references", "nation", "s_nationkey"),
    ("orders", "order", "o_orderkey", "calls", "customer", "o_custkey"),
    ("lineitem", "order", "l_orderkey", "imports", "part", "l_partkey"),
    ("lineitem", "order", "l_orderkey", "depends_on", "supplier", "l_suppkey"),
)


def edges(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = ("nation", "customer", "supplier", "orders", "lineitem")) -> DataFrame:
    """``src, dst, relationship, seq``, each once."""
    return edge_rows(spark, sf_dir, tables).distinct()


def edge_rows(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = ("nation", "customer", "supplier", "orders", "lineitem")) -> DataFrame:
    """``src, dst, relationship, seq``, as often as the tables say so."""
    parts = []
    for i, (name, a, key, relationship, b, other) in enumerate(FOREIGN_KEYS):
        if name in tables:
            t = table(spark, sf_dir, name)
            parts.append(t.select(F.concat(F.lit(f"{a}:"), F.col(key).cast("string")).alias("src"), F.concat(F.lit(f"{b}:"), F.col(other).cast("string")).alias("dst"), F.lit(relationship).alias("relationship"), F.lit(i).alias("seq")))
    return reduce(DataFrame.unionByName, parts)


def edges_sql(tables: tuple[str, ...] = ("nation", "customer", "supplier", "orders", "lineitem")) -> str:
    rows = [f"SELECT DISTINCT '{a}:' || {key} AS src, '{b}:' || {other} AS dst, '{r}' AS relationship, {i} AS seq FROM {name}" for i, (name, a, key, r, b, other) in enumerate(FOREIGN_KEYS) if name in tables]
    return " UNION ALL ".join(rows)
