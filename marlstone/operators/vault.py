"""Vault pages ranked by what a query's words name in them, and where they are cited from."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import normalize_path
from marlstone.operators import blocks

# What a match counts by its place, and what a kind counts on its own.
TITLE, EXTRA, BODY = 3.0, 1.5, 0.5
KIND_PRIOR = {"wiki": 0.2, "memory": 0.15, "gloss": 0.1, "other": 0.05}
INACTIVE = ("superseded", "forgotten")


def _words(*texts: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", *texts)), F.lit("([a-z0-9_]+)")))


def prior_of(kind: Column) -> Column:
    prior = F.lit(KIND_PRIOR["other"])
    for k, v in KIND_PRIOR.items():
        prior = F.when(kind == k, v).otherwise(prior)
    return prior


def kind_of(path: Column) -> Column:
    p = F.concat(F.lit("/"), normalize_path(path))
    return F.when(F.contains(p, F.lit("/knowledge/wiki/")), "wiki").when(F.contains(p, F.lit("/knowledge/memory/")), "memory").when(F.contains(p, F.lit("/knowledge/gloss/")), "gloss").otherwise("other")


def rank_pages(pages: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, path, score, rank``: a query's best ``k`` pages, ties by path. ``pages``: ``path, title, description, tags, body``. A page scores its shared
    words by place over the query's words, and a tenth of its kind's prior; pages that share none follow by their prior only if fewer than ``k`` do, so they
    are left out here. Pages are scored where they are read, by their whole text."""
    named, told, body = _words(F.col("title"), F.col("path")), _words(F.col("description"), F.array_join("tags", " ")), _words(F.col("body"))
    rows = pages.select(F.col("path").alias("chunk_id"), named.alias("a"), told.alias("b"), body.alias("c"), (0.1 * prior_of(kind_of(F.col("path")))).alias("own"))
    rows = rows.select("chunk_id", F.concat("a", "b", "c").alias("terms"), F.size("a").alias("n_a"), F.size("b").alias("n_b"), "own")

    def weigh(batch: pa.RecordBatch, row: np.ndarray, place: np.ndarray, idf: np.ndarray) -> np.ndarray:
        lengths, a, b = (x.to_numpy(zero_copy_only=False) for x in (pc.list_value_length(batch.column("terms")), batch.column("n_a"), batch.column("n_b")))
        at = place - (np.cumsum(lengths) - lengths)[row]
        return np.where(at < a[row], TITLE, np.where(at < (a + b)[row], EXTRA, BODY))

    words = queries.select("query_id", F.explode(_words(F.col("query"))).alias("term"), F.lit(1).alias("qtf"))
    return blocks.best_rows(rows, blocks.query_words(words), k, blocks.by_weight, weigh).withColumnRenamed("chunk_id", "path")


def is_inactive(kind: Column, status: Column) -> Column:
    return (kind == "memory") & F.coalesce(F.lower(status).isin(*INACTIVE), F.lit(False))
