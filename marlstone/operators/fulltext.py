"""Full-text search over session events: all query tokens must match; BM25 order; snippets; optional Porter stems."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.porter import stem
from marlstone.functions.text import snippet, tokenize
from marlstone.operators import blocks, index

K1, B = 1.2, 0.75


def stems(tokens: Column) -> Column:
    @F.pandas_udf("array<string>")
    def udf(rows: pd.Series) -> pd.Series:
        memory: dict[str, str] = {}
        return pd.Series([[memory.setdefault(t, stem(t)) for t in row] if row is not None else None for row in rows])

    return udf(tokens)


def terms_of(text: str | Column, stemmed: bool) -> Column:
    return stems(tokenize(text)) if stemmed else tokenize(text)


def and_match(docs: DataFrame, queries: DataFrame, stemmed: bool = False) -> DataFrame:
    """``query_id, doc_id``: documents (``doc_id, body``) that hold every distinct token of the query. A query without tokens has none."""
    own = docs.select("doc_id", F.explode(F.array_distinct(terms_of("body", stemmed))).alias("term"))
    asked = queries.select("query_id", F.array_distinct(terms_of("query", stemmed)).alias("q"))
    wanted = asked.select("query_id", F.size("q").alias("n"), F.explode("q").alias("term"))
    return own.join(wanted, "term").groupBy("query_id", "doc_id", "n").agg(F.count("*").alias("m")).where("m = n").select("query_id", "doc_id")


def search(docs: DataFrame, queries: DataFrame, k: int = 10, stemmed: bool = False) -> DataFrame:
    """``query_id, doc_id, score, rank`` of the matches of ``and_match``; the idf is ``ln((N - n + .5) / (n + .5))``, 1e-6 at least. Documents are scored in
    blocks of an index of their own, so matches that don't come among the best never leave their task."""
    stored = index.built(docs.select(F.col("doc_id").alias("chunk_id"), F.col("body").alias("content")), terms_of("content", stemmed))
    wanted = queries.select("query_id", F.explode(F.array_distinct(terms_of("query", stemmed))).alias("term"), F.lit(1).alias("qtf"))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    terms = stored.terms.drop("idf").join(F.broadcast(stored.stats.select("n"))).select("term", idf.alias("idf"))
    return blocks.best_rows(stored.chunks, blocks.query_words(wanted, terms), k, blocks.by_all, index.weigher(stored, K1, B)).withColumnRenamed("chunk_id", "doc_id")


def with_snippets(hits: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Adds ``snippet`` around the query's first token."""
    first = queries.select("query_id", F.get(tokenize("query"), F.lit(0)).alias("_t"))
    return hits.join(docs, "doc_id").join(first, "query_id").withColumn("snippet", snippet(F.col("body"), F.col("_t"))).drop("_t", "body")
