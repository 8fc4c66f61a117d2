"""Lexical search: postings, Okapi BM25 and the overlap and symbol channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import logistic, overlap_share, tokenize, tokenize_identifiers

K1, B, EPSILON = 1.5, 0.75, 0.25


def postings(chunks: DataFrame, ident_split: bool = False) -> DataFrame:
    """``chunks``: ``chunk_id, content``. Returns ``chunk_id, term, tf``; counts meet map-side first, so stop words don't skew it."""
    tokens = tokenize_identifiers("content") if ident_split else tokenize("content")
    return chunks.select("chunk_id", F.explode(tokens).alias("term")).groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))


def document_stats(chunks: DataFrame, ident_split: bool = False) -> DataFrame:
    """``chunk_id, dl``: tokens of each chunk, 0 included."""
    tokens = tokenize_identifiers("content") if ident_split else tokenize("content")
    return chunks.select("chunk_id", F.size(tokens).cast("long").alias("dl"))


def document_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("df"))


def idf_table(post: DataFrame, stats: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """``term, df, idf``: a negative idf is replaced by ``epsilon`` times the mean idf of the whole vocabulary."""
    return with_idf(document_frequency(post), stats.agg(F.count("*").alias("n")), epsilon)


def with_idf(frequency: DataFrame, n: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """``term, df, idf`` for ``term, df`` and the one row of ``n``, the number of chunks."""
    raw = frequency.join(F.broadcast(n)).withColumn("idf", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    mean = raw.agg(F.avg("idf").alias("mean"))
    return raw.join(F.broadcast(mean)).select("term", "df", F.when(F.col("idf") < 0, epsilon * F.col("mean")).otherwise(F.col("idf")).alias("idf"))


def query_terms(queries: DataFrame, ident_split: bool = False) -> DataFrame:
    """``query_id, term, qtf``: how often each token stands in the query."""
    tokens = tokenize_identifiers("query") if ident_split else tokenize("query")
    return queries.select("query_id", F.explode(tokens).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def bm25_raw(post: DataFrame, stats: DataFrame, idf: DataFrame, terms: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """``query_id, chunk_id, raw``. Only postings of query terms take part, so a query costs what its terms' lists hold."""
    average = stats.agg(F.avg("dl").alias("avgdl"))
    wanted = terms.join(idf, "term")
    hits = post.join(wanted, "term").join(stats, "chunk_id").join(F.broadcast(average))
    length = 1 - b + b * F.col("dl") / F.col("avgdl")
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * length)
    return hits.groupBy("query_id", "chunk_id").agg(F.sum(part).alias("raw"))


def top_k(hits: DataFrame, k: int, score: str = "score", key: str = "chunk_id", by: str = "query_id") -> DataFrame:
    """The best ``k`` rows of each query with their ``rank`` from 0; ties go by key."""
    order = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(key))
    return hits.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)


def bm25_search(chunks: DataFrame, queries: DataFrame, k: int = 30, ident_split: bool = False) -> DataFrame:
    """``query_id, chunk_id, score, rank``: squashed BM25 of the chunks above zero, rounded so that ties don't hang on float noise."""
    post, stats = postings(chunks, ident_split), document_stats(chunks, ident_split)
    raw = bm25_raw(post, stats, idf_table(post, stats), query_terms(queries, ident_split)).where("raw > 0")
    return top_k(raw.select("query_id", "chunk_id", F.round(logistic(F.col("raw")), 6).alias("score")), k)


def overlap_channel(chunks: DataFrame, queries: DataFrame, base: float = 0.25, slope: float = 0.65, cap: float = 0.9, k: int = 60) -> DataFrame:
    """``min(cap, base + slope * overlap)`` for chunks that share a token with the query, the best ``k``."""
    from marlstone.operators import blocks

    own = chunks.select("chunk_id", F.array_distinct(tokenize("content")).alias("terms"))
    return blocks.best_rows(own, blocks.query_words(query_terms(queries)), k, blocks.by_overlap(base, slope, cap))


def symbol_channel(chunks: DataFrame, names: DataFrame, score: float = 0.9) -> DataFrame:
    """Chunks whose ``entity_name`` equals a wanted ``name`` (case ignored) at a constant score. ``names``: ``query_id, name``."""
    wanted = names.select("query_id", F.lower("name").alias("_n")).distinct()
    return chunks.join(wanted, F.lower(F.col("entity_name")) == F.col("_n")).select("query_id", "chunk_id", F.lit(score).alias("score"))


def lexical_boost(hits: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``boosted``: the score, .05 for each distinct query word found, .2 if one is in the name, and a bonus by entity type."""
    words = F.filter(F.array_distinct(F.split(F.lower("query"), r"[ \t\n\r]+")), lambda w: w != "")
    text, name = F.lower(content), F.lower("entity_name")
    found = F.size(F.filter(words, lambda w: F.contains(text, w)))
    named = F.exists(words, lambda w: F.contains(name, w))
    kind = F.when(F.col("entity_type").isin("function", "method"), 0.15).when(F.col("entity_type") == "class", 0.1).when(F.col("entity_type") == "file", -0.1).otherwise(0.0)
    documented = F.when(F.length(F.coalesce("docstring", F.lit(""))) > 0, 0.05).otherwise(0.0)
    total = F.col("score") + 0.05 * found + F.when(named, 0.2).otherwise(0.0) + kind + documented
    return hits.withColumn("boosted", F.greatest(total, F.lit(0.0)))


def overlap_score(content: Column, query: Column) -> Column:
    return overlap_share(tokenize(content), tokenize(query))
