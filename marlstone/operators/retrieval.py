"""Retrieval: channels searched for many queries at once, fused, boosted by the graph, reranked and cut."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import logistic, overlap_share, tokenize
from marlstone.operators import blocks, fusion, graph, index, lexical
from marlstone.operators.vectors import dense_search
from marlstone.scratch import materialize, small

# How deep each channel is searched for a final cut of k, scores of the graph channel, and bonuses.
DENSE_DEPTH, SPARSE_DEPTH, SIDE_DEPTH = 2, 3, 2
GRAPH_BASE, GRAPH_SLOPE, GRAPH_CAP = 0.3, 0.5, 0.8
GLOSS_BONUS, GLOSS_GRAPH_BONUS, GLOSS_GRAPH_CAP = 0.12, 0.15, 0.95
DOC_BASE, DOC_SLOPE, DOC_CAP = 0.3, 0.65, 0.95
MEMORY_OVERLAP, MEMORY_BM25 = 0.65, 0.35
ALLOW_LEAST, ALLOW_MOST = 20, 200


def last_chunks(chunks: DataFrame) -> DataFrame:
    """One chunk for each entity, the last by ``ordinal`` (by id where there is none)."""
    order = "ordinal" if "ordinal" in chunks.columns else "chunk_id"
    return chunks.groupBy("entity_id").agg(F.max_by("chunk_id", order).alias("chunk_id"))


def seed_scores(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """``query_id, entity_id, score``: the best score of an entity among the hits."""
    return small(hits).join(chunks.select("chunk_id", "entity_id"), "chunk_id").groupBy("query_id", "entity_id").agg(F.max("score").alias("score"))


def graph_channel(queries: DataFrame, hits: DataFrame, chunks: DataFrame, edges: DataFrame, nodes: DataFrame | None = None, k: int = 30, width: int = 6, depth: int = 2, most: int = 6) -> DataFrame:
    """Neighbours of the hits' entities over a beam, each by its last chunk: ``query_id, chunk_id, score, rank``, scored by the share of
    the query's tokens that the chunk holds."""
    reached = graph.expand_beam(edges, materialize(seed_scores(hits, chunks), "seeds"), width, depth, most, nodes).select("query_id", "entity_id").distinct()
    own = chunks.join(small(reached.select("entity_id").distinct()), "entity_id", "left_semi")
    last = materialize(small(reached).join(last_chunks(own), "entity_id").select("query_id", "chunk_id"), "last")
    found = small(last).join(chunks.drop("entity_id"), "chunk_id").join(queries.select("query_id", "query"), "query_id")
    score = F.least(F.lit(GRAPH_CAP), GRAPH_BASE + GRAPH_SLOPE * overlap_share(tokenize("content"), tokenize("query")))
    if "kind" in chunks.columns:
        score = F.when(F.col("kind") == "gloss", F.least(F.lit(GLOSS_GRAPH_CAP), score + GLOSS_GRAPH_BONUS)).otherwise(score)
    return lexical.top_k(found.select("query_id", "chunk_id", F.round(score, 6).alias("score")), k)


def doc_channel(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    return lexical.overlap_channel(docs, queries, DOC_BASE, DOC_SLOPE, DOC_CAP, k)


def memory_search(memories: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``query_id, id, score, rank``: active memories by shared words and BM25 over title, body and links. ``memories`` carry their ``status``."""
    links = F.concat_ws(" ", "links") if "links" in memories.columns else F.lit("")
    rows = memories.where("status = 'active'").select(F.col("id").alias("chunk_id"), F.concat_ws(" ", "title", "body", links).alias("content"))
    stored = index.built(rows)
    words = blocks.query_words(lexical.query_terms(queries), stored.terms)
    return blocks.best_rows(stored.chunks, words, k, blocks.by_overlap_and_bm25(MEMORY_OVERLAP, MEMORY_BM25), index.weigher(stored)).withColumnRenamed("chunk_id", "id")


def memory_channel(memories: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    found = memory_search(memories, queries, k)
    return found.select("query_id", F.col("id").alias("chunk_id"), F.round(logistic(F.col("score")), 6).alias("score"), "rank")


def allowed_ids(sparse: DataFrame) -> DataFrame:
    """``query_id, chunk_id``: each query's first ``ALLOW_MOST`` sparse hits, for queries that have ``ALLOW_LEAST`` at least."""
    rows = sparse.where(F.col("rank") < ALLOW_MOST)
    many = rows.groupBy("query_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= ALLOW_LEAST).select("query_id")
    return rows.join(many, "query_id", "left_semi").select("query_id", "chunk_id")


def fuse(channels: dict[str, DataFrame], weights: dict[str, float], gloss: DataFrame | None = None) -> DataFrame:
    """Weighted reciprocal-rank fusion of named channels (``query_id, chunk_id, rank``); ``gloss`` (``chunk_id``) marks chunks with a bonus."""
    named = [c.select("query_id", F.lit(name).alias("source"), "chunk_id", F.col("rank").cast("int").alias("rank")) for name, c in channels.items() if weights.get(name)]
    fused = fusion.rrf(reduce(DataFrame.unionByName, named), weights)
    if gloss is None:
        return fused
    marked = fused.join(gloss.select("chunk_id", F.lit(GLOSS_BONUS).alias("_g")).distinct(), "chunk_id", "left")
    return marked.withColumn("score", F.col("score") + F.coalesce("_g", F.lit(0.0))).drop("_g")


def rerank_head(fused: DataFrame, model: DataFrame, rerank_k: int, mode: str = "replace", alpha: float = 0.5, margin: float = 0.0) -> DataFrame:
    """The first ``2 * rerank_k`` fused rows scored anew by ``model`` (``query_id, chunk_id, model_score``); the rest keeps its score.
    ``mode``: off, replace, blend (min-max scaled, ``alpha`` for the model) or gate (replace where the model's lead is ``margin``)."""
    if mode in ("off", "disabled", "none"):
        return fused
    ranked = lexical.top_k(fused, 2**31 - 1)
    head = ranked.where(F.col("rank") < 2 * rerank_k).join(model, ["query_id", "chunk_id"])
    if mode == "blend":
        head = fusion.blend_rerank(head, alpha)
    elif mode == "gate":
        head = fusion.gate_rerank(head, margin)
    else:
        head = head.withColumn("reranked", F.col("model_score"))
    tail = ranked.where(F.col("rank") >= 2 * rerank_k).select("query_id", "chunk_id", "score")
    return head.select("query_id", "chunk_id", F.col("reranked").alias("score")).unionByName(tail)


def retrieve(
    queries: DataFrame,
    postings: index.Index,
    k: int = 30,
    mode: str = "hybrid",
    vectors: DataFrame | None = None,
    query_vectors: DataFrame | None = None,
    chunks: DataFrame | None = None,
    edges: DataFrame | None = None,
    nodes: DataFrame | None = None,
    sides: dict[str, DataFrame] | None = None,
    weights: dict[str, float] | None = None,
    model: DataFrame | None = None,
    rerank_k: int = 15,
    rerank: str = "replace",
) -> DataFrame:
    """``query_id, chunk_id, score, rank``: the best ``k`` of each query.

    ``mode`` bm25 is the lexical search alone. Otherwise dense hits (2k) and sparse hits (3k) are fused with the ``sides`` channels, boosted by
    the graph channel over ``edges``, reranked by ``model`` and cut. A channel whose input is missing is left out.
    """
    weights = fusion.WEIGHTS | (weights or {})
    sparse = index.search(postings, queries, SPARSE_DEPTH * k)
    if mode == "bm25":
        return sparse.where(F.col("rank") < k)
    channels = {"sparse": sparse}
    if vectors is not None and query_vectors is not None:
        channels["dense"] = materialize(dense_search(vectors, query_vectors, DENSE_DEPTH * k), "hits")
    fused = fuse(channels | (sides or {}), weights)
    if edges is not None and chunks is not None:
        hits = reduce(DataFrame.unionByName, [c.select("query_id", "chunk_id", "score") for c in channels.values()])
        fused = fusion.graph_boost(fused.select("query_id", "chunk_id", "score"), materialize(graph_channel(queries, hits, chunks, edges, nodes, k), "hits"), weights["graph"])
    if model is not None:
        fused = rerank_head(fused.select("query_id", "chunk_id", "score"), model, rerank_k, rerank)
    return fusion.final_cut(fused.select("query_id", "chunk_id", "score"), k)


def prefer_wiki(hits: DataFrame, is_wiki: Column) -> DataFrame:
    """Wiki pages first, otherwise in their order; ``rank`` is numbered anew."""
    order = Window.partitionBy("query_id").orderBy(is_wiki.cast("int").desc(), "rank")
    return hits.withColumn("_n", F.row_number().over(order) - 1).withColumn("rank", F.col("_n")).drop("_n")
