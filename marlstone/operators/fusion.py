"""Fusion and reranking: reciprocal-rank fusion, graph boost, min-max blends, gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.lexical import top_k

K = 60
WEIGHTS = {"dense": 0.3, "sparse": 0.25, "graph": 0.2, "wiki": 0.0, "memory": 0.0, "symbol": 0.5, "doc": 0.25}


def ranked(hits: DataFrame) -> DataFrame:
    """``rank`` from 0 within query and source, by score, then chunk."""
    order = Window.partitionBy("query_id", "source").orderBy(F.col("score").desc(), F.col("chunk_id"))
    return hits.withColumn("rank", F.row_number().over(order) - 1)


def rrf(hits: DataFrame, weights: dict[str, float] | None = None, k: int = K) -> DataFrame:
    """``hits``: ``query_id, source, chunk_id, rank``. Returns ``query_id, chunk_id, score, sources``; a source of weight 0 drops out."""
    table = {s: w for s, w in (WEIGHTS if weights is None else weights).items() if w}
    weight = reduce(lambda acc, sw: acc.when(F.col("source") == sw[0], sw[1]), table.items(), F.when(F.lit(False), 0.0))
    part = hits.withColumn("_w", weight / (k + F.col("rank") + 1)).where("_w is not null")
    return part.groupBy("query_id", "chunk_id").agg(F.sum("_w").alias("score"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def graph_boost(fused: DataFrame, graph_hits: DataFrame, weight: float = WEIGHTS["graph"]) -> DataFrame:
    """Fused rows that the graph found too gain ``weight * max(best fused score, .1)``; graph-only rows join at their score times the best, or half
    their score where nothing fused."""
    best = Window.partitionBy("query_id")
    g = graph_hits.select("query_id", "chunk_id", F.col("score").alias("_g"))
    both = fused.join(g, ["query_id", "chunk_id"], "full_outer").withColumn("_max", F.coalesce(F.max("score").over(best), F.lit(0.0)))
    boosted = F.col("score") + F.when(F.col("_g").isNotNull(), weight * F.greatest("_max", F.lit(0.1))).otherwise(0.0)
    return both.select("query_id", "chunk_id", F.coalesce(boosted, F.col("_g") * F.when(F.col("_max") > 0, F.col("_max")).otherwise(0.5)).alias("score"))


def final_cut(hits: DataFrame, k: int) -> DataFrame:
    return top_k(hits.withColumn("score", F.round("score", 6)), k)


def minmax(hits: DataFrame, col: str, out: str) -> DataFrame:
    """Scaled to 0..1 within the query; a constant list becomes .5."""
    w = Window.partitionBy("query_id")
    lo, hi = F.min(col).over(w), F.max(col).over(w)
    return hits.withColumn(out, F.when(hi - lo < 1e-12, 0.5).otherwise((F.col(col) - lo) / (hi - lo)))


def blend_rerank(hits: DataFrame, alpha: float = 0.5, model: str = "model_score", base: str = "score") -> DataFrame:
    """``alpha`` parts of the scaled model score and the rest of the scaled fused score, as ``reranked``."""
    both = minmax(minmax(hits, model, "_m"), base, "_b")
    return both.withColumn("reranked", alpha * F.col("_m") + (1 - alpha) * F.col("_b")).drop("_m", "_b")


def gate_rerank(hits: DataFrame, margin: float, model: str = "model_score", base: str = "score") -> DataFrame:
    """The model's order where its best score leads its second by ``margin``, else the fused order, as ``reranked``."""
    order = Window.partitionBy("query_id").orderBy(F.col(model).desc(), "chunk_id")
    all_rows = Window.partitionBy("query_id")
    seen = hits.withColumn("_n", F.row_number().over(order))
    first, second = (F.max(F.when(F.col("_n") == n, F.col(model))).over(all_rows) for n in (1, 2))
    seen = seen.withColumn("_lead", F.coalesce(first - second, F.lit(float("inf"))))
    return seen.withColumn("reranked", F.when(F.col("_lead") >= margin, F.col(model)).otherwise(F.col(base))).drop("_n", "_lead")


def per_file_cap(hits: DataFrame, cap: int = 3, rank: str = "rank") -> DataFrame:
    """The first ``cap`` rows of each file in rank order; 0 keeps all."""
    if cap <= 0:
        return hits
    order = Window.partitionBy("query_id", "file_path").orderBy(rank)
    return hits.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cap).drop("_n")


def promote(hits: DataFrame, names: DataFrame, rank: str = "rank") -> DataFrame:
    """Rows whose entity is named in the query come first, otherwise in their order. ``names``: ``query_id, name``."""
    wanted = names.select("query_id", F.col("name").alias("entity_name"), F.lit(True).alias("_hit")).distinct()
    order = Window.partitionBy("query_id").orderBy(F.coalesce("_hit", F.lit(False)).desc(), F.col(rank))
    marked = hits.join(wanted, ["query_id", "entity_name"], "left")
    return marked.withColumn(rank, F.row_number().over(order) - 1).drop("_hit")
