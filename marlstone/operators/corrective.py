"""The corrective loop: search, grade, and search again with rewritten queries, for all queries of a batch together.

There are at most three rounds. Each one searches the queries that are still open, merges what was found with what came before, grades it, and closes
the queries that are good enough, stalled or out of rounds. What a round leaves is written as a table, so plans stay short.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators import golden, metrics
from marlstone.operators.loop import query_mode
from marlstone.scratch import materialize, small


def names_in_reach(names: Column, pool: Column) -> Column:
    """Whether one of the names that a query spells out (those with ``_`` or ``.``, if it has any) stands in the names found; true for none."""
    specific = F.filter(names, lambda n: F.contains(n, F.lit("_")) | F.contains(n, F.lit(".")))
    check = F.when(F.size(specific) > 0, specific).otherwise(names)
    found = lambda n: F.contains(pool, n) | F.contains(pool, F.element_at(F.split(n, r"\."), -1))
    return (F.size(names) == 0) | F.exists(check, found)


def focus_hits(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, focused``: ``hits`` carry ``entity_name, file_path``. At most ``k`` names a query are joined to one text."""
    name, path = F.lower(F.coalesce("entity_name", F.lit(""))), F.lower(F.coalesce("file_path", F.lit("")))
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    pool = hits.groupBy("query_id").agg(F.concat_ws(" ", F.collect_set(F.concat_ws(" ", name, stem))).alias("_pool"))
    asked = queries.select("query_id", golden.native_identifiers(F.coalesce("query", F.lit(""))).alias("_names"))
    return asked.join(pool, "query_id", "left").select("query_id", names_in_reach(F.col("_names"), F.coalesce("_pool", F.lit(""))).alias("focused"))


def run_loop(
    queries: DataFrame,
    search: Callable[[DataFrame, int], DataFrame],
    info: DataFrame,
    must_cite: DataFrame | None = None,
    k: int = 10,
    extra: int = golden.MOST_EXTRA,
    stall: float = golden.STALL_OVERLAP,
    stop_on_stall: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Results (``query_id, chunk_id, rank``) and outcomes (``query_id, attempts, reason, grade, stalls``).

    ``search`` takes ``query_id, query, mode, action`` and how many hits are wanted, and gives ``query_id, chunk_id, rank``; ``info``: ``chunk_id,
    entity_name, file_path``; ``must_cite``: ``query_id, path``. A retry looks ``POOL_FACTOR`` times as deep, ``POOL_MOST`` at most.
    """
    spark = queries.sparkSession
    state = queries.select("query_id", "query", query_mode(F.col("query")).alias("mode"), F.lit("search").alias("action"))
    original = queries.select("query_id", "query")
    attempts = results = outcomes = None
    stalls = original.select("query_id", F.lit(0).alias("stalls"))
    for attempt in range(1, min(max(extra, 0), golden.MOST_EXTRA) + 2):
        state = materialize(state, "open")
        if state.isEmpty():
            break
        pool = k if attempt == 1 else min(k * golden.POOL_FACTOR, golden.POOL_MOST)
        new = search(state, pool).where(F.col("rank") < pool).select("query_id", "chunk_id", "rank")
        new = small(materialize(new, "hits")).join(info, "chunk_id").withColumn("attempt", F.lit(attempt))
        new = materialize(new, "found")
        before = None if attempts is None else golden.merge_attempts(attempts, None, k)
        attempts = new if attempts is None else attempts.unionByName(new)
        mine = attempts.join(state.select("query_id"), "query_id", "left_semi")
        names = original.select("query_id", F.explode(golden.native_identifiers(F.coalesce("query", F.lit("")))).alias("name"))
        merged = materialize(golden.merge_attempts(mine, names, k), "merged")
        told = materialize(small(merged).join(info, "chunk_id"), "told")
        open_ones = original.join(state.select("query_id"), "query_id", "left_semi")
        graded = golden.heuristic_grade(told, open_ones).join(focus_hits(told, open_ones), "query_id")
        least = F.lit(golden.GRADE_LEAST) - 1e-6
        if must_cite is not None:
            rate = metrics.citation_rate(must_cite, told.select("query_id", F.col("file_path").alias("path")))
            graded = graded.join(rate.withColumnRenamed("citation_rate", "coverage"), "query_id", "left")
            short = F.coalesce(F.col("coverage") < golden.CITATION_LEAST, F.lit(False))
        else:
            graded, short = graded.withColumn("coverage", F.lit(0.0)), F.lit(False)
        held_back = ~F.col("focused") | short
        graded = graded.withColumn("_stop", F.when(held_back, F.least("grade", least)).otherwise(F.col("grade")))
        graded = graded.withColumn("_cover", F.when(F.col("focused"), F.coalesce("coverage", F.lit(0.0))).otherwise(0.0))
        sets = merged.groupBy("query_id").agg(F.collect_set("chunk_id").alias("_now"))
        if before is not None:
            was = before.groupBy("query_id").agg(F.collect_set("chunk_id").alias("_was"))
            both = sets.join(was, "query_id", "full_outer")
            alike = F.size(F.array_intersect("_now", "_was")) / F.greatest(F.size(F.array_union("_now", "_was")), F.lit(1))
            graded = graded.join(both.select("query_id", (F.coalesce(alike, F.lit(0.0)) >= stall).alias("stalled")), "query_id", "left")
        else:
            graded = graded.withColumn("stalled", F.lit(False))
        reason = golden.should_stop(F.col("_stop"), F.col("_cover"), F.lit(attempt), extra)
        stalled = F.coalesce("stalled", F.lit(False))
        if stop_on_stall:
            reason = F.when((reason == "retry") & stalled, "stall").otherwise(reason)
        graded = graded.join(stalls, "query_id").select("query_id", "grade", reason.alias("reason"), (F.col("stalls") + stalled.cast("int")).alias("stalls"))
        graded = materialize(graded, "graded")
        closed = graded.where("reason <> 'retry'")
        done = closed.select("query_id", F.lit(attempt).alias("attempts"), "reason", "grade", "stalls")
        outcomes = done if outcomes is None else outcomes.unionByName(done)
        kept = merged.join(closed.select("query_id"), "query_id", "left_semi")
        results = kept if results is None else results.unionByName(kept)
        stalls = graded.select("query_id", "stalls")
        again = state.join(graded.where("reason = 'retry'").select("query_id"), "query_id", "left_semi").drop("query", "action").join(original, "query_id")
        told_next = golden.rewrite(F.col("query"), F.lit(attempt), F.col("mode"))
        state = again.select("query_id", told_next["query"].alias("query"), F.when(told_next["action"] == "rewrite", "bm25").otherwise("hybrid").alias("mode"), told_next["action"].alias("action"))
    if outcomes is None:
        kind = {f.name: f.dataType.simpleString() for f in [*queries.schema, *info.schema]}
        return spark.createDataFrame([], f"query_id {kind['query_id']}, chunk_id {kind['chunk_id']}, rank int"), spark.createDataFrame([], f"query_id {kind['query_id']}, attempts int, reason string, grade double, stalls int")
    return results, outcomes
