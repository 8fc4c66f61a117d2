"""Scoring retrieval against a golden suite: matching of gold ids, per-query metrics, grades, coverage, stopping, ablations."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import normalize_path, path_matches
from marlstone.operators import metrics
from marlstone.operators.filters import id_is_synthetic
from marlstone.operators.loop import CAMEL, DOTTED, PATH_EXTENSIONS, SNAKE, STOP_WORDS

# Parts of a grade, bounds of the loop.
NAME_PART, PATH_PART, MODEL_PART = 0.45, 0.25, 0.30
GRADE_LEAST, CITATION_LEAST, MOST_EXTRA, STALL_OVERLAP = 0.35, 0.5, 2, 0.8
POOL_FACTOR, POOL_MOST = 4, 50
PROPER = r"\b[A-Z][A-Za-z0-9_]{2,}\b"
PROPER_STOP = ("How", "Who", "Where", "What", "Why", "The", "This", "That", "And", "For", "With", "CLI", "API", "When", "Which")


def entity_key(entity_id: Column) -> Column:
    """``path`` and bare name of ``kind:path:Class.name``, joined; null where there are not three parts."""
    part = F.split(entity_id, ":")
    path, name = normalize_path(F.get(part, F.lit(1))), F.element_at(F.split(F.get(part, F.lit(2)), r"\."), -1)
    return F.when((F.size(part) >= 3) & (path != "") & (name != ""), F.concat(F.lit("key "), path, F.lit(" "), name))


def match_keys(entity_id: Column) -> Column:
    """All values by which a gold id can name this id: itself, what it begins with up to a colon, and its key."""
    part = F.split(entity_id, ":")
    heads = F.transform(F.sequence(F.lit(1), F.size(part)), lambda i: F.concat(F.lit("id "), F.array_join(F.slice(part, F.lit(1), i), ":")))
    return F.coalesce(F.array_compact(F.concat(heads, F.array(entity_key(entity_id)))), F.array().cast("array<string>"))


def gold_matches(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """``query_id, rank, chunk_id, gold, place``: hits and the gold ids that name them.

    ``hits``: ``query_id, chunk_id, rank`` and, if known, ``entity_id`` and ``backed`` (real source; else the id tells stubs apart); ``gold``:
    ``query_id, gold`` and, if it matters, ``place``. An equi-join on the values that name a chunk, so gold and hits never meet as pairs.
    """
    real = F.col("backed") if "backed" in hits.columns else ~id_is_synthetic(F.col("chunk_id").cast("string"))
    ids = [F.col("chunk_id").cast("string"), *([F.col("entity_id")] if "entity_id" in hits.columns else [])]
    keys = F.array_distinct(reduce(lambda a, b: F.concat(a, b), map(match_keys, ids)))
    named = hits.where(real).select("query_id", "rank", "chunk_id", F.explode(keys).alias("_k"))
    place = F.col("place") if "place" in gold.columns else F.lit(0)
    own = F.array_compact(F.array(F.concat(F.lit("id "), F.col("gold")), entity_key(F.col("gold"))))
    wanted = gold.where("gold <> ''").select("query_id", "gold", place.alias("place"), F.explode(own).alias("_k"))
    return named.join(wanted, ["query_id", "_k"]).select("query_id", "rank", "chunk_id", "gold", "place").distinct()


def ranked_for_metrics(hits: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """``query_id, item, rank``: gold ids in place of the hits that they name, each used once, by the earliest hit that is free for it."""
    pairs = gold_matches(hits.where(F.col("rank") < k), gold)

    def assign(group: pd.DataFrame) -> pd.DataFrame:
        used, out, last = set(), [], None
        for r in group.sort_values(["rank", "place", "gold"]).itertuples():
            if r.rank != last and r.gold not in used:
                used.add(r.gold)
                last = r.rank
                out.append((r.query_id, r.gold, r.rank))
        return pd.DataFrame(out, columns=["query_id", "item", "rank"])

    kind = hits.schema["query_id"].dataType.simpleString()
    # A query's pairs are bounded by k and its own gold list.
    return pairs.groupBy("query_id").applyInPandas(assign, f"query_id {kind}, item string, rank int")


def evaluate(hits: DataFrame, gold: DataFrame, must_cite: DataFrame, k: int) -> DataFrame:
    """``query_id, recall, ndcg, citation_rate``; null where a query has no gold or no path to cite. ``hits`` also carry ``file_path``."""
    ranked = ranked_for_metrics(hits, gold, k)
    g = gold.select("query_id", F.col("gold").alias("item"))
    cited = hits.where(F.col("rank") < k).select("query_id", F.col("file_path").alias("path"))
    out = metrics.recall_at_k(ranked, g, k).join(metrics.ndcg_at_k(ranked, g, k), "query_id")
    return out.join(metrics.citation_rate(must_cite, cited), "query_id", "full_outer")


def report(cases: DataFrame, by: str | None = None, latencies: DataFrame | None = None) -> DataFrame:
    """Counts, means and medians over cases, overall or by difficulty or category; ``latencies`` (``query_id, ms``) add their mean and median."""
    rows = cases if latencies is None else cases.join(latencies, "query_id", "left")
    aggs = [F.count("*").alias("n"), F.avg("recall").alias("recall"), F.avg("ndcg").alias("ndcg"), F.avg("citation_rate").alias("citation_rate"), F.median("recall").alias("recall_p50")]
    if latencies is not None:
        aggs += [F.avg("ms").alias("ms_mean"), F.median("ms").alias("ms_p50")]
    return rows.groupBy(by).agg(*aggs) if by else rows.agg(*aggs)


def failure_counts(labels: DataFrame) -> DataFrame:
    """``label, n`` over ``query_id, labels`` (comma-joined)."""
    return labels.select(F.explode(F.filter(F.split("labels", ","), lambda x: x != "")).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


#: Ablations: the channels that a variant searches, and whether it uses the graph, the model and diversity.
ABLATIONS = {
    "full": (("dense", "sparse"), True, True, True),
    "no_dense": (("sparse",), True, True, True),
    "no_bm25": (("dense",), True, True, True),
    "no_graph": (("dense", "sparse"), False, True, True),
    "no_rerank": (("dense", "sparse"), True, False, True),
    "no_mmr": (("dense", "sparse"), True, True, False),
}


def ablation_hits(channels: dict[str, DataFrame], weights: dict[str, float], graph_hits: DataFrame, model: DataFrame, diversify, k: int) -> dict[str, DataFrame]:
    """Hits of every variant of ``ABLATIONS``. ``diversify`` reorders ``query_id, chunk_id, score`` and numbers ``rank``."""
    from marlstone.operators import fusion, retrieval

    out = {}
    for name, (used, with_graph, with_model, with_mmr) in ABLATIONS.items():
        fused = retrieval.fuse({c: channels[c] for c in used}, weights).select("query_id", "chunk_id", "score")
        if with_graph:
            fused = fusion.graph_boost(fused, graph_hits)
        if with_model:
            fused = retrieval.rerank_head(fused, model, k, "blend", 0.3)
        cut = fusion.final_cut(fused.select("query_id", "chunk_id", "score"), k)
        out[name] = diversify(cut) if with_mmr else cut
    return out


def native_identifiers(query: Column, lower: bool = True) -> Column:
    """Names that the query spells out, each once (lower-cased unless asked otherwise); file names don't count."""
    ticked = F.filter(F.transform(F.regexp_extract_all(query, F.lit("`([^`]+)`")), lambda t: F.trim(t)), lambda t: t != "")
    shaped = [F.regexp_extract_all(query, F.lit(p), F.lit(0)) for p in (CAMEL, SNAKE, DOTTED)]
    proper = F.filter(F.regexp_extract_all(query, F.lit(PROPER), F.lit(0)), lambda t: ~t.isin(*PROPER_STOP))
    file_name = r"(?i)\b[\w./-]+\.(?:" + "|".join(PATH_EXTENSIONS) + r")\b"
    terms = F.filter(F.concat(ticked, *shaped, proper), lambda t: ~F.regexp(t, F.lit(file_name)))
    return F.array_distinct(F.transform(terms, F.lower) if lower else terms)


def rewrite(query: Column, attempt: Column, mode: Column) -> Column:
    """``struct<query, action>``: what a retry asks and does. A graph question keeps its names and goes deeper; names that differ from the
    query replace it; else a second retry searches by an invented answer."""
    names = native_identifiers(F.coalesce(query, F.lit("")), lower=False)
    focus = F.nullif(F.array_join(names, " "), F.lit(""))
    says = lambda q, action: F.struct(q.alias("query"), F.lit(action).alias("action"))
    changed = focus.isNotNull() & (F.lower(F.trim(focus)) != F.lower(F.trim(F.coalesce(query, F.lit("")))))
    return F.when(mode == "graph", says(F.coalesce(focus, query), "deepen_graph")).when(changed, says(F.coalesce(focus, query), "rewrite")).when(attempt >= 2, says(query, "hyde")).otherwise(says(F.coalesce(focus, query), "rewrite"))


def heuristic_grade(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, grade``: names and paths of the hits that the query's words name, and a part for a model's best score (``model_max``, if given).

    ``hits``: ``query_id, entity_name, file_path``. Counts meet map-side: per hit first, then per query.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col("query")), F.lit("([a-z0-9_]+)")))
    bare = F.lower(F.trim(F.trim(F.coalesce("query", F.lit(""))), F.lit("`")))
    q = queries.select("query_id", words.alias("w"), bare.alias("bare"), native_identifiers(F.coalesce("query", F.lit(""))).alias("focus"))
    path = F.lower(normalize_path(F.col("file_path")))
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    name = F.lower(F.coalesce("entity_name", F.lit("")))
    parts = F.filter(F.split(path, r"[/.\-]+"), lambda p: (p != "") & ~p.isin(*PATH_EXTENSIONS))
    rows = hits.join(q, "query_id")
    pool = F.array_distinct(F.array(name, F.element_at(F.split(name, r"\."), -1), stem))
    long_words = F.filter("w", lambda t: (F.length(t) >= 3) & ~t.isin(*STOP_WORDS))
    each = rows.select(
        "query_id", "w", "focus", pool.alias("pool"), ((F.col("bare") != "") & ((F.col("bare") == name) | F.array_contains(F.split(name, r"\."), F.col("bare")))).alias("exact"), F.arrays_overlap(parts, long_words).alias("on_path")
    )
    found = each.groupBy("query_id").agg(
        F.max("exact").alias("exact"), F.max(F.coalesce("on_path", F.lit(False))).alias("on_path"), F.max(F.arrays_overlap("pool", "focus")).alias("focus")
    )
    named = each.select("query_id", F.explode(F.array_intersect("pool", "w")).alias("t")).groupBy("query_id").agg(F.count_distinct("t").alias("named"))
    both = q.select("query_id").join(found, "query_id", "left").join(named, "query_id", "left")
    hits_n = F.greatest(F.coalesce("named", F.lit(0)), F.when(F.col("exact"), 2).otherwise(0), F.when(F.col("focus"), 1).otherwise(0))
    grade = NAME_PART * F.least(F.lit(1.0), hits_n / 2) + F.when(F.col("on_path"), PATH_PART).otherwise(0.0)
    if "model_max" in queries.columns:
        m = F.col("model_max")
        scaled = F.when(m <= 0, 0.0).when(m <= 1, m).otherwise(1 / (1 + F.exp(-m)))
        both = both.join(queries.select("query_id", "model_max"), "query_id")
        grade = grade + MODEL_PART * F.coalesce(scaled, F.lit(0.0))
    return both.select("query_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), grade)).alias("grade"))


def should_stop(grade: Column, coverage: Column, attempt: Column, extra: int = MOST_EXTRA, grade_least: float = GRADE_LEAST, citation_least: float = CITATION_LEAST) -> Column:
    """Why a loop ends after ``attempt``: ``grade``, ``citation`` or ``budget``; ``retry`` if it goes on."""
    allowed = min(max(extra, 0), MOST_EXTRA)
    return F.when(grade >= grade_least, "grade").when(coverage >= citation_least, "citation").when(attempt - 1 >= allowed, "budget").otherwise("retry")


def merge_attempts(attempts: DataFrame, names: DataFrame | None = None, k: int = 10) -> DataFrame:
    """``attempts``: ``query_id, attempt, chunk_id, rank`` (and ``entity_name``). The newest attempt's order first, each chunk once; chunks whose
    entity is among ``names`` (``query_id, name``) come before all others. The first ``k`` stay: ``query_id, chunk_id, rank``."""
    first = attempts.groupBy("query_id", "chunk_id").agg(F.min(F.struct((-F.col("attempt")).alias("a"), "rank")).alias("_o"), *([F.first("entity_name").alias("entity_name")] if names is not None else []))
    top = F.lit(False)
    if names is not None:
        wanted = names.select("query_id", F.lower("name").alias("_n")).distinct()
        full, short = F.lower("entity_name"), F.element_at(F.split(F.lower("entity_name"), r"\."), -1)
        marks = first.select("query_id", "chunk_id", F.explode(F.array_distinct(F.array(full, short))).alias("_n")).join(wanted, ["query_id", "_n"]).select("query_id", "chunk_id", F.lit(True).alias("_top")).distinct()
        first = first.join(marks, ["query_id", "chunk_id"], "left")
        top = F.coalesce("_top", F.lit(False))
    order = Window.partitionBy("query_id").orderBy(top.desc(), "_o", "chunk_id")
    return first.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k).select("query_id", "chunk_id", "rank")


def coverage(cited: DataFrame, retrieved: DataFrame, must: DataFrame) -> DataFrame:
    """``query_id, coverage``: of the paths that an answer cites or must cite, the share that it cites and that was retrieved. Inputs: ``query_id, path``."""
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    norm = lambda df: df.select("query_id", normalize_path(F.col("path")).alias("path")).where("path <> ''").distinct().withColumn("_l", last(F.col("path")))
    c, r, m = norm(cited), norm(retrieved).withColumnRenamed("path", "have"), norm(must)
    met = c.join(r, ["query_id", "_l"]).where(path_matches(F.col("path"), F.col("have"))).groupBy("query_id").agg(F.count_distinct("path").alias("n"))
    every = c.select("query_id", "path").unionByName(m.select("query_id", "path")).distinct().groupBy("query_id").agg(F.count("*").alias("d"))
    return every.join(met, "query_id", "left").select("query_id", (F.coalesce("n", F.lit(0)) / F.greatest("d", F.lit(1))).alias("coverage"))


def stall_rates(attempts: DataFrame, overlap: float = STALL_OVERLAP) -> DataFrame:
    """``query_id, stalls, escapes`` over ``query_id, attempt, ids, grade``: retries whose hits overlap the last attempt's by ``overlap``, and
    retries right after one that don't and grade higher."""
    w = Window.partitionBy("query_id").orderBy("attempt")
    rows = metrics.stall_jaccard(attempts).withColumn("_s", F.coalesce(F.col("similarity") >= overlap, F.lit(False)))
    rows = rows.withColumn("_e", ~F.col("_s") & F.coalesce(F.lag("_s").over(w), F.lit(False)) & (F.col("grade") > F.lag("grade").over(w)))
    return rows.groupBy("query_id").agg(F.sum(F.col("_s").cast("int")).alias("stalls"), F.sum(F.col("_e").cast("int")).alias("escapes"))
