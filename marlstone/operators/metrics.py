"""Retrieval metrics, failure labels, gates and ablations, for all queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import normalize_path, path_matches


def first_seen(hits: DataFrame) -> DataFrame:
    """Each item once, at its best rank."""
    return hits.groupBy("query_id", "item").agg(F.min("rank").alias("rank"))


def recall_at_k(hits: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """``query_id, recall``: share of the distinct gold items among the first ``k``. Queries without gold have no row."""
    g = gold.select("query_id", "item").distinct()
    h = first_seen(hits).where(F.col("rank") < k)
    return g.join(h, ["query_id", "item"], "left").groupBy("query_id").agg((F.count("rank") / F.count("*")).alias("recall"))


def ndcg_at_k(hits: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """``query_id, ndcg`` with binary gain; only an item's first place counts."""
    g = gold.select("query_id", "item").distinct()
    h = first_seen(hits).where(F.col("rank") < k)
    gains = g.join(h, ["query_id", "item"], "left").groupBy("query_id").agg(F.sum(1 / F.log2(F.col("rank") + 2)).alias("dcg"), F.count("*").cast("int").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(0), F.least("n", F.lit(k)) - 1), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 2))
    return gains.select("query_id", F.least(F.coalesce("dcg", F.lit(0.0)) / ideal, F.lit(1.0)).alias("ndcg"))


def recall_ndcg(relevant: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """``query_id, recall, ndcg`` where gold is known by its number alone (``sizes``: ``query_id, n``): ``relevant`` has the hits that are gold
    (``query_id, item, rank``), so gold lists as long as a class never meet their queries."""
    h = first_seen(relevant).where(F.col("rank") < k).groupBy("query_id").agg(F.count("*").alias("_m"), F.sum(1 / F.log2(F.col("rank") + 2)).alias("_dcg"))
    ideal = F.aggregate(F.sequence(F.lit(0), F.least(F.col("n").cast("int"), F.lit(k)) - 1), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 2))
    rows = sizes.where("n > 0").join(h, "query_id", "left")
    return rows.select("query_id", (F.coalesce("_m", F.lit(0)) / F.col("n")).alias("recall"), F.least(F.coalesce("_dcg", F.lit(0.0)) / ideal, F.lit(1.0)).alias("ndcg"))


def citation_rate(required: DataFrame, cited: DataFrame) -> DataFrame:
    """Share of each query's required paths that some cited path equals or ends in. Joined on the last segment, then matched."""
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    r = required.select("query_id", normalize_path(F.col("path")).alias("need")).distinct().withColumn("_l", last(F.col("need")))
    c = cited.select("query_id", normalize_path(F.col("path")).alias("have")).distinct().withColumn("_l", last(F.col("have")))
    met = r.join(c, ["query_id", "_l"]).where(path_matches(F.col("need"), F.col("have"))).select("query_id", "need").distinct().withColumn("_met", F.lit(1))
    return r.join(met, ["query_id", "need"], "left").groupBy("query_id").agg(F.avg(F.coalesce("_met", F.lit(0))).alias("citation_rate"))


STAGES = ("dense", "sparse", "fused", "final")


def failure_labels(stage_hits: DataFrame, gold: DataFrame) -> DataFrame:
    """``query_id, labels``: misses of the first two stages and of fusion, then drops between stages, in a fixed order, comma-joined.

    ``stage_hits``: ``query_id, stage, item``. A stage misses if it has no gold item; an item drops if the stage before has it and
    the later one hasn't.
    """
    found = gold.select("query_id", "item").distinct().join(stage_hits.select("query_id", "stage", "item").distinct(), ["query_id", "item"], "left")
    has = [F.max(F.when(F.col("stage") == s, 1).otherwise(0)).alias(s) for s in STAGES]
    items = found.groupBy("query_id", "item").agg(*has)
    dropped = F.max(F.when((F.col("fused") == 1) & (F.col("final") == 0), 1).otherwise(0)).alias("dropped")
    lost = F.max(F.when((F.greatest("dense", "sparse") == 1) & (F.col("fused") == 0), 1).otherwise(0)).alias("lost")
    q = items.groupBy("query_id").agg(*[F.max(s).alias(s) for s in STAGES], dropped, lost)
    labels = [
        F.when(F.col("dense") == 0, F.lit("dense_miss")),
        F.when(F.col("sparse") == 0, F.lit("sparse_miss")),
        F.when(F.col("fused") == 0, F.lit("fusion_miss")),
        F.when(F.col("lost") == 1, F.lit("fusion_drop")),
        F.when(F.col("dropped") == 1, F.lit("rerank_drop")),
    ]
    return q.select("query_id", F.array_join(F.array_compact(F.array(*labels)), ",").alias("labels"))


def summary(cases: DataFrame, by: str | None = None) -> DataFrame:
    """Counts, mean recall and nDCG, median recall, overall or by a column."""
    aggs = [F.count("*").alias("n"), F.avg("recall").alias("recall"), F.avg("ndcg").alias("ndcg"), F.median("recall").alias("recall_p50")]
    return cases.groupBy(by).agg(*aggs) if by else cases.agg(*aggs)


RELATIVE, ABSOLUTE = 0.05, {10: 0.02, 30: 0.01}


def gate(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """Joins two reports (``k, recall, ndcg``) on ``k``: ``passed`` unless recall or nDCG falls by over 5 %, or recall by an absolute
    .02 at 10 or .01 at 30."""
    b = base.select("k", F.col("recall").alias("base_recall"), F.col("ndcg").alias("base_ndcg"))
    c = candidate.select("k", "recall", "ndcg")

    def drop(was: Column, now: Column) -> Column:
        return F.when(was > 0, (was - now) / was).otherwise(0.0)

    limit = F.lit(None).cast("double")
    for k, v in ABSOLUTE.items():
        limit = F.when(F.col("k") == k, v).otherwise(limit)
    relative = (drop(F.col("base_recall"), F.col("recall")) <= RELATIVE + 1e-9) & (drop(F.col("base_ndcg"), F.col("ndcg")) <= RELATIVE + 1e-9)
    absolute = F.coalesce(F.col("base_recall") - F.col("recall") <= limit + 1e-9, F.lit(True))
    return b.join(c, "k").select("k", "base_recall", "recall", "base_ndcg", "ndcg", relative.alias("relative_ok"), absolute.alias("absolute_ok"), (relative & absolute).alias("passed"))


def gate_exit_code(result: DataFrame, force: bool = False) -> int:
    """0 if all rows passed or the gate is forced, else 1; no row is a skip and gives 0."""
    return 0 if force or result.where(~F.col("passed")).isEmpty() else 1


def stall_jaccard(attempts: DataFrame, both_empty: float = 1.0) -> DataFrame:
    """``attempts``: ``query_id, attempt, ids``. Adds ``similarity`` to the attempt before (null for the first)."""
    w = Window.partitionBy("query_id").orderBy("attempt")
    before = F.lag("ids").over(w)
    union = F.size(F.array_union("ids", before))
    value = F.when(union > 0, F.size(F.array_intersect("ids", before)) / union).otherwise(F.lit(both_empty))
    return attempts.withColumn("similarity", F.when(before.isNotNull(), value))


def markdown(report: DataFrame, most: int = 200) -> str:
    """A report of at most ``most`` rows as a Markdown table; fractions to four places, nulls as a dash."""
    shown = lambda v: "-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = [report.columns, ["---"] * len(report.columns), *[[shown(v) for v in row] for row in report.limit(most).collect()]]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines) + "\n"
