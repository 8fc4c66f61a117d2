"""Catalogue: metrics, failures, gates and ablations of a dense retrieval scored by label."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.text import normalize_path
from marlstone.operators import loop, metrics
from marlstone.operators import vectors as dense
from marlstone.plans.tables import table, vector_queries, vectors
from marlstone.scratch import materialize

K = 10


def _hits(spark: SparkSession, d: str, where: str | None = None) -> DataFrame:
    found = dense.dense_search(vectors(spark, d), vector_queries(spark, d), K, where)
    return found.select("query_id", F.col("chunk_id").alias("item"), F.col("rank"))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many rows each query's label has: its gold."""
    counts = vectors(spark, d).groupBy("label").agg(F.count("*").alias("n"))
    return vector_queries(spark, d).select("query_id", "label").join(counts, "label").select("query_id", "n")


def _relevant(spark: SparkSession, d: str, hits: DataFrame) -> DataFrame:
    """The hits that have their query's label."""
    q = vector_queries(spark, d).select("query_id", F.col("label").alias("_want"))
    own = vectors(spark, d).select(F.col("chunk_id").alias("item"), "label")
    return hits.join(own, "item").join(q, "query_id").where(F.col("label") == F.col("_want")).drop("label", "_want")


def _scores(spark: SparkSession, d: str, where: str | None = None) -> DataFrame:
    return metrics.recall_ndcg(_relevant(spark, d, _hits(spark, d, where)), _sizes(spark, d), K)


def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).select("query_id", F.round("recall", 6).alias("recall"))


def ndcg_at_k(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).select("query_id", F.round("ndcg", 6).alias("ndcg"))


def _paths(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Required: each page's own path; cited: the path of the page's URL as links give it, without the first segment."""
    p = table(spark, d, "pages").select(F.col("page_id").alias("query_id"), F.regexp_extract("url", r"^https?://[^/]+([^?#]*)", 1).alias("path"))
    required = p.select("query_id", F.concat(F.lit("."), "path").alias("path"))
    cited = p.select("query_id", F.when(F.col("query_id") % 3 == 0, F.lit("/other")).otherwise(F.regexp_replace("path", "^/[^/]*", "")).alias("path"))
    return required, cited


def citation_rate(spark: SparkSession, d: str) -> DataFrame:
    required, cited = _paths(spark, d)
    return metrics.citation_rate(required.where("path <> '.'"), cited.where("path <> ''")).select("query_id", F.round("citation_rate", 6).alias("citation_rate"))


def path_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", normalize_path(F.concat(F.lit(".//"), F.regexp_replace("url", "/", r"\\"))).alias("path"))


def failure_labels(spark: SparkSession, d: str) -> DataFrame:
    """Stages: dense over all; sparse over three labels; fused: the first five of both; final: the first three of dense."""
    all_hits, some = _hits(spark, d), _hits(spark, d, "label IN (1, 4, 7)")
    stages = [
        all_hits.select("query_id", F.lit("dense").alias("stage"), "item"),
        some.select("query_id", F.lit("sparse").alias("stage"), "item"),
        all_hits.where("rank < 5").unionByName(some.where("rank < 5")).select("query_id", F.lit("fused").alias("stage"), "item"),
        all_hits.where("rank < 3").select("query_id", F.lit("final").alias("stage"), "item"),
    ]
    # Gold that no stage found tells nothing beyond what a query without any find does, so only found gold is listed.
    rows = materialize(reduce(DataFrame.unionByName, stages), "stages")
    found = _relevant(spark, d, rows.select("query_id", "item").distinct()).select("query_id", "item")
    none = vector_queries(spark, d).select("query_id", F.lit(-1).cast("long").alias("item")).join(found.select("query_id").distinct(), "query_id", "left_anti")
    return metrics.failure_labels(rows, found.unionByName(none))


def _cases(spark: SparkSession, d: str, where: str | None = None) -> DataFrame:
    return _scores(spark, d, where).join(vector_queries(spark, d).select("query_id", "label"), "query_id")


def eval_by_category(spark: SparkSession, d: str) -> DataFrame:
    s = metrics.summary(_cases(spark, d), "label")
    return s.select("label", "n", *[F.round(c, 6).alias(c) for c in ("recall", "ndcg", "recall_p50")])


VARIANTS = {"full": None, "low_labels": "label < 5", "three_labels": "label IN (0, 3, 6)"}


def ablation_matrix(spark: SparkSession, d: str) -> DataFrame:
    rows = [metrics.summary(_cases(spark, d, w)).withColumn("variant", F.lit(v)) for v, w in VARIANTS.items()]
    return reduce(DataFrame.unionByName, rows).select("variant", "n", *[F.round(c, 6).alias(c) for c in ("recall", "ndcg", "recall_p50")])


def ab_gate(spark: SparkSession, d: str) -> DataFrame:
    report = lambda w: metrics.summary(_cases(spark, d, w)).select(F.lit(K).alias("k"), "recall", "ndcg")
    out = metrics.gate(report(None), report("label IN (0, 3, 6)"))
    return out.select("k", *[F.round(c, 6).alias(c) for c in ("base_recall", "recall", "base_ndcg", "ndcg")], "relative_ok", "absolute_ok", "passed")


def stall_jaccard(spark: SparkSession, d: str) -> DataFrame:
    parts = [_hits(spark, d, w).groupBy("query_id").agg(F.collect_set("item").alias("ids")).withColumn("attempt", F.lit(i)) for i, w in enumerate((None, "label < 6", "label < 6"))]
    return metrics.stall_jaccard(reduce(DataFrame.unionByName, parts)).select("query_id", F.col("attempt").cast("long").alias("attempt"), F.round("similarity", 6).alias("similarity"))


def query_mode(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark texts, and questions and names made of their first letters, by the mode they are searched in."""
    name = F.concat(F.lit("fn_"), F.col("item_id").cast("string"))
    made = F.array(F.col("text"), name, F.concat(F.lit("who calls "), name), F.concat(F.lit("why is `"), name, F.lit("` here")), F.concat(F.lit("where is `"), name, F.lit("` defined")), F.lit("plain words only"))
    asked = table(spark, d, "benchmark").select("item_id", F.posexplode(made).alias("variant", "query"))
    return asked.select("item_id", F.col("variant").cast("long").alias("variant"), loop.query_mode(F.col("query")).alias("mode"))


QUERIES = {f.__name__: f for f in (query_mode, recall_at_k, ndcg_at_k, citation_rate, path_normalize, failure_labels, eval_by_category, ablation_matrix, ab_gate, stall_jaccard)}


def _hits_sql(name: str, where: str = "true") -> str:
    return f"""{name} AS (SELECT query_id, item, rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS item,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) DESC, e.vec_id) - 1 AS rank
  FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND ({where})) WHERE rank < {K})"""


_GOLD = "gold AS (SELECT DISTINCT q.vec_id AS query_id, e.vec_id AS item FROM embeddings q JOIN embeddings e USING (label) WHERE q.vec_id % 20 = 0)"


def _cases_sql(name: str, hits: str) -> str:
    return f"""{name} AS (SELECT g.query_id, count(h.rank) / count(*)::DOUBLE AS recall,
  least(coalesce(sum(1 / log2(h.rank + 2)), 0) / list_sum(list_transform(range(0, least(count(*), {K})), lambda i: 1 / log2(i + 2))), 1.0) AS ndcg,
  any_value(e.label) AS label FROM gold g JOIN embeddings e ON e.vec_id = g.query_id LEFT JOIN {hits} h ON h.query_id = g.query_id AND h.item = g.item GROUP BY g.query_id)"""


_ALL = f"WITH {_hits_sql('h')}, {_GOLD}, {_cases_sql('c', 'h')}"
_SUMMARY = "count(*) AS n, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg, round(median(recall), 6) AS recall_p50"

ORACLES = {
    "query_mode": f"""WITH q AS (SELECT item_id, v::BIGINT AS variant, [text, 'fn_' || item_id, 'who calls fn_' || item_id, 'why is `fn_' || item_id || '` here',
  'where is `fn_' || item_id || '` defined', 'plain words only'][v + 1] AS q FROM benchmark, range(6) r(v)),
t AS (SELECT *, regexp_extract_all(lower(q), '[a-z0-9_]+') AS w FROM q)
SELECT item_id, variant, CASE WHEN list_has_any(w, {list(loop.GRAPH_WORDS)}) OR contains(lower(q), 'who calls') OR contains(lower(q), 'used by') THEN 'graph'
  WHEN list_has_any(w, {list(loop.EXPLAIN_WORDS)}) THEN 'hybrid' WHEN variant IN (1, 4) THEN 'bm25' ELSE 'hybrid' END AS mode FROM t""",
    "recall_at_k": f"{_ALL} SELECT query_id, round(recall, 6) AS recall FROM c",
    "ndcg_at_k": f"{_ALL} SELECT query_id, round(ndcg, 6) AS ndcg FROM c",
    "citation_rate": r"""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+([^?#]*)', 1) AS path FROM pages),
n AS (SELECT page_id, regexp_replace(regexp_replace(path, '/{2,}', '/', 'g'), '^(\./|/)+', '') AS need, regexp_replace(regexp_replace(CASE WHEN page_id % 3 = 0 THEN '/other' ELSE regexp_replace(path, '^/[^/]*', '') END, '/{2,}', '/', 'g'), '^(\./|/)+', '') AS have,
  path, CASE WHEN page_id % 3 = 0 THEN '/other' ELSE regexp_replace(path, '^/[^/]*', '') END AS raw FROM p)
SELECT page_id AS query_id, CASE WHEN raw <> '' AND (need = have OR ends_with(need, '/' || have) OR ends_with(have, '/' || need)) THEN 1.0 ELSE 0.0 END::DOUBLE AS citation_rate FROM n WHERE path <> ''""",
    "path_normalize": r"SELECT page_id, regexp_replace(regexp_replace(url, '/{2,}', '/', 'g'), '^(\./|/)+', '') AS path FROM pages",
    "failure_labels": f"""WITH {_hits_sql("h")}, {_hits_sql("s", "e.label IN (1, 4, 7)")}, {_GOLD},
i AS (SELECT g.query_id, g.item, (h.rank IS NOT NULL)::INT AS dense, (s.rank IS NOT NULL)::INT AS sparse,
  (coalesce(h.rank < 5, false) OR coalesce(s.rank < 5, false))::INT AS fused, coalesce(h.rank < 3, false)::INT AS final
  FROM gold g LEFT JOIN h USING (query_id, item) LEFT JOIN s USING (query_id, item)),
q AS (SELECT query_id, max(dense) AS dense, max(sparse) AS sparse, max(fused) AS fused, max((greatest(dense, sparse) = 1 AND fused = 0)::INT) AS lost, max((fused = 1 AND final = 0)::INT) AS dropped FROM i GROUP BY query_id)
SELECT query_id, concat_ws(',', CASE WHEN dense = 0 THEN 'dense_miss' END, CASE WHEN sparse = 0 THEN 'sparse_miss' END, CASE WHEN fused = 0 THEN 'fusion_miss' END,
  CASE WHEN lost = 1 THEN 'fusion_drop' END, CASE WHEN dropped = 1 THEN 'rerank_drop' END) AS labels FROM q""",
    "eval_by_category": f"{_ALL} SELECT label, {_SUMMARY} FROM c GROUP BY label",
    "ablation_matrix": f"""WITH {_hits_sql("h1")}, {_hits_sql("h2", "e.label < 5")}, {_hits_sql("h3", "e.label IN (0, 3, 6)")}, {_GOLD}, {_cases_sql("c1", "h1")}, {_cases_sql("c2", "h2")}, {_cases_sql("c3", "h3")}
SELECT 'full' AS variant, {_SUMMARY} FROM c1 UNION ALL SELECT 'low_labels', {_SUMMARY} FROM c2 UNION ALL SELECT 'three_labels', {_SUMMARY} FROM c3""",
    "ab_gate": f"""WITH {_hits_sql("h1")}, {_hits_sql("h3", "e.label IN (0, 3, 6)")}, {_GOLD}, {_cases_sql("c1", "h1")}, {_cases_sql("c3", "h3")},
r AS (SELECT (SELECT avg(recall) FROM c1) AS br, (SELECT avg(ndcg) FROM c1) AS bn, (SELECT avg(recall) FROM c3) AS r, (SELECT avg(ndcg) FROM c3) AS n),
g AS (SELECT *, CASE WHEN br > 0 THEN (br - r) / br ELSE 0 END <= 0.05 + 1e-9 AND CASE WHEN bn > 0 THEN (bn - n) / bn ELSE 0 END <= 0.05 + 1e-9 AS a, br - r <= 0.02 + 1e-9 AS b FROM r)
SELECT {K} AS k, round(br, 6) AS base_recall, round(r, 6) AS recall, round(bn, 6) AS base_ndcg, round(n, 6) AS ndcg, a AS relative_ok, b AS absolute_ok, a AND b AS passed FROM g""",
    "stall_jaccard": f"""WITH {_hits_sql("h1")}, {_hits_sql("h2", "e.label < 6")},
a AS (SELECT query_id, 0 AS attempt, list(item) AS ids FROM h1 GROUP BY query_id UNION ALL SELECT query_id, 1, list(item) FROM h2 GROUP BY query_id UNION ALL SELECT query_id, 2, list(item) FROM h2 GROUP BY query_id),
b AS (SELECT *, lag(ids) OVER (PARTITION BY query_id ORDER BY attempt) AS was FROM a)
SELECT query_id, attempt::BIGINT AS attempt, round(len(list_intersect(ids, was)) / len(list_distinct(list_concat(ids, was)))::DOUBLE, 6) AS similarity FROM b WHERE was IS NOT NULL
UNION ALL SELECT query_id, attempt::BIGINT, NULL FROM b WHERE was IS NULL""",
}
