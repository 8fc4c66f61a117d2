"""Catalogue: tokens, BM25, channels, dense search, fusion, reranking, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.text import jaccard, token_estimate, tokenize, tokenize_identifiers
from marlstone.operators import fusion, index, lexical, packing
from marlstone.operators import vectors as dense
from marlstone.plans.tables import asked, chunks, stored_postings, table, vector_queries, vectors
from marlstone.scratch import materialize, small

K = 10


def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    t = tokenize("content")
    return chunks(spark, d).select("chunk_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_terms"))


def postings_tf(spark: SparkSession, d: str) -> DataFrame:
    return lexical.postings(chunks(spark, d))


def doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return lexical.document_frequency(lexical.postings(chunks(spark, d)))


def doc_len_stats(spark: SparkSession, d: str) -> DataFrame:
    s = lexical.document_stats(chunks(spark, d))
    return s.agg(F.count("*").alias("n"), F.round(F.avg("dl"), 6).alias("avgdl"), F.max("dl").alias("longest"))


def ident_split_tokens(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select("chunk_id", F.array_join(tokenize_identifiers("content"), " ").alias("tokens"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return index.search(stored_postings(spark, d), asked(spark, d), K).select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


def bm25_idf(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d)
    return lexical.idf_table(lexical.postings(c), lexical.document_stats(c)).select("term", "df", F.round("idf", 6).alias("idf"))


def overlap_channel(spark: SparkSession, d: str) -> DataFrame:
    return lexical.overlap_channel(chunks(spark, d), asked(spark, d), k=K).select("query_id", "chunk_id", "score")


def symbol_channel(spark: SparkSession, d: str) -> DataFrame:
    """Orders' clerk-like lookups: customers (as chunks) by the names that segments (as queries) ask for."""
    c = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("entity_name")).agg(F.count("*").alias("hits"), F.min("c_custkey").alias("chunk_id"))
    n = table(spark, d, "customer").select(F.col("c_nationkey").alias("query_id"), F.lower("c_mktsegment").alias("name"))
    found = lexical.symbol_channel(c, n).join(c, "chunk_id")
    return found.groupBy("query_id").agg(F.sum("hits").alias("hits"), F.min("chunk_id").alias("first_chunk"), F.max("score").alias("score"))


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return dense.dense_search(vectors(spark, d), vector_queries(spark, d), K).select("query_id", "chunk_id", "score")


def dense_label_filter(spark: SparkSession, d: str) -> DataFrame:
    return dense.dense_search(vectors(spark, d), vector_queries(spark, d), K, where="label = 3").select("query_id", "chunk_id", "score")


def dense_allowlist_semi(spark: SparkSession, d: str) -> DataFrame:
    allowed = chunks(spark, d).where("entity_type = 'en'").select("chunk_id")
    return dense.dense_search(vectors(spark, d), vector_queries(spark, d), K, allowed=allowed).select("query_id", "chunk_id", "score")


def dense_quantized(spark: SparkSession, d: str) -> DataFrame:
    q = dense.quantized(vectors(spark, d))
    return q.select("chunk_id", F.round("scale", 9).alias("scale"), F.array_join(F.transform("codes", lambda x: x.cast("string")), ",").alias("codes"))


def dense_approximate(spark: SparkSession, d: str) -> DataFrame:
    return dense.approximate_search(vectors(spark, d), vector_queries(spark, d), K).select("query_id", "chunk_id", "score")


def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select("chunk_id", F.round(dense.norm(F.col("embedding")), 6).alias("norm"))


def vector_pad8(spark: SparkSession, d: str) -> DataFrame:
    p = dense.pad(F.concat("embedding", F.array(F.lit(1.0).cast("float"))))
    return vectors(spark, d).select("chunk_id", F.size(p).cast("long").alias("dim"), F.round(dense.norm(p), 6).alias("norm"))


def pca_2d(spark: SparkSession, d: str) -> DataFrame:
    return dense.project_2d(table(spark, d, "embeddings"))


def _sparse(spark: SparkSession, d: str, k: int = K * 3) -> DataFrame:
    return index.search(stored_postings(spark, d), asked(spark, d), k).select("query_id", F.lit("sparse").alias("source"), "chunk_id", "score", "rank")


def _wiki(spark: SparkSession, d: str, k: int = K * 2) -> DataFrame:
    return lexical.overlap_channel(chunks(spark, d), asked(spark, d), k=k).select("query_id", F.lit("wiki").alias("source"), "chunk_id", "score", "rank")


def _fused(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rrf(_sparse(spark, d).unionByName(_wiki(spark, d)), {"sparse": 0.25, "wiki": 0.15})


def rrf_two_lists(spark: SparkSession, d: str) -> DataFrame:
    return fusion.final_cut(_fused(spark, d), K).select("query_id", "chunk_id", "score", "sources")


def _neighbors(spark: SparkSession, d: str) -> DataFrame:
    """The graph channel: the chunk that follows a sparse hit in its file and language, at a score by the best such hit."""
    following = F.lead("chunk_id").over(Window.partitionBy("file_path", "entity_type").orderBy("chunk_id"))
    edges = chunks(spark, d).select("chunk_id", following.alias("next")).where("next is not null")
    hit = small(_sparse(spark, d, K)).join(edges, "chunk_id")
    return hit.groupBy("query_id", F.col("next").alias("chunk_id")).agg(F.round(F.max("score") * 0.8, 6).alias("score"))


def rrf_graph_boost(spark: SparkSession, d: str) -> DataFrame:
    return fusion.final_cut(fusion.graph_boost(_fused(spark, d), _neighbors(spark, d)), K).select("query_id", "chunk_id", "score")


def _candidates(spark: SparkSession, d: str, k: int = 2 * K) -> DataFrame:
    """Sparse hits with a deterministic stand-in for a model's score: the Jaccard similarity of the token sets."""
    c, q = chunks(spark, d), asked(spark, d)
    rows = small(_sparse(spark, d, k).drop("source")).join(c, "chunk_id").join(q, "query_id")
    return rows.withColumn("model_score", F.round(jaccard(F.array_distinct(tokenize("content")), F.array_distinct(tokenize("query"))), 9))


def model_scores(spark: SparkSession, d: str) -> DataFrame:
    """``query_id, chunk_id, model_score`` for the sparse hits, by the stand-in for a model."""
    return materialize(_candidates(spark, d, 3 * K).select("query_id", "chunk_id", "model_score"), "scores")


def minmax_blend_rerank(spark: SparkSession, d: str) -> DataFrame:
    return fusion.blend_rerank(_candidates(spark, d), 0.4).select("query_id", "chunk_id", F.round("reranked", 6).alias("reranked"))


def gate_rerank(spark: SparkSession, d: str) -> DataFrame:
    return fusion.gate_rerank(_candidates(spark, d), 0.05).select("query_id", "chunk_id", F.round("reranked", 6).alias("reranked"))


def lexical_boost(spark: SparkSession, d: str) -> DataFrame:
    rows = _candidates(spark, d).withColumn("entity_name", F.col("file_path")).withColumn("docstring", F.lit("")).withColumn("entity_type", F.when(F.col("entity_type") == "en", "function").when(F.col("entity_type") == "fr", "class").otherwise("file"))
    return lexical.lexical_boost(rows).select("query_id", "chunk_id", F.round("boosted", 6).alias("boosted"))


def per_file_cap(spark: SparkSession, d: str) -> DataFrame:
    return fusion.per_file_cap(_candidates(spark, d), 2).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    rows = _candidates(spark, d)
    return rows.select("query_id", "chunk_id", "score", "file_path", "entity_type", F.col("file_path").alias("entity_name"), (F.col("chunk_id") % 97).cast("int").alias("start_line"), (F.col("chunk_id") % 97 + F.size(F.split("content", "\n"))).cast("int").alias("end_line"), "content", "rank")


def range_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return packing.range_dedupe(_lines(spark, d).drop("content", "rank")).select("query_id", "chunk_id", "pick")


def mmr_select(spark: SparkSession, d: str) -> DataFrame:
    return packing.mmr_select(_lines(spark, d).drop("content", "rank")).select("query_id", "chunk_id", "pick")


def pack_full(spark: SparkSession, d: str) -> DataFrame:
    return packing.full_pack(_lines(spark, d).select("query_id", "chunk_id", "file_path", "start_line", "content"), 2048)


def pack_lite_preview(spark: SparkSession, d: str) -> DataFrame:
    p = packing.preview(F.col("content"))
    return chunks(spark, d).select("chunk_id", F.md5(p.cast("binary")).alias("preview_md5"), F.length(p).cast("long").alias("n_chars"))


def pack_running_budget(spark: SparkSession, d: str) -> DataFrame:
    rows = _lines(spark, d).withColumn("tokens", token_estimate(F.col("content")))
    return packing.running_budget(rows, 4096).select("query_id", "chunk_id", "tokens", "used", "stub")


QUERIES = {
    f.__name__: f
    for f in (
        bm25_topk, tokenize_counts, postings_tf, doc_freq, doc_len_stats, ident_split_tokens, bm25_idf, overlap_channel, symbol_channel, dense_topk,
        dense_label_filter, dense_allowlist_semi, dense_quantized, dense_approximate, vector_norms, vector_pad8, pca_2d, rrf_two_lists, rrf_graph_boost,
        minmax_blend_rerank, gate_rerank, lexical_boost, per_file_cap, range_dedupe, mmr_select, pack_full, pack_lite_preview, pack_running_budget,
    )
}


def _tok(name: str, key: str, table_name: str, col: str = "text") -> str:
    return f"{name} AS (SELECT {key}, unnest(list_transform(regexp_extract_all({col}, '[A-Za-z0-9_]+'), lambda t: lower(t))) AS term FROM {table_name})"


_BM25 = f"""
{_tok("tok", "doc_id AS chunk_id", "documents")},
{_tok("qtok", "item_id AS query_id", "benchmark")},
p AS (SELECT chunk_id, term, count(*) AS tf FROM tok GROUP BY ALL),
st AS (SELECT d.doc_id AS chunk_id, len(regexp_extract_all(text, '[A-Za-z0-9_]+'))::BIGINT AS dl FROM documents d),
n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM st),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
i0 AS (SELECT term, df, ln((n.n - df + 0.5) / (df + 0.5)) AS idf FROM df, n),
i AS (SELECT term, df, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM i0) ELSE idf END AS idf FROM i0),
qt AS (SELECT query_id, term, count(*) AS qtf FROM qtok GROUP BY ALL),
raw AS (SELECT query_id, chunk_id, sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS raw
        FROM p JOIN qt USING (term) JOIN i USING (term) JOIN st USING (chunk_id), n GROUP BY ALL),
sq AS (SELECT query_id, chunk_id, round(1 / (1 + exp(-raw / 5)), 6) AS score FROM raw WHERE raw > 0),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM sq)"""

_OVERLAP = f"""
own AS (SELECT DISTINCT chunk_id, term FROM tok),
aq AS (SELECT DISTINCT query_id, term FROM qtok),
nq AS (SELECT query_id, count(*) AS n FROM aq GROUP BY query_id),
sh AS (SELECT query_id, chunk_id, count(*) AS m FROM own JOIN aq USING (term) GROUP BY ALL),
ov AS (SELECT query_id, chunk_id, round(least(0.9::DOUBLE, 0.25::DOUBLE + 0.65::DOUBLE * m / n), 6) AS score FROM sh JOIN nq USING (query_id)),
ork AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM ov)"""

_FUSED = """
l AS (SELECT query_id, 'sparse' AS source, chunk_id, rank, 0.25::DOUBLE AS w FROM rk WHERE rank < 30 UNION ALL
      SELECT query_id, 'wiki', chunk_id, rank, 0.15::DOUBLE FROM ork WHERE rank < 20),
f AS (SELECT query_id, chunk_id, sum(w / (60 + rank + 1)) AS score, string_agg(source, ',' ORDER BY source) AS sources FROM l GROUP BY ALL)"""

_CAND = """
dt AS (SELECT chunk_id, list(DISTINCT term) AS s FROM tok GROUP BY chunk_id),
qs AS (SELECT query_id, list(DISTINCT term) AS s FROM qtok GROUP BY query_id),
cand AS (SELECT rk.query_id, rk.chunk_id, rk.score, rk.rank, d.text AS content, d.source AS file_path, d.lang AS entity_type, b.text AS query,
  round(len(list_intersect(dt.s, qs.s)) / len(list_distinct(list_concat(dt.s, qs.s)))::DOUBLE, 9) AS model_score
  FROM rk JOIN documents d ON d.doc_id = rk.chunk_id JOIN benchmark b ON b.item_id = rk.query_id JOIN dt USING (chunk_id) JOIN qs USING (query_id)
  WHERE rk.rank < 20)"""


def _dense(where: str = "true") -> str:
    return f"""
WITH q AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id AS chunk_id, round(list_cosine_similarity(embedding::DOUBLE[], qe::DOUBLE[]), 6) AS score FROM q, embeddings WHERE {where})
SELECT query_id, chunk_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= {K}"""


ORACLES = {
    "tokenize_counts": "SELECT doc_id AS chunk_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_terms FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda t: lower(t)) AS t FROM documents)",
    "ident_split_tokens": r"""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+') AS x FROM documents)
SELECT doc_id AS chunk_id, array_to_string(flatten(list_transform(x, lambda t: list_concat([lower(t)], list_filter(string_split_regex(lower(regexp_replace(regexp_replace(t, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g')), '_+'),
  lambda p: p <> '' AND p <> lower(t))))), ' ') AS tokens FROM t""",
    "dense_quantized": """WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_max(list_transform(embedding, lambda x: abs(x)::DOUBLE)) AS m FROM embeddings), q AS (SELECT *, CASE WHEN m > 0 THEN m / 127 ELSE 1.0 END AS c FROM s)
SELECT vec_id AS chunk_id, round(c, 9) AS scale, array_to_string(list_transform(e, lambda x: round(x / c)::INT), ',') AS codes FROM q""",
    "postings_tf": f"WITH {_BM25} SELECT chunk_id, term, tf FROM p",
    "doc_freq": f"WITH {_BM25} SELECT term, df FROM df",
    "doc_len_stats": f"WITH {_BM25} SELECT count(*) AS n, round(avg(dl), 6) AS avgdl, max(dl) AS longest FROM st",
    "bm25_topk": f"WITH {_BM25} SELECT query_id, chunk_id, score, rank FROM rk WHERE rank < {K}",
    "bm25_idf": f"WITH {_BM25} SELECT term, df, round(idf, 6) AS idf FROM i",
    "overlap_channel": f"WITH {_BM25}, {_OVERLAP} SELECT query_id, chunk_id, score FROM ork WHERE rank < {K}",
    "symbol_channel": """WITH n AS (SELECT DISTINCT c_nationkey AS query_id, lower(c_mktsegment) AS name FROM customer)
SELECT query_id, count(*) AS hits, min(c_custkey) AS first_chunk, 0.9::DOUBLE AS score FROM customer JOIN n ON lower(c_mktsegment) = name GROUP BY query_id""",
    "dense_topk": _dense(),
    "dense_label_filter": _dense("label = 3"),
    "dense_allowlist_semi": _dense("vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en')"),
    "vector_norms": "SELECT vec_id AS chunk_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings",
    "vector_pad8": "SELECT vec_id AS chunk_id, 72::BIGINT AS dim, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) + 1), 6) AS norm FROM embeddings",
    "rrf_two_lists": f"WITH {_BM25}, {_OVERLAP}, {_FUSED}, r AS (SELECT query_id, chunk_id, round(score, 6) AS score, sources FROM f) SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= {K}",
    "rrf_graph_boost": f"""WITH {_BM25}, {_OVERLAP}, {_FUSED},
nx AS (SELECT doc_id, lead(doc_id) OVER (PARTITION BY source, lang ORDER BY doc_id) AS nxt FROM documents),
g AS (SELECT query_id, nxt AS chunk_id, round(max(score) * 0.8::DOUBLE, 6) AS g FROM rk JOIN nx ON doc_id = chunk_id WHERE rank < {K} AND nxt IS NOT NULL GROUP BY ALL),
m AS (SELECT query_id, max(score) AS m FROM f GROUP BY query_id),
u AS (SELECT coalesce(f.query_id, g.query_id) AS query_id, coalesce(f.chunk_id, g.chunk_id) AS chunk_id, f.score, g.g FROM f FULL JOIN g ON f.query_id = g.query_id AND f.chunk_id = g.chunk_id),
b AS (SELECT u.query_id, u.chunk_id, round(coalesce(u.score + CASE WHEN g IS NOT NULL THEN 0.2::DOUBLE * greatest(coalesce(m, 0), 0.1::DOUBLE) ELSE 0 END, g * coalesce(m, 0)), 6) AS score FROM u LEFT JOIN m USING (query_id))
SELECT query_id, chunk_id, score FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= {K}""",
    "minmax_blend_rerank": f"""WITH {_BM25}, {_CAND},
s AS (SELECT *, min(model_score) OVER q AS ml, max(model_score) OVER q AS mh, min(score) OVER q AS sl, max(score) OVER q AS sh FROM cand WINDOW q AS (PARTITION BY query_id))
SELECT query_id, chunk_id, round(0.4::DOUBLE * CASE WHEN mh - ml < 1e-12 THEN 0.5 ELSE (model_score - ml) / (mh - ml) END + (1 - 0.4::DOUBLE) * CASE WHEN sh - sl < 1e-12 THEN 0.5 ELSE (score - sl) / (sh - sl) END, 6) AS reranked FROM s""",
    "gate_rerank": f"""WITH {_BM25}, {_CAND},
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY model_score DESC, chunk_id) AS n FROM cand),
g AS (SELECT query_id, max(CASE WHEN n = 1 THEN model_score END) - max(CASE WHEN n = 2 THEN model_score END) AS lead FROM o GROUP BY query_id)
SELECT query_id, chunk_id, round(CASE WHEN coalesce(lead, 1e9) >= 0.05::DOUBLE THEN model_score ELSE score END, 6) AS reranked FROM cand JOIN g USING (query_id)""",
    "lexical_boost": f"""WITH {_BM25}, {_CAND},
w AS (SELECT *, list_filter(list_distinct(regexp_split_to_array(lower(query), '[ \\t\\n\\r]+')), lambda x: x <> '') AS ws FROM cand)
SELECT query_id, chunk_id, round(greatest(score + 0.05::DOUBLE * len(list_filter(ws, lambda x: contains(lower(content), x))) + CASE WHEN len(list_filter(ws, lambda x: contains(lower(file_path), x))) > 0 THEN 0.2::DOUBLE ELSE 0 END
  + CASE entity_type WHEN 'en' THEN 0.15::DOUBLE WHEN 'fr' THEN 0.1::DOUBLE ELSE -0.1::DOUBLE END, 0), 6) AS boosted FROM w""",
    "per_file_cap": f"WITH {_BM25}, {_CAND} SELECT query_id, chunk_id, rank FROM cand QUALIFY row_number() OVER (PARTITION BY query_id, file_path ORDER BY rank) <= 2",
    "pack_lite_preview": """WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS x FROM documents), n AS (SELECT *, len(x) AS n FROM l),
v AS (SELECT doc_id, CASE WHEN n > 20 AND (n > 28 OR length(text) > 448)
  THEN array_to_string(x[1:12], chr(10)) || chr(10) || '... ' || (n - 20) || ' lines omitted ...' || chr(10) || array_to_string(x[n-7:n], chr(10)) ELSE text END AS p FROM n)
SELECT doc_id AS chunk_id, md5(p) AS preview_md5, length(p)::BIGINT AS n_chars FROM v""",
    "pack_running_budget": f"""WITH {_BM25}, {_CAND}, t AS (SELECT query_id, chunk_id, rank, (length(content) // 4)::BIGINT AS tokens FROM cand),
u AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank)::BIGINT AS used FROM t)
SELECT query_id, chunk_id, tokens, used, max((used > 4096)::INT) OVER (PARTITION BY query_id ORDER BY rank) = 1 AS stub FROM u""",
}
