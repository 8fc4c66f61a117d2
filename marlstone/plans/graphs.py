"""Catalogue: the typed property graph of the foreign keys, links between sources, and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.text import tokenize
from marlstone.operators import graph
from marlstone.plans.tables import chunks, edge_rows, edges, edges_sql, table


def graph_edges_dedupe_last(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    both = e.unionByName(e.where("relationship = 'contains'").withColumn("relationship", F.lit("inherits")).withColumn("seq", F.col("seq") + 100))
    return graph.last_wins(both)


def graph_incident(spark: SparkSession, d: str) -> DataFrame:
    return graph.incident(edges(spark, d)).groupBy("node").agg(F.count("*").alias("n"), F.count_if("incoming").alias("incoming"))


def graph_degree_topn(spark: SparkSession, d: str) -> DataFrame:
    return graph.top_degree(edges(spark, d), 40)


def graph_bfs_depth2(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return graph.bfs(e, e.select(F.col("src").alias("entity_id")).distinct(), 2).withColumn("hops", F.col("hops").cast("long"))


def graph_shortest_path(spark: SparkSession, d: str) -> DataFrame:
    """From every node with an edge to one region, over all edges."""
    e = edge_rows(spark, d)
    pairs = e.select(F.col("src").alias("start")).distinct().withColumn("goal", F.lit("region:1"))
    return graph.shortest_path(e, pairs).withColumn("hops", F.col("hops").cast("long"))


def graph_beam(spark: SparkSession, d: str) -> DataFrame:
    """A beam from every node that an edge leaves."""
    e = edges(spark, d)
    seeds = e.select(F.col("src").alias("query_id"), F.col("src").alias("entity_id"), F.lit(1.0).alias("score")).distinct()
    return graph.expand_beam(e, seeds, 6, 2, 6).withColumn("score", F.round("score", 6))


def entity_summary(spark: SparkSession, d: str) -> DataFrame:
    return graph.entity_summary(edges(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def _terms(spark: SparkSession, d: str) -> DataFrame:
    """Capitalised terms stand for imports, tokens with digits for exports."""
    rows = chunks(spark, d).select(F.col("file_path").alias("repo"), F.explode(F.regexp_extract_all("content", F.lit("([A-Za-z0-9_]+)"), F.lit(1))).alias("name"))
    return rows.where(F.length("name") >= 8).distinct()


def cross_repo_shared(spark: SparkSession, d: str) -> DataFrame:
    return graph.shared_between(_terms(spark, d).where(F.regexp("name", F.lit("^[A-Z]"))), "repo", "name")


def cross_repo_depends_on(spark: SparkSession, d: str) -> DataFrame:
    t = _terms(spark, d)
    return graph.depends_on(t.where(F.regexp("name", F.lit("^[A-Z]"))).select("repo", F.lower("name").alias("name")), t.where(F.regexp("name", F.lit("^[a-z]"))))


def unique_name_links(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    links = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    names = graph.unique_names(table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(tokenize("text"))).alias("t")), "t", "doc_id")
    own = links.select("page_id", F.lower(F.regexp_replace("href", "^/", "")).alias("name")).distinct()
    return own.join(names, "name").select("page_id", "name", F.col("target").alias("doc_id"))


def page_links(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    return p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href")).groupBy("href").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"))


QUERIES = {
    f.__name__: f
    for f in (
        graph_edges_dedupe_last, graph_incident, graph_degree_topn, graph_bfs_depth2, graph_shortest_path, graph_beam, entity_summary, cross_repo_shared,
        cross_repo_depends_on, unique_name_links, page_links,
    )
}

_E = f"e AS ({edges_sql()})"
_B = "b AS (SELECT src AS node, dst AS other, false AS incoming FROM e UNION ALL SELECT dst, src, true FROM e)"
_T = "t AS (SELECT DISTINCT repo, name FROM (SELECT source AS repo, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS name FROM documents) WHERE length(name) >= 8)"

ORACLES = {
    "graph_edges_dedupe_last": f"WITH {_E} SELECT src, dst, CASE relationship WHEN 'contains' THEN 'inherits' ELSE arg_max(relationship, seq) END AS relationship FROM e GROUP BY src, dst, relationship QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY max(seq) DESC) = 1",
    "graph_incident": f"WITH {_E}, {_B} SELECT node, count(*) AS n, count(*) FILTER (incoming) AS incoming FROM b GROUP BY node",
    "graph_degree_topn": f"WITH {_E}, {_B} SELECT node, count(*) AS degree FROM b GROUP BY node ORDER BY degree DESC, node LIMIT 40",
    "graph_bfs_depth2": f"""WITH RECURSIVE {_E}, w AS (SELECT DISTINCT src AS seed, src AS node, 0 AS hops FROM e UNION SELECT w.seed, e.dst, hops + 1 FROM w JOIN e ON e.src = w.node WHERE hops < 2)
SELECT seed, node, min(hops)::BIGINT AS hops FROM w GROUP BY ALL HAVING min(hops) > 0""",
    "graph_shortest_path": f"""WITH {_E}, p1 AS (SELECT src, src || '>' || dst AS path, 1 AS hops FROM e WHERE dst = 'region:1'),
p2 AS (SELECT e.src, min(e.src || '>' || p.path) AS path, 2 AS hops FROM e JOIN p1 p ON e.dst = p.src GROUP BY e.src), p3 AS (SELECT e.src, min(e.src || '>' || p.path) AS path, 3 AS hops FROM e JOIN p2 p ON e.dst = p.src GROUP BY e.src),
u AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3) SELECT src AS start, 'region:1' AS goal, min(hops)::BIGINT AS hops, arg_min(path, hops) AS path FROM u GROUP BY src""",
    "entity_summary": f"""WITH {_E}, r AS (SELECT DISTINCT dst AS node, src AS o FROM e), n AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY o) AS k FROM r)
SELECT node, string_agg(o, ',' ORDER BY o) FILTER (k <= 10) AS neighbors, count(*) AS n FROM n GROUP BY node""",
    "cross_repo_shared": f"WITH {_T} SELECT x.repo AS a, y.repo AS b, count(*) AS n FROM t x JOIN t y ON x.name = y.name AND x.repo < y.repo WHERE regexp_matches(x.name, '^[A-Z]') GROUP BY ALL",
    "cross_repo_depends_on": f"""WITH {_T}, i AS (SELECT DISTINCT repo, lower(name) AS name FROM t WHERE regexp_matches(name, '^[A-Z]'))
SELECT i.repo AS src, t.repo AS dst, count(*) AS n FROM i JOIN t ON i.name = t.name AND i.repo <> t.repo WHERE regexp_matches(t.name, '^[a-z]') GROUP BY ALL""",
    "unique_name_links": """WITH k AS (SELECT DISTINCT doc_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda t: lower(t))) AS name FROM documents),
u AS (SELECT name, min(doc_id) AS doc_id FROM k GROUP BY name HAVING count(DISTINCT doc_id) = 1),
l AS (SELECT DISTINCT page_id, lower(regexp_replace(href, '^/', '')) AS name FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages))
SELECT page_id, name, doc_id FROM l JOIN u USING (name)""",
    "page_links": """SELECT href, count(*) AS n, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) GROUP BY href""",
}
