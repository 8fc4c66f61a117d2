"""Catalogue: what chunks say about themselves, vault pages, tool pairs, caches, low-bit search, rewriting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import cache, doctor, golden, graph, log, prefix, vault
from marlstone.operators import chunks as own
from marlstone.operators import vectors as dense
from marlstone.plans.tables import asked, chunks, edges, edges_sql, table, vector_queries, vectors
from marlstone.scratch import scratch
from marlstone.sources import stores

K = 10


def _functions(spark: SparkSession, d: str) -> DataFrame:
    """Documents as functions, classes and files, some with parameters, doc strings and commands."""
    i = F.col("doc_id")
    s = lambda c: c.cast("string")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("function", "class", "file", "method")]), (i % 4 + 1).cast("int"))
    params = F.when(i % 3 == 0, F.array(F.lit("a"), F.concat(F.lit("b"), s(i % 5))))
    bases = F.when(i % 5 == 0, F.array(F.lit("Base")))
    name = F.when(i % 11 == 0, F.lit("")).when(i % 7 == 0, F.concat(F.lit("cmd_run_"), s(i % 30))).otherwise(F.concat(F.lit("f"), s(i)))
    doc = F.when(i % 2 == 0, F.concat(F.lit("Does step "), s(i), F.lit(". And more.\n\nDetails."))).otherwise("")
    content = F.when(i % 6 == 1, F.concat(F.lit('def g():\n    """Quoted '), s(i), F.lit('"""'))).when(i % 6 == 3, F.concat(F.lit("sub.add_parser('run-"), s(i % 30), F.lit("', help='Runs "), s(i % 30), F.lit("')"))).otherwise(F.col("text"))
    return table(spark, d, "documents").select(
        i.alias("chunk_id"), kind.alias("kind"), name.alias("entity_name"), params.alias("params"), bases.alias("bases"), doc.alias("docstring"), content.alias("content"), F.concat("source", F.lit("/"), "lang", F.lit(".py")).alias("file_path"),
        F.concat(F.lit("e:"), s(i)).alias("entity_id"),
    )


def chunk_signatures(spark: SparkSession, d: str) -> DataFrame:
    c = [F.col(x) for x in ("kind", "entity_name", "params", "bases", "content", "file_path")]
    return _functions(spark, d).select("chunk_id", own.signature(*c).alias("signature"))


def chunk_previews(spark: SparkSession, d: str) -> DataFrame:
    return _functions(spark, d).where("chunk_id % 6 in (0, 1, 2, 3, 4)").select("chunk_id", own.doc_preview(F.col("docstring"), F.col("content")).alias("preview"))


def chunk_file_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", own.safe_name(F.col("url")).alias("name"))


def command_catalog(spark: SparkSession, d: str) -> DataFrame:
    return own.command_catalog(_functions(spark, d))


def command_docs(spark: SparkSession, d: str) -> DataFrame:
    return own.command_docs(_functions(spark, d)).select("chunk_id", "content", "entity_name", "file_path")


def index_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = _functions(spark, d)
    return own.index_text(rows, own.command_catalog(rows)).select("chunk_id", F.md5(F.col("content").cast("binary")).alias("content_md5"))


def asked_commands(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("item_id").cast("string")
    text = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("Where is the cli run-"), n)).otherwise(F.concat(F.lit("what is the sync"), n, F.lit(" command")))
    return table(spark, d, "benchmark").select("item_id", F.array_join(own.asked_commands(text), ",").alias("names"))


def memory_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("title"), F.col("props").alias("body"), F.when(F.col("event_id") % 3 == 0, F.array(F.lit("a.py:f"), F.lit("b.py:g"))).otherwise(F.array().cast("array<string>")).alias("links"),
        F.concat(F.lit("knowledge/memory/fact/"), F.col("event_id").cast("string"), F.lit(".md")).alias("path"),
    )
    return own.memory_chunks(rows).select("chunk_id", "content", "file_path", F.col("end_line").cast("long").alias("end_line"))


def union_first(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d).select((F.col("chunk_id") % 50).alias("query_id"), "chunk_id", "label")
    a, b = v.where("chunk_id % 2 = 0").withColumn("list", F.lit("a")), v.where("chunk_id % 3 = 0").withColumn("list", F.lit("b"))
    return own.union_first([a, b])


def linked_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = _functions(spark, d).where("entity_name <> ''").select("chunk_id", "file_path", F.col("entity_name"))
    i = F.col("doc_id")
    packed = table(spark, d, "documents").where("doc_id % 4 = 1").select(i.alias("query_id"), i.alias("chunk_id"), F.concat(F.lit("see "), "source", F.lit("/"), "lang", F.lit(".py:F"), (i + 1).cast("string"), F.lit(" and "), "source", F.lit("/"), "lang", F.lit(".py:f"), i.cast("string")).alias("content"))
    return own.linked_chunks(packed, rows)


def expansions(spark: SparkSession, d: str) -> DataFrame:
    wanted = asked(spark, d).select("query_id", F.explode(F.array(F.col("query_id"), F.col("query_id") - 1_000_000)).alias("chunk_id"))
    out = own.expansions(wanted, chunks(spark, d))
    return out.select("query_id", "chunk_id", F.md5(F.col("block").cast("binary")).alias("block_md5"))


def vault_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark texts against documents as vault pages."""
    i = F.col("doc_id")
    folder = F.element_at(F.array(*[F.lit(x) for x in ("knowledge/wiki/", "knowledge/memory/", "knowledge/gloss/", "notes/")]), (i % 4 + 1).cast("int"))
    pages = table(spark, d, "documents").select(F.concat(folder, i.cast("string"), F.lit(".md")).alias("path"), F.substring("text", 1, 40).alias("title"), F.col("source").alias("description"), F.array("lang").alias("tags"), F.col("text").alias("body"))
    return vault.rank_pages(pages, asked(spark, d), K).select("query_id", "path", "score")


def _tools(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("turn")
    kind = F.when(F.col("role") == "user", "tool_use").when(F.col("role") == "assistant", "tool_result").otherwise("system")
    e = lambda n: F.concat(F.lit("e"), n.cast("string"))
    return table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), t.alias("seq"), e(t).alias("id"), kind.alias("type"), F.when(kind == "tool_use", F.concat(F.lit("tool"), (t % 3).cast("string"))).alias("tool_name"), F.when(t % 5 == 0, e(t - 3)).alias("tool_use_id"))


def tool_pairs(spark: SparkSession, d: str) -> DataFrame:
    return log.tool_pairs(_tools(spark, d))


def log_kinds(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "click", "user").alias("type"), F.when(F.col("event_id") % 2 == 0, 1).alias("v"), F.when(F.col("event_type") == "purchase", "turn").alias("event"))
    return log.log_kinds(e)


def cache_rates(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    e = table(spark, d, "events").select("event_type", (i % 3 == 0).alias("hit"), F.when(i % 2 == 0, i % 4 == 0).alias("verified"), (i % 5).alias("citations"), F.when(i % 5 > 0, (i % 2)).otherwise(0).alias("invalid"))
    r = cache.rates(e, "event_type")
    return r.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("hit_rate", "verify_rate", "invalid_rate")])


def cache_live(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select(F.concat(F.lit("r"), (F.col("page_id") % 7).cast("string")).alias("repo"), (F.col("page_id") % 4).alias("epoch"), "page_id")
    return cache.live_entries(p, p.where("page_id % 9 = 0").select("repo", "epoch"))


def dense_low_bit(spark: SparkSession, d: str) -> DataFrame:
    return dense.low_bit_search(vectors(spark, d), vector_queries(spark, d), K, 4).select("query_id", "chunk_id", "score")


def package_counts(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    return graph.by_package(table(spark, d, "documents").select(F.when(i % 9 == 0, F.lit("top.py")).otherwise(F.concat("source", F.lit("/"), "lang", F.lit("/m.py"))).alias("file_path"), F.when(i % 2 == 0, "class").otherwise("function").alias("type"), i.alias("entity_id")))


def query_rewrites(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("item_id").cast("string")
    text = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("please trace load_item_"), n)).when(F.col("item_id") % 3 == 1, F.concat(F.lit("load_item_"), n)).otherwise(F.lit("plain words"))
    q = table(spark, d, "benchmark").select("item_id", text.alias("q"), F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt"), F.when(F.col("item_id") % 5 == 0, "graph").otherwise("hybrid").alias("mode"))
    r = q.select("item_id", F.col("attempt").cast("long").alias("attempt"), golden.rewrite(F.col("q"), F.col("attempt"), F.col("mode")).alias("r"))
    return r.select("item_id", "attempt", "r.query", "r.action")


def _sections(spark: SparkSession, d: str, now: bool = False) -> DataFrame:
    i = F.col("page_id")
    text = lambda name, m: F.when(i % m != 0, F.concat(F.lit(f"{name} of "), i.cast("string"), F.lit("\n"))).otherwise("")
    parts = [("knowledge_prefix", text("pages", 3)), ("system", text("rules", 5)), ("tools", F.when((i % 4 == 0) & F.lit(now), F.lit("new tools")).otherwise(text("tools", 2))), ("other", F.lit("left out"))]
    rows = table(spark, d, "pages").select(i, F.explode(F.array(*[F.struct(F.lit(n).alias("section"), t.alias("text")) for n, t in parts])).alias("s"))
    return rows.select("page_id", "s.section", "s.text")


def prefix_digests(spark: SparkSession, d: str) -> DataFrame:
    return prefix.assemble(_sections(spark, d), "page_id")


def prefix_changes(spark: SparkSession, d: str) -> DataFrame:
    return prefix.changed(_sections(spark, d), _sections(spark, d, True), "page_id")


def stored_graph(spark: SparkSession, d: str) -> DataFrame:
    """The foreign-key graph saved and read back, its degrees by relationship."""
    e = edges(spark, d)
    path = scratch(spark, "graph")
    stores.save_graph(e.select(F.col("src").alias("entity_id")).distinct(), e, path)
    _, back = stores.load_graph(spark, path)
    return back.groupBy("relationship").agg(F.count("*").alias("n"), F.count_distinct("src").alias("origins"))


def health(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    ids = e.select(F.col("src").alias("entity_id"))
    v = vectors(spark, d).withColumn("model", F.lit("m"))
    checks = {
        "python": doctor.python_version, "packages": doctor.packages, "edges": lambda: doctor.edge_ends(ids.unionByName(e.select(F.col("dst").alias("entity_id"))), e), "model": lambda: doctor.one_model(v, "m"),
        "other model": lambda: doctor.one_model(v, "x"), "index": lambda: doctor.stored_index(spark, scratch(spark, "none")), "broken": lambda: doctor.one_model(e),
    }
    return doctor.run_checks(spark, checks).select("name", "status")


QUERIES = {
    f.__name__: f
    for f in (
        chunk_signatures, chunk_previews, chunk_file_names, command_catalog, command_docs, index_texts, asked_commands, memory_chunks, union_first, linked_chunks, expansions, vault_ranking, tool_pairs,
        log_kinds, cache_rates, cache_live, dense_low_bit, package_counts, query_rewrites, prefix_digests, prefix_changes, stored_graph, health,
    )
}

_FN = """fn AS (SELECT doc_id AS i, (['function', 'class', 'file', 'method'])[doc_id % 4 + 1] AS kind, source || '/' || lang || '.py' AS path, text,
  CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 7 = 0 THEN 'cmd_run_' || doc_id % 30 ELSE 'f' || doc_id END AS name,
  CASE doc_id % 6 WHEN 1 THEN 'def g():' || chr(10) || '    \"\"\"Quoted ' || doc_id || '\"\"\"' WHEN 3 THEN 'sub.add_parser(''run-' || doc_id % 30 || ''', help=''Runs ' || doc_id % 30 || ''')' ELSE text END AS content FROM documents)"""
_CAT = """cat AS (SELECT DISTINCT path AS file_path, 'cmd_run_' || i % 30 AS handler, 'run-' || i % 30 AS command, 'Runs ' || i % 30 AS help FROM fn WHERE i % 6 = 3)"""
_BITS = """WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_max(list_transform(embedding, lambda x: abs(x)::DOUBLE)) AS m FROM embeddings),
c AS (SELECT vec_id, list_transform(e, lambda x: round(x / CASE WHEN m > 0 THEN m / 7 ELSE 1.0 END)::DOUBLE) AS c FROM s),
r AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_cosine_similarity(c.c, q.embedding::DOUBLE[]), 6) AS score FROM embeddings q, c WHERE q.vec_id % 20 = 0)"""

ORACLES = {
    "chunk_signatures": f"""WITH {_FN}, l AS (SELECT *, substr(trim(string_split(content, chr(10))[1]), 1, 200) AS line FROM fn)
SELECT i AS chunk_id, CASE WHEN kind IN ('function', 'method') THEN CASE WHEN i % 3 = 0 THEN name || '(a, b' || i % 5 || ')' WHEN line <> '' THEN line ELSE name END
  WHEN kind = 'class' THEN CASE WHEN i % 5 = 0 THEN name || '(Base)' WHEN name <> '' THEN name ELSE line END WHEN name <> '' THEN name ELSE path END AS signature FROM l""",
    "chunk_previews": f"WITH {_FN} SELECT i AS chunk_id, CASE WHEN i % 2 = 0 THEN 'Does step ' || i || '.' WHEN i % 6 = 1 THEN 'Quoted ' || i ELSE '' END AS preview FROM fn WHERE i % 6 <= 4",
    "chunk_file_names": r"SELECT page_id, substr(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), 1, 120) || '.' || substr(sha1(url), 1, 10) AS name FROM pages",
    "command_catalog": f"WITH {_FN}, {_CAT} SELECT * FROM cat",
    "command_docs": f"""WITH {_FN}, {_CAT}, r AS (SELECT name AS handler, min(i) AS i, arg_min(path, i) AS path FROM fn GROUP BY name), c AS (SELECT DISTINCT handler, command, help FROM cat)
SELECT 'e:' || i || ':cli-doc' AS chunk_id, 'The ' || command || ' CLI command is defined as ' || handler || ' in ' || path || '. argparse add_parser(''' || command || ''').' || ' Help: ' || help || '.' AS content, handler AS entity_name, path AS file_path
FROM c JOIN r USING (handler)""",
    "index_texts": f"""WITH {_FN}, {_CAT}, c AS (SELECT DISTINCT handler, command, help FROM cat)
SELECT i AS chunk_id, md5(CASE WHEN handler IS NULL THEN content ELSE 'CLI command ' || command || '. Handler ' || handler || '. Help: ' || help || '.' || chr(10) || content END) AS content_md5 FROM fn LEFT JOIN c ON c.handler = fn.name""",
    "asked_commands": "SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'cmd_run_' || item_id ELSE 'cmd_sync' || item_id END AS names FROM benchmark",
    "memory_chunks": r"""WITH c AS (SELECT event_id, regexp_replace(event_type || chr(10) || chr(10) || coalesce(props, '') || CASE WHEN event_id % 3 = 0 THEN chr(10) || chr(10) || '`a.py:f` `b.py:g`' ELSE '' END, '^\s+|\s+$', '', 'g') || chr(10) AS content FROM events)
SELECT event_id AS chunk_id, content, 'knowledge/memory/fact/' || event_id || '.md' AS file_path, (length(content) - length(replace(content, chr(10), '')))::BIGINT AS end_line FROM c""",
    "union_first": "SELECT vec_id % 50 AS query_id, vec_id AS chunk_id, label, CASE WHEN vec_id % 2 = 0 THEN 'a' ELSE 'b' END AS list FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 3 = 0",
    "linked_chunks": f"""WITH {_FN} SELECT a.i AS query_id, b.i AS chunk_id FROM fn a JOIN fn b ON b.path = a.path AND lower(b.name) IN ('f' || (a.i + 1), 'f' || a.i) WHERE a.i % 4 = 1 AND b.i <> a.i""",
    "expansions": """SELECT item_id AS query_id, item_id AS chunk_id, md5(CASE WHEN text IS NULL THEN '### retrieve_chunk ' || item_id || chr(10) || '[not in cache]' || chr(10) ELSE '### retrieve_chunk ' || item_id || ' (full)' || chr(10) || '```' || chr(10) || text || chr(10) || '```' || chr(10) END) AS block_md5
FROM (SELECT item_id FROM benchmark) LEFT JOIN documents ON doc_id = item_id UNION ALL SELECT item_id, item_id - 1000000, md5('### retrieve_chunk ' || (item_id - 1000000) || chr(10) || '[not in cache]' || chr(10)) FROM benchmark""",
    "vault_ranking": f"""WITH p AS (SELECT (['knowledge/wiki/', 'knowledge/memory/', 'knowledge/gloss/', 'notes/'])[doc_id % 4 + 1] || doc_id || '.md' AS path, ([0.2, 0.15, 0.1, 0.05]::DOUBLE[])[doc_id % 4 + 1] AS prior, substr(text, 1, 40) AS title, source, lang, text AS body FROM documents),
w AS (SELECT path, prior, list_distinct(regexp_extract_all(lower(title || ' ' || path), '[a-z0-9_]+')) AS t, list_distinct(regexp_extract_all(lower(source || ' ' || lang), '[a-z0-9_]+')) AS x, list_distinct(regexp_extract_all(lower(body), '[a-z0-9_]+')) AS b FROM p),
q AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS q FROM benchmark),
s AS (SELECT query_id, path, len(list_intersect(q, list_concat(t, list_concat(x, b)))) AS any_, round((3.0::DOUBLE * len(list_intersect(q, t)) + 1.5::DOUBLE * len(list_intersect(q, x)) + 0.5::DOUBLE * len(list_intersect(q, b))) / len(q) + 0.1::DOUBLE * prior, 6) AS score FROM w, q)
SELECT query_id, path, score FROM s WHERE any_ > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) <= {K}""",
    "tool_pairs": """WITH e AS (SELECT conv_id AS session_id, turn, 'e' || turn AS id, CASE role WHEN 'user' THEN 'tool_use' WHEN 'assistant' THEN 'tool_result' END AS type, 'tool' || turn % 3 AS tool, CASE WHEN turn % 5 = 0 THEN 'e' || (turn - 3) END AS named FROM conversations),
l AS (SELECT *, last_value(CASE WHEN type = 'tool_use' THEN id END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM e WHERE type IS NOT NULL)
SELECT r.session_id, r.id AS result_id, u.id AS use_id, u.tool AS tool_name FROM l r LEFT JOIN l u ON u.session_id = r.session_id AND u.type = 'tool_use' AND u.id = coalesce(r.named, r.prev) WHERE r.type = 'tool_result'""",
    "log_kinds": """WITH t AS (SELECT user_id, event_id, CASE WHEN event_type = 'click' AND event_id % 2 = 0 THEN false WHEN event_type = 'purchase' THEN true END AS tells FROM events)
SELECT user_id AS session_id, coalesce(arg_min(tells, event_id) FILTER (tells IS NOT NULL), false) AS legacy FROM t GROUP BY user_id""",
    "cache_rates": """SELECT event_type, count(*) AS n, round(avg((event_id % 3 = 0)::INT), 6) AS hit_rate, round(avg((event_id % 4 = 0)::INT) FILTER (event_id % 2 = 0), 6) AS verify_rate,
  round(sum(CASE WHEN event_id % 5 > 0 THEN event_id % 2 ELSE 0 END) / sum(event_id % 5)::DOUBLE, 6) AS invalid_rate FROM events GROUP BY event_type""",
    "cache_live": """WITH p AS (SELECT 'r' || page_id % 7 AS repo, page_id % 4 AS epoch, page_id FROM pages), n AS (SELECT repo, max(epoch) AS epoch FROM p WHERE page_id % 9 = 0 GROUP BY repo) SELECT p.* FROM p JOIN n USING (repo, epoch)""",
    "dense_low_bit": f"{_BITS} SELECT query_id, chunk_id, score FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= {K}",
    "package_counts": """SELECT CASE WHEN doc_id % 9 = 0 THEN '.' ELSE source || '/' || lang END AS package, CASE WHEN doc_id % 2 = 0 THEN 'class' ELSE 'function' END AS type, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY ALL""",
    "query_rewrites": """WITH q AS (SELECT item_id, a::BIGINT AS attempt, CASE item_id % 3 WHEN 0 THEN 'please trace load_item_' || item_id WHEN 1 THEN 'load_item_' || item_id ELSE 'plain words' END AS q, item_id % 5 = 0 AS g FROM benchmark, range(1, 3) t(a))
SELECT item_id, attempt, CASE WHEN item_id % 3 = 2 THEN q ELSE 'load_item_' || item_id END AS query, CASE WHEN g THEN 'deepen_graph' WHEN item_id % 3 = 0 THEN 'rewrite' WHEN attempt >= 2 THEN 'hyde' ELSE 'rewrite' END AS action FROM q""",
    "prefix_digests": """WITH s AS (SELECT page_id, concat_ws(chr(10) || chr(10), CASE WHEN page_id % 5 <> 0 THEN 'rules of ' || page_id END, CASE WHEN page_id % 2 <> 0 THEN 'tools of ' || page_id END, CASE WHEN page_id % 3 <> 0 THEN 'pages of ' || page_id END) AS t FROM pages)
SELECT page_id, t || chr(10) AS prefix, substr(sha256(t || chr(10)), 1, 12) AS digest FROM s WHERE t <> ''""",
    "prefix_changes": "SELECT page_id, 'tools' AS section FROM pages WHERE page_id % 4 = 0",
    "stored_graph": f"WITH e AS ({edges_sql()}) SELECT relationship, count(*) AS n, count(DISTINCT src) AS origins FROM e GROUP BY relationship",
    "health": "SELECT * FROM (VALUES ('python', 'ok'), ('packages', 'ok'), ('edges', 'ok'), ('model', 'ok'), ('other model', 'fail'), ('index', 'warn'), ('broken', 'fail')) t(name, status)",
}
