"""Catalogue: event log, full-text search, memories, redaction, caches, text functions, chunks, validity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.functions.redact import redact_and_audit, redacted
from marlstone.operators import cache, fulltext, log, memory, verify
from marlstone.plans.tables import table
from marlstone.sources.repository import sliding_chunks


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as a typed log: every fourth turn compacts the four before it, every sixth clears the one before."""
    c = table(spark, d, "conversations")
    ids = lambda lo, hi: F.transform(F.sequence(F.col("turn") - lo, F.col("turn") - hi), lambda i: F.concat(F.lit("e"), i.cast("string")))
    kind = F.when((F.col("turn") % 8 == 7), "compact").when(F.col("turn") % 6 == 5, "clear").when(F.col("role") == "assistant", "tool_result").otherwise(F.col("role"))
    return c.select(
        F.col("conv_id").alias("session_id"), F.concat(F.lit("e"), F.col("turn").cast("string")).alias("id"), F.col("turn").alias("seq"), kind.alias("type"), "text",
        F.when(kind == "compact", ids(4, 2)).alias("replace_ids"),
        F.when(kind == "clear", F.map_from_arrays(F.array(F.concat(F.lit("e"), (F.col("turn") - 2).cast("string"))), F.array(F.concat(F.lit("cleared by "), F.col("turn").cast("string"))))).alias("placeholders"),
    )


def derive_messages(spark: SparkSession, d: str) -> DataFrame:
    m = log.derive_messages(_events(spark, d))
    return m.select("session_id", F.col("position").cast("long").alias("position"), "id", "role", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def derive_turns(spark: SparkSession, d: str) -> DataFrame:
    t = log.derive_turns(log.derive_messages(_events(spark, d)))
    return t.select("session_id", "turn", F.md5(F.col("user_text").cast("binary")).alias("user_md5"), "tools")


def dialogue_pairs(spark: SparkSession, d: str) -> DataFrame:
    return log.dialogue_pairs(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")


def latest_answer(spark: SparkSession, d: str) -> DataFrame:
    return log.latest(table(spark, d, "conversations").withColumnRenamed("role", "type"), "assistant", "conv_id", "turn")


def keep_last_n(spark: SparkSession, d: str) -> DataFrame:
    return log.beyond_last(table(spark, d, "conversations"), 2, "conv_id", "turn").select("conv_id", "turn", "role")


def compact_shadow(spark: SparkSession, d: str) -> DataFrame:
    return log.compact_range(table(spark, d, "conversations"), 1, "conv_id", "turn").select("conv_id", "turn")


def event_generations(spark: SparkSession, d: str) -> DataFrame:
    n = log.number_events(_events(spark, d))
    return n.select("session_id", "seq", "id", "generation")


def session_cost(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(
        F.col("user_id").alias("session_id"), F.when(F.col("event_type") == "error", "clear").otherwise("assistant").alias("type"),
        F.round(F.col("value") * 10).cast("long").alias("packed_tokens"), F.round(F.col("value") * 30).cast("long").alias("full_tokens"),
        F.when(F.col("event_type") == "purchase", F.round("value").cast("long")).alias("completion_tokens"), F.lit(5).cast("long").alias("tokens_freed"),
        F.array(F.col("event_type")).alias("cleared_ids"), F.lit(None).cast("map<string,string>").alias("placeholders"),
    )
    return log.session_cost(e)


def history_budget(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").withColumn("tokens", T.token_estimate(F.col("text")))
    return log.history_budget(c, 200, "conv_id", "turn").select("conv_id", "turn", "used", "state")


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return table(spark, d, "conversations").select(key.alias("doc_id"), F.col("text").alias("body"))


def _words(spark: SparkSession, d: str) -> DataFrame:
    """Queries: two long words of each user turn."""
    w = F.filter(F.array_distinct(T.tokenize("text")), lambda t: F.length(t) >= 7)
    rows = table(spark, d, "conversations").where("role = 'user'").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"), F.slice(w, 1, 2).alias("w"))
    return rows.where(F.size("w") == 2).select("query_id", F.array_join("w", " ").alias("query"))


def fts_and_match(spark: SparkSession, d: str) -> DataFrame:
    return fulltext.and_match(_bodies(spark, d), _words(spark, d))


def fts_bm25(spark: SparkSession, d: str) -> DataFrame:
    return fulltext.search(_bodies(spark, d), _words(spark, d), 5).select("query_id", "doc_id", "score")


def fts_snippet(spark: SparkSession, d: str) -> DataFrame:
    b, q = _bodies(spark, d), _words(spark, d)
    return fulltext.with_snippets(fulltext.and_match(b, q), b, q).select("query_id", "doc_id", "snippet")


def fts_stemmed(spark: SparkSession, d: str) -> DataFrame:
    return fulltext.search(_bodies(spark, d), _words(spark, d), 5, stemmed=True).select("query_id", "doc_id", "score")


def _memories(spark: SparkSession, d: str) -> DataFrame:
    """Events as memories: a purchase supersedes its user's event before it; a signup is a decision, and so on."""
    from pyspark.sql import Window

    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    kind = F.when(F.col("event_type") == "signup", "decision").when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "preference").otherwise("fact")
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), kind.alias("kind"), F.col("event_type").alias("title"), F.col("props").alias("body"), "ts", "user_id",
        F.when(F.col("event_type") == "purchase", before).alias("supersedes"), F.when(F.col("value") < 1, "forgotten").otherwise("active").alias("status"),
    )


CUTOFF = "2024-01-20 00:00:00"


def memory_as_of(spark: SparkSession, d: str) -> DataFrame:
    return memory.as_of(_memories(spark, d), F.lit(CUTOFF).cast("timestamp")).select("id", "user_id", "kind")


def memory_supersede_active(spark: SparkSession, d: str) -> DataFrame:
    return memory.with_status(_memories(spark, d)).groupBy("status", "kind").agg(F.count("*").alias("n"), F.max("id").alias("last_id"))


def memory_brief_rank(spark: SparkSession, d: str) -> DataFrame:
    from marlstone.operators.lexical import top_k

    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    m = _memories(spark, d).select("user_id", "id", F.round(memory.brief_score(F.col("kind"), F.col("ts"), now), 6).alias("score"))
    return top_k(m, 5, key="id", by="user_id").select("user_id", "id", "score")


def memory_brief(spark: SparkSession, d: str) -> DataFrame:
    return memory.brief(_memories(spark, d), F.lit("2024-06-01 00:00:00").cast("timestamp"), "user_id", 60, 5)


def memory_ids(spark: SparkSession, d: str) -> DataFrame:
    m = _memories(spark, d)
    return m.select("id", memory.memory_id(F.col("ts"), F.concat_ws(" ", "title", "body")).alias("memory_id"))


def cue_classify(spark: SparkSession, d: str) -> DataFrame:
    cue = F.element_at(F.array(*[F.lit(x) for x in ("we decided", "it failed", "I prefer this", "nothing")]), (F.col("turn") % 4 + 1).cast("int"))
    c = table(spark, d, "conversations").withColumn("said", F.concat_ws(" ", "text", cue))
    return c.select("conv_id", "turn", memory.classify(F.col("said")).alias("kind"), memory.title_of(F.col("said")).alias("title"))


def memory_extract(spark: SparkSession, d: str) -> DataFrame:
    pairs = log.dialogue_pairs(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")
    found = memory.extract(pairs).select("conv_id", "turn", "kind", "title", "body")
    return memory.dedupe(found, "conv_id", "turn").select("conv_id", "turn", "kind", "title")


def memory_reconcile(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").where("role = 'user'")
    key = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    rows = c.select(key.alias("id"), F.lit("fact").alias("kind"), memory.title_of(F.col("text")).alias("title"), F.col("text").alias("body"), "turn")
    return memory.reconcile(rows.where("turn > 0"), rows.where("turn = 0"))


def redact_spans(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "documents").select("doc_id", F.explode(redacted("text")["hits"]).alias("h"))
    return r.select("doc_id", F.col("h.kind").alias("kind"), F.col("h.start").alias("start"), F.col("h.end").alias("end"), F.col("h.fingerprint").alias("fingerprint"))


def redact_audit(spark: SparkSession, d: str) -> DataFrame:
    _, audit = redact_and_audit(table(spark, d, "documents"), "doc_id", "text", "index")
    return audit.select("query_id", F.col("redaction_count").cast("long").alias("redaction_count"))


#: Assignments as SQL can say them: the hexadecimal tokens of the corpus.
ASSIGNED = r'token = "([0-9a-f]{40})"'


def redact_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "documents").select(F.explode(redacted("text")["hits"]).alias("h")).where("h.kind = 'env_assignment'")
    return h.groupBy(F.col("h.fingerprint").alias("fingerprint")).agg(F.count("*").alias("n"))


KNOBS = {"k": 30, "mode": "hybrid", "rerank": "off", "beam": 6, "cap": 3, "hyde": False}


def cache_key_sha256(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", cache.cache_key(F.col("text"), KNOBS, 3).alias("cache_key"))


def content_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return cache.content_fingerprint(table(spark, d, "documents"), "source", "doc_id", "text")


def dirty_set_diff(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("page", F.concat_ws("/", "source", "lang"))
    after = docs.where("lang <> 'de'").withColumn("text", F.when(F.col("source") == "src1", F.upper("text")).otherwise(F.col("text")))
    return cache.dirty_set(cache.content_fingerprint(docs.where("lang <> 'es'"), "page", "text"), cache.content_fingerprint(after, "page", "text"), "page")


def slugify(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


def entity_key_split(spark: SparkSession, d: str) -> DataFrame:
    e = F.concat_ws(":", F.lit("func"), F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit(".py")), F.concat(F.lit("f"), F.col("doc_id").cast("string")))
    rows = table(spark, d, "documents").select("doc_id", e.alias("e"))
    return rows.select("doc_id", T.entity_kind(F.col("e")).alias("kind"), T.entity_path(F.col("e")).alias("path"), T.cite(T.entity_path(F.col("e")), T.entity_name(F.col("e"))).alias("cite"), T.fence_language(T.entity_path(F.col("e"))).alias("fence"))


def sliding_line_chunks(spark: SparkSession, d: str) -> DataFrame:
    return sliding_chunks(table(spark, d, "documents"), "doc_id", "text")


def citation_extract(spark: SparkSession, d: str) -> DataFrame:
    answer = F.concat(F.lit("see `"), F.col("source"), F.lit("/"), F.col("lang"), F.lit(".py:f"), F.col("doc_id").cast("string"), F.lit("` and docs/"), F.col("lang"), F.lit(".md; f1 calls f2"))
    return verify.cited_references(table(spark, d, "documents").select(F.col("doc_id").alias("answer_id"), answer.alias("text")))


def validity_flags(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    path = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit(".py"))
    own = F.concat(F.lit("f"), F.col("doc_id").cast("string"))
    records = docs.where("lang <> 'de'").select(own.alias("id"), own.alias("name"), path.alias("file_path"))
    name = F.concat(F.lit("f"), (F.col("doc_id") + F.when(F.col("lang") == "es", 1).otherwise(0)).cast("string"))
    answers = docs.select(F.col("doc_id").alias("answer_id"), F.concat(F.lit("see `"), path, F.lit(":"), name, F.lit("` for it; "), name, F.lit(" calls f1")).alias("text"))
    edges = docs.where("lang = 'en'").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("src"), F.lit("calls").alias("rel"), F.lit("f1").alias("dst"))
    return verify.validity_flags(answers, records, edges).select("answer_id", "kind", "citation")


QUERIES = {
    f.__name__: f
    for f in (
        derive_messages, derive_turns, dialogue_pairs, latest_answer, keep_last_n, compact_shadow, event_generations, session_cost, history_budget, fts_and_match,
        fts_bm25, fts_snippet, fts_stemmed, memory_as_of, memory_supersede_active, memory_brief_rank, memory_brief, memory_ids, cue_classify, memory_extract,
        memory_reconcile, redact_spans, redact_audit, redact_fingerprint, cache_key_sha256, content_fingerprint, dirty_set_diff, slugify, entity_key_split,
        sliding_line_chunks, citation_extract, validity_flags,
    )
}

_EV = """ev AS (SELECT conv_id AS session_id, 'e' || turn AS id, turn AS seq, text,
  CASE WHEN turn % 8 = 7 THEN 'compact' WHEN turn % 6 = 5 THEN 'clear' WHEN role = 'assistant' THEN 'tool_result' ELSE role END AS type FROM conversations),
sh AS (SELECT DISTINCT session_id, 'e' || unnest([seq - 4, seq - 3, seq - 2]) AS id FROM ev WHERE type = 'compact'),
lv AS (SELECT * FROM ev ANTI JOIN sh USING (session_id, id)),
mk AS (SELECT session_id, 'e' || (seq - 2) AS id, arg_max('cleared by ' || seq, seq) AS mark FROM lv WHERE type = 'clear' GROUP BY ALL),
ls AS (SELECT session_id, max(seq) AS last FROM lv WHERE type = 'system' GROUP BY session_id),
ms AS (SELECT lv.session_id, lv.id, lv.seq, lv.type, CASE WHEN type IN ('system', 'compact') THEN 'system' WHEN type = 'tool_result' THEN 'tool' ELSE type END AS role,
  CASE WHEN type = 'tool_result' THEN coalesce(mark, text) ELSE text END AS text,
  row_number() OVER (PARTITION BY lv.session_id ORDER BY type = 'system' DESC, seq) - 1 AS position
  FROM lv LEFT JOIN mk ON mk.session_id = lv.session_id AND mk.id = lv.id LEFT JOIN ls ON ls.session_id = lv.session_id
  WHERE type IN ('user', 'assistant', 'tool_result', 'system', 'compact') AND (type <> 'system' OR seq = last))"""

_ME = """me AS (SELECT event_id AS id, CASE event_type WHEN 'signup' THEN 'decision' WHEN 'error' THEN 'error' WHEN 'click' THEN 'preference' ELSE 'fact' END AS kind,
  event_type AS title, props AS body, ts, user_id, CASE WHEN event_type = 'purchase' THEN lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) END AS supersedes,
  CASE WHEN value < 1 THEN 'forgotten' ELSE 'active' END AS status FROM events)"""

_WORDS = r"""q AS (SELECT query_id, w[1:2] AS w FROM (SELECT conv_id || '/' || turn AS query_id,
  list_filter(list_transform(list_filter(range(1, len(t) + 1), lambda i: length(t[i]) >= 7 AND list_position(t, t[i]) = i), lambda i: t[i]), lambda x: true) AS w
  FROM (SELECT *, list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS t FROM conversations) WHERE role = 'user') WHERE len(w) >= 2),
b AS (SELECT conv_id || '/' || turn AS doc_id, text AS body, list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS t FROM conversations),
qt AS (SELECT query_id, unnest(w) AS term FROM q),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM b) GROUP BY ALL),
am AS (SELECT query_id, doc_id FROM p JOIN qt USING (term) GROUP BY ALL HAVING count(*) = 2)"""

ORACLES = {
    "derive_messages": f"WITH {_EV} SELECT session_id, position::BIGINT AS position, id, role, md5(text) AS text_md5 FROM ms",
    "derive_turns": f"WITH {_EV}, t AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY session_id ORDER BY position) AS turn FROM ms) SELECT session_id, turn::BIGINT AS turn, md5(max(text) FILTER (role = 'user')) AS user_md5, count(*) FILTER (role = 'tool') AS tools FROM t WHERE turn > 0 GROUP BY ALL",
    "dialogue_pairs": """WITH r AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, text AS user_text, CASE WHEN nr = 'assistant' THEN nt END AS assistant_text FROM r WHERE role = 'user'""",
    "latest_answer": "SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id",
    "keep_last_n": "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) > 2",
    "compact_shadow": "SELECT conv_id, turn FROM conversations JOIN (SELECT conv_id, max(turn) AS f FROM conversations WHERE role = 'user' GROUP BY conv_id) USING (conv_id) WHERE turn < f",
    "event_generations": f"WITH {_EV} SELECT session_id, seq, 'e' || format('{{:04d}}', row_number() OVER w) AS id, (sum((type = 'compact')::INT) OVER w)::BIGINT AS generation FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY seq)",
    "session_cost": """WITH e AS (SELECT user_id AS session_id, event_type, round(value * 10)::BIGINT AS p, round(value * 30)::BIGINT AS f, CASE WHEN event_type = 'purchase' THEN round(value)::BIGINT END AS c FROM events)
SELECT session_id, sum(p)::BIGINT AS packed, sum(f)::BIGINT AS "full", coalesce(sum(c), 0)::BIGINT AS completion, (5 * count(*) FILTER (event_type = 'error'))::BIGINT AS freed, count(*) FILTER (event_type = 'error') AS cleared,
  round((sum(p) * 3.0::DOUBLE + coalesce(sum(c), 0) * 15.0::DOUBLE) / 1e6, 6) AS dollars FROM e GROUP BY session_id""",
    "history_budget": """WITH u AS (SELECT conv_id, turn, sum(length(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn DESC)::BIGINT AS used FROM conversations),
o AS (SELECT *, sum((used > 200)::INT) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS o FROM u) SELECT conv_id, turn, used, CASE WHEN o = 0 THEN 'fits' ELSE 'stub' END AS state FROM o WHERE o <= 1""",
    "fts_and_match": f"WITH {_WORDS} SELECT query_id, doc_id FROM am",
    "fts_bm25": f"""WITH {_WORDS}, st AS (SELECT doc_id, len(t) AS dl FROM b), n AS (SELECT count(*) AS n, avg(dl) AS a FROM st), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT query_id, doc_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / a))), 6) AS score
  FROM am JOIN qt USING (query_id) JOIN p USING (doc_id, term) JOIN df USING (term) JOIN st USING (doc_id), n GROUP BY ALL)
SELECT query_id, doc_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 5""",
    "fts_snippet": f"""WITH {_WORDS}, x AS (SELECT query_id, doc_id, body, greatest(strpos(lower(body), w[1]) - 32, 1) AS s FROM am JOIN b USING (doc_id) JOIN q USING (query_id))
SELECT query_id, doc_id, CASE WHEN s > 1 THEN '...' ELSE '' END || substr(body, s, 160) || CASE WHEN length(body) > s + 159 THEN '...' ELSE '' END AS snippet FROM x""",
    "memory_as_of": f"WITH {_ME}, k AS (SELECT * FROM me WHERE ts <= TIMESTAMP '{CUTOFF}') SELECT id, user_id, kind FROM k WHERE status <> 'forgotten' AND id NOT IN (SELECT supersedes FROM k WHERE supersedes IS NOT NULL)",
    "memory_supersede_active": f"""WITH {_ME}, s AS (SELECT id, kind, CASE WHEN status = 'forgotten' THEN 'forgotten' WHEN id IN (SELECT supersedes FROM me WHERE supersedes IS NOT NULL) THEN 'superseded' ELSE 'active' END AS status FROM me)
SELECT status, kind, count(*) AS n, max(id) AS last_id FROM s GROUP BY ALL""",
    "memory_brief_rank": f"""WITH {_ME}, s AS (SELECT user_id, id, round(0.7::DOUBLE * CASE kind WHEN 'decision' THEN 1.0 WHEN 'error' THEN 0.9 WHEN 'preference' THEN 0.6 ELSE 0.5 END::DOUBLE
  + 0.3::DOUBLE * greatest(least(1 - (epoch(TIMESTAMP '2024-06-01') - floor(epoch(ts))) / 86400.0::DOUBLE / 365, 1.0), 0.0), 6) AS score FROM me)
SELECT user_id, id, score FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, id) <= 5""",
    "memory_ids": f"""WITH {_ME}, s AS (SELECT id, ts, regexp_replace(substr(regexp_replace(regexp_replace(lower(title || ' ' || body), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48), '-+$', '') AS s FROM me)
SELECT id, 'mem/' || strftime(ts, '%Y%m%d') || '-' || CASE WHEN s = '' THEN 'item' ELSE s END AS memory_id FROM s""",
    "cue_classify": rf"""WITH s AS (SELECT conv_id, turn, text || ' ' || (['we decided', 'it failed', 'I prefer this', 'nothing'])[turn % 4 + 1] AS said FROM conversations)
SELECT conv_id, turn, CASE WHEN regexp_matches(said, '{memory.CUES["error"]}') THEN 'error' WHEN regexp_matches(said, '{memory.CUES["decision"].replace("'", "''")}') THEN 'decision'
  WHEN regexp_matches(said, '{memory.CUES["preference"]}') THEN 'preference' ELSE 'fact' END AS kind, trim(substr(regexp_extract(trim(said), '^[^.!?\n]*'), 1, 80)) AS title FROM s""",
    "redact_fingerprint": f"""SELECT substr(sha256(v), 1, 12) AS fingerprint, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{ASSIGNED}', 1)) AS v FROM documents) GROUP BY 1""",
    "redact_spans": f"""WITH m AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '{ASSIGNED}', 1)) AS v FROM documents)
SELECT doc_id, 'env_assignment' AS kind, (strpos(text, v) - 1)::INT AS start, (strpos(text, v) + 39)::INT AS "end", substr(sha256(v), 1, 12) AS fingerprint FROM m""",
    "redact_audit": f"""SELECT doc_id::VARCHAR AS query_id, len(regexp_extract_all(text, '{ASSIGNED}')) AS redaction_count FROM documents WHERE regexp_matches(text, '{ASSIGNED}')""",
    "cache_key_sha256": "SELECT item_id, sha256(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) || chr(10) || 'beam=6;cap=3;hyde=False;k=30;mode=hybrid;rerank=off' || chr(10) || '3') AS cache_key FROM benchmark",
    "content_fingerprint": """WITH r AS (SELECT source, sha256(doc_id || chr(31) || coalesce(text, '')) AS x FROM documents),
h AS (SELECT source, sum(('0x' || substr(x, 1, 15))::BIGINT::HUGEINT) AS a, sum(('0x' || substr(x, 16, 15))::BIGINT::HUGEINT) AS b, sum(('0x' || substr(x, 31, 15))::BIGINT::HUGEINT) AS c, sum(('0x' || substr(x, 46, 15))::BIGINT::HUGEINT) AS d, count(*) AS n FROM r GROUP BY source)
SELECT source, substr(sha256(a || ':' || b || ':' || c || ':' || d || ':' || n), 1, 16) AS fingerprint FROM h""",
    "dirty_set_diff": """WITH p AS (SELECT source || '/' || lang AS page, source, lang, text FROM documents),
b AS (SELECT DISTINCT page FROM p WHERE lang <> 'es'), a AS (SELECT DISTINCT page, source FROM p WHERE lang <> 'de')
SELECT coalesce(b.page, a.page) AS page, CASE WHEN b.page IS NULL THEN 'added' WHEN a.page IS NULL THEN 'removed' ELSE 'changed' END AS state
FROM b FULL JOIN a ON a.page = b.page WHERE b.page IS NULL OR a.page IS NULL OR a.source = 'src1'""",
    "slugify": """WITH s AS (SELECT page_id, regexp_replace(substr(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48), '-+$', '') AS s FROM pages) SELECT page_id, CASE WHEN s = '' THEN 'item' ELSE s END AS slug FROM s""",
    "entity_key_split": "SELECT doc_id, 'func' AS kind, source || '/' || lang || '.py' AS path, source || '/' || lang || '.py:f' || doc_id AS cite, 'python' AS fence FROM documents",
    "memory_brief": f"""WITH RECURSIVE {_ME}, m AS (SELECT user_id, id, length('- **[' || kind || ']** ' || title || ' (' || strftime(ts, '%Y-%m-%d') || ')' || chr(10) || rtrim('  ' || trim(body)) || chr(10)) AS c,
  round(0.7::DOUBLE * CASE kind WHEN 'decision' THEN 1.0 WHEN 'error' THEN 0.9 WHEN 'preference' THEN 0.6 ELSE 0.5 END::DOUBLE
  + 0.3::DOUBLE * greatest(least(1 - (epoch(TIMESTAMP '2024-06-01') - floor(epoch(ts))) / 86400.0::DOUBLE / 365, 1.0), 0.0), 9) AS score, ts FROM me),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, ts DESC, id) AS n FROM m),
l AS (SELECT user_id, list(struct_pack(id := id, c := c, score := score) ORDER BY n) AS x FROM r GROUP BY user_id),
w AS (SELECT user_id, x, 1 AS i, CASE WHEN (25 + x[1].c) // 4 <= 60 THEN 25 + x[1].c ELSE 240 END AS u, CASE WHEN (25 + x[1].c) // 4 <= 60 THEN 0 ELSE 99 END AS place, true AS took FROM l
  UNION ALL SELECT user_id, x, i + 1, CASE WHEN ok THEN u + x[i + 1].c ELSE u END, CASE WHEN ok THEN place + 1 ELSE place END, ok
  FROM (SELECT *, (u + x[i + 1].c) // 4 <= 60 AND place < 4 AS ok FROM w) WHERE i < len(x) AND place < 4)
SELECT user_id, x[i].id AS id, x[i].score AS score, (u // 4)::BIGINT AS used, place = 99 AS cut, (CASE WHEN place = 99 THEN 0 ELSE place END)::INT AS place FROM w WHERE took""",
    "validity_flags": """WITH n AS (SELECT *, source || '/' || lang || '.py' AS path, 'f' || (doc_id + (lang = 'es')::INT) AS name FROM documents),
k AS (SELECT 'f' || doc_id AS name, source || '/' || lang || '.py' AS path FROM documents WHERE lang <> 'de'), e AS (SELECT 'f' || doc_id AS name FROM documents WHERE lang = 'en')
SELECT doc_id AS answer_id, 'missing_symbol' AS kind, path || ':' || name AS citation FROM n WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.name = n.name AND k.path = n.path)
UNION ALL SELECT doc_id, 'contradicted_edge', name || ' calls f1' FROM n WHERE name IN (SELECT name FROM k) AND 'f1' IN (SELECT name FROM k) AND name NOT IN (SELECT name FROM e)""",
    "citation_extract": """SELECT doc_id AS answer_id, source || '/' || lang || '.py' AS path, 'f' || doc_id AS symbol FROM documents UNION ALL SELECT doc_id, 'docs/' || lang || '.md', '' FROM documents""",
}
