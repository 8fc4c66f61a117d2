"""Tables on disk: partitioned stores with upsert and delete, session logs, suites, vault documents, text sinks."""

from __future__ import annotations

import json
import re
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.log import EVENT_SCHEMA


def write_repo(df: DataFrame, path: str, repo: str = "repo_name") -> None:
    """Replaces the partitions of the repositories in ``df`` and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(repo).parquet(path)


def scan(spark: SparkSession, path: str, repo: str | None = None, column: str = "repo_name") -> DataFrame:
    """The table, pruned to one repository's partition where that is named."""
    df = spark.read.parquet(path)
    return df.where(F.col(column) == repo) if repo else df


def delete_repo(spark: SparkSession, path: str, repo: str, column: str = "repo_name") -> bool:
    """Drops a repository's partition; false if there was none."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{column}={repo}")
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True))


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Both tables below ``path``; edges are sorted by their origin, so that a node's own are read together."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.repartitionByRange("src").sortWithinPartitions("src", "dst").write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def spill_originals(chunks: DataFrame, path: str) -> None:
    """Originals of packed chunks by chunk id, each once, for later expansion; a repeated id keeps the longest text."""
    best = chunks.groupBy("chunk_id").agg(F.max_by("content", F.struct(F.length("content"), "content")).alias("content"))
    best.repartitionByRange("chunk_id").write.mode("append").parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows of ``new`` replace those with their key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def same_model(embeddings: DataFrame, model: str) -> DataFrame:
    """The table, with an error for a row of another model."""
    return embeddings.withColumn("model", F.when(F.col("model") == model, F.col("model")).otherwise(F.raise_error(F.concat(F.lit("embeddings of another model: "), F.col("model")))))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A session log of JSON lines; malformed lines are dropped."""
    return spark.read.schema(EVENT_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def migrate_legacy(turns: DataFrame) -> DataFrame:
    """Typed events from a log of ``session_id, seq, event, role, text, chunk_ids``: an assistant row that names chunks becomes a tool use, its
    result and the answer; ``session_start`` becomes a meta event. New ``seq`` values leave room for that."""
    has = F.size(F.coalesce("chunk_ids", F.array().cast("array<string>"))) > 0
    one = lambda kind, text, step: F.struct(F.lit(kind).alias("type"), text.alias("text"), (F.col("seq") * 3 + step).alias("seq"))
    text, ids = F.col("text"), F.array_join("chunk_ids", " ")
    plain = F.array(one("meta", text, 0))
    parts = (
        F.when(F.col("event") == "session_start", plain)
        .when((F.col("role") == "assistant") & has, F.array(one("tool_use", F.lit("retrieve"), 0), one("tool_result", ids, 1), one("assistant", text, 2)))
        .when(F.col("role") == "assistant", F.array(one("assistant", text, 0)))
        .when(F.col("role") == "user", F.array(one("user", text, 0)))
        .otherwise(plain)
    )
    return turns.select("session_id", F.explode(parts).alias("e")).select("session_id", "e.seq", "e.type", "e.text")


def load_suite(path: str) -> tuple[dict, list[dict]]:
    """A golden suite from JSON or YAML: a list, or a mapping with ``fixtures`` or ``cases``. Rows need an id and a query; a difficulty is easy,
    medium or hard."""
    raw = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        import yaml

        data = yaml.safe_load(raw)
    else:
        data = json.loads(raw)
    meta, rows = ({}, data) if isinstance(data, list) else (data, data.get("fixtures") or data.get("cases") or [])
    out = []
    for r in rows:
        query_id, query = r.get("id") or r.get("query_id"), r.get("query")
        if not query_id or not query:
            raise ValueError(f"a case needs an id and a query: {r}")
        if (difficulty := r.get("difficulty", "")) not in ("", "easy", "medium", "hard"):
            raise ValueError(f"unknown difficulty {difficulty!r} of {query_id}")
        out.append({"query_id": str(query_id), "query": query, "relevant_chunk_ids": r.get("relevant_chunk_ids", []), "must_cite_paths": r.get("must_cite_paths", []), "difficulty": difficulty, "category": r.get("category", ""), "answer": r.get("answer", "")})
    return {"suite": meta.get("suite", Path(path).stem), "k": int(meta.get("k", 10))}, out


_FRONT = re.compile(r"\A---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\Z)", re.S)
_KNOWN = ("title", "type", "description", "status", "tags", "entity")


def parse_frontmatter(text: str) -> tuple[dict, str]:
    """Keys of the leading block (scalars and lists) and the body; unknown keys are kept."""
    m = _FRONT.match(text)
    if not m:
        return {}, text
    out, key = {}, ""
    for line in m[1].splitlines():
        if (item := re.match(r"^\s+-\s+(.*)$", line)) and key:
            out[key] = [*(out[key] if isinstance(out[key], list) else []), item[1].strip("\"' ")]
        elif pair := re.match(r"^([\w-]+):\s*(.*)$", line):
            key, value = pair[1], pair[2].strip()
            out[key] = [x.strip("\"' ") for x in value[1:-1].split(",") if x.strip()] if value.startswith("[") and value.endswith("]") else value.strip("\"'")
    return out, text[m.end() :]


def classify_document(path: str, kind: str) -> str:
    """By path first: wiki, memory, gloss; then by type."""
    for name in ("wiki", "memory", "gloss"):
        if f"/{name}/" in f"/{path}":
            return name
    return kind if kind in ("wiki", "memory", "gloss") else "other"


DOCUMENT_SCHEMA = "rel_path string, kind string, title string, type string, description string, status string, tags array<string>, entities array<string>, extras string, body string"


def read_vault(spark: SparkSession, root: str) -> DataFrame:
    """Markdown documents below ``root`` with their front matter."""
    base = re.sub("^[a-z]+:/*", "/", root).rstrip("/")
    rows = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root)
    rows = rows.select(F.regexp_replace(F.regexp_replace(F.input_file_name(), "^[a-z]+:/*", "/"), F.lit("^" + re.escape(base) + "/"), F.lit("")).alias("rel_path"), "value")

    def parse(batches):
        many = lambda v: v if isinstance(v, list) else [v] if v else []
        for b in batches:
            out = []
            for path, text in zip(b["rel_path"], b["value"], strict=True):
                head, body = parse_frontmatter(text)
                extras = json.dumps({k: v for k, v in head.items() if k not in _KNOWN}, sort_keys=True)
                out.append((path, classify_document(path, head.get("type", "")), head.get("title", ""), head.get("type", ""), head.get("description", ""), head.get("status", "active"), many(head.get("tags")), many(head.get("entity")), extras, body))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in DOCUMENT_SCHEMA.split(", ")])

    return rows.mapInPandas(parse, DOCUMENT_SCHEMA)


def export_vault(docs: DataFrame, path: str) -> dict[str, int]:
    """Writes the documents as JSON lines and returns counts by kind (a row a kind)."""
    docs.write.mode("overwrite").json(path)
    return {r["kind"]: r["count"] for r in docs.groupBy("kind").count().collect()}


def import_vault(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """What ``export_vault`` wrote, with paths below ``prefix``."""
    rows = spark.read.schema(DOCUMENT_SCHEMA).json(path)
    return rows.withColumn("rel_path", F.concat(F.lit(f"{prefix.rstrip('/')}/" if prefix else ""), "rel_path"))


def audit_tail(audit: DataFrame, n: int, order: str = "ts") -> DataFrame:
    return audit.orderBy(F.col(order).desc()).limit(n)
