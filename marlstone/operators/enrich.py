"""Edges that the sources themselves state: commands and routes that code exposes, symbols that tests exercise, notes on entities.

``entities``: ``entity_id, name, type, file_path, source_code, ordinal`` and, for notes, ``kind``. Every link is an equi-join on a file or a name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.filters import is_test_path
from marlstone.operators.graph import unique_names

# What exposes a name (kind of endpoint, pattern, group of the name), and how sure that is for the entity and for its file.
EXPOSERS = (
    ("cli", r"add_parser\(\s*['\"]([\w-]+)['\"]", 0.5, None),
    ("cli", r"@(?:[\w.]+\.)?command\(\s*(?:name\s*=\s*)?['\"]([\w-]+)['\"]", 0.8, 0.7),
    ("http", r"@[\w.]+\.(?:get|post|put|delete|patch|route)\(\s*['\"]([^'\"]+)['\"]", 0.8, 0.7),
    ("http", r"(?:app|router)\.(?:get|post|put|delete|patch)\(\s*['\"]([^'\"]+)['\"]", 0.7, None),
    ("mcp", r"@(?:[\w.]+\.)?tool\(\s*(?:name\s*=\s*)?['\"]([^'\"]+)['\"]", 0.8, None),
)
HANDLER, GLOSS = 0.6, 0.9
IMPORTED, MENTIONED = 0.8, 0.55
FROM_IMPORT = r"from\s+[\w.]+\s+import\s+([A-Za-z_][\w,\s]*)"
IMPORT = r"(?m)^\s*import\s+([A-Za-z_][\w.]*)"
IDENTIFIER = r"\b([A-Z][A-Za-z0-9_]+|[a-z_][a-z0-9_]{3,})\b"
FRONT_MATTER = r"(?s)\A---\s*\n(.*?)\n---\s*\n?"
ENTITY_LINE = r"(?im)^(?:entity|entities)\s*:\s*(.+)$"
CODE = ("file", "function", "method", "class")


def endpoint_id(path: Column, name: Column) -> Column:
    return F.concat(F.lit("endpoint:"), path, F.lit(":"), name)


def exposes(entities: DataFrame) -> DataFrame:
    """``src, dst, relationship, kind, confidence, name, file_path``: entities and the commands, routes and tools they expose, each pair once (its
    surest statement). Tests expose nothing. A command's handler is the first entity of its file named after it."""
    code = entities.where(F.col("type").isin(*CODE) & ~is_test_path(F.col("file_path")) & (F.coalesce("source_code", F.lit("")) != ""))
    found = []
    for kind, pattern, sure, file_sure in EXPOSERS:
        names = code.select("entity_id", "file_path", "type", F.explode(F.array_distinct(F.regexp_extract_all("source_code", F.lit(pattern), F.lit(1)))).alias("name")).where(F.trim("name") != "")
        found.append(names.select(F.col("entity_id").alias("src"), "file_path", F.trim("name").alias("name"), F.lit(kind).alias("kind"), F.lit(sure).alias("confidence")))
        if file_sure is not None:
            found.append(names.where("type <> 'file'").select(F.concat(F.lit("file:"), "file_path").alias("src"), "file_path", F.trim("name").alias("name"), F.lit(kind).alias("kind"), F.lit(file_sure).alias("confidence")))
    stated = reduce(DataFrame.unionByName, found)
    commands = stated.where("kind = 'cli'").select("file_path", "name").distinct()
    wanted = commands.select("file_path", "name", F.explode(F.array(F.concat(F.lit("cmd_"), "name"), F.col("name"), F.concat("name", F.lit("_command")))).alias("_n"))
    last = F.element_at(F.split("entity_id", ":"), -1)
    named = entities.select("file_path", "entity_id", "ordinal", F.explode(F.array_distinct(F.array(F.col("name"), last))).alias("_n"))
    handlers = wanted.join(named, ["file_path", "_n"]).groupBy("file_path", "name").agg(F.min_by("entity_id", F.struct("ordinal", "entity_id")).alias("src"))
    every = stated.unionByName(handlers.select("src", "file_path", "name", F.lit("cli").alias("kind"), F.lit(HANDLER).alias("confidence")))
    rows = every.withColumn("dst", endpoint_id(F.col("file_path"), F.col("name"))).where("src <> dst")
    best = rows.groupBy("src", "dst", "file_path", "name").agg(F.max(F.struct("confidence", "kind")).alias("_b"))
    return best.select("src", "dst", F.lit("exposes").alias("relationship"), "_b.kind", "_b.confidence", "name", "file_path")


def endpoints(exposed: DataFrame) -> DataFrame:
    """The endpoint entities of ``exposes``: ``entity_id, name, type, file_path, kind, confidence``."""
    best = exposed.groupBy("dst", "name", "file_path").agg(F.max(F.struct("confidence", "kind")).alias("_b"))
    return best.select(F.col("dst").alias("entity_id"), "name", F.lit("endpoint").alias("type"), "file_path", "_b.kind", "_b.confidence")


def tested_by(entities: DataFrame, common: tuple[str, ...] = ()) -> DataFrame:
    """``src, dst, relationship, confidence, via``: tests and the symbols that they import or mention, for names that only one entity outside of
    tests has. ``common``: names too common to tell anything."""
    symbols = entities.where(~F.col("type").isin("file", "documentation", "endpoint") & ~is_test_path(F.col("file_path")))
    simple = F.element_at(F.split("name", r"\."), -1)
    names = unique_names(symbols.select("entity_id", F.explode(F.array_distinct(F.array(F.col("name"), simple))).alias("n")), "n", "entity_id")
    tests = entities.where(is_test_path(F.col("file_path")) & F.col("type").isin("file", "function", "method"))
    text = F.coalesce("source_code", F.lit(""))
    listed = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(FROM_IMPORT), F.lit(1)), lambda x: F.split(x, r"[,\s]+")))
    modules = F.transform(F.regexp_extract_all(text, F.lit(IMPORT), F.lit(1)), lambda x: F.element_at(F.split(x, r"\."), -1))
    imported = F.array_distinct(F.filter(F.concat(listed, modules), lambda x: x != ""))
    said = tests.select("entity_id", imported.alias("i"), F.array_distinct(F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(1))).alias("m"))
    rows = said.select("entity_id", F.explode(F.array_union("i", "m")).alias("name"), "i").select("entity_id", "name", F.array_contains("i", F.col("name")).alias("sure"))
    if common:
        rows = rows.where(~F.lower("name").isin(*common) & ~F.col("name").isin(*common))
    hits = rows.join(names, "name").where("entity_id <> target")
    best = hits.groupBy("entity_id", "target").agg(F.max(F.struct("sure", "name")).alias("_b"))
    return best.select(F.col("entity_id").alias("src"), F.col("target").alias("dst"), F.lit("tested_by").alias("relationship"), F.when(F.col("_b.sure"), IMPORTED).otherwise(MENTIONED).alias("confidence"), F.col("_b.name").alias("via"))


def linked_entities(text: Column) -> Column:
    """Entity ids that a note's front matter lists."""
    block = F.regexp_extract(F.coalesce(text, F.lit("")), FRONT_MATTER, 1)
    lines = F.transform(F.regexp_extract_all(block, F.lit(ENTITY_LINE), F.lit(1)), lambda x: F.split(F.regexp_replace(F.trim(x), r"^\[+|\]+$", ""), r"[,\s]+"))
    bare = F.transform(F.flatten(lines), lambda x: F.regexp_replace(x, "^['\"]+|['\"]+$", ""))
    return F.array_distinct(F.filter(bare, lambda x: F.contains(x, F.lit(":"))))


def gloss_title(text: Column, path: Column) -> Column:
    """The first heading of a note, else its file's name."""
    heading = F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?m)^\s*#+[ \t]*(.*?)[ \t]*$", 1))
    return F.coalesce(F.nullif(heading, F.lit("")), F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1))


def gloss(entities: DataFrame) -> DataFrame:
    """``src, dst, relationship, confidence``: notes and the known entities that their front matter lists."""
    is_note = (F.col("kind") == "gloss") if "kind" in entities.columns else F.lit(False)
    is_note = F.coalesce(is_note, F.lit(False)) | ((F.col("type") == "documentation") & F.contains(F.concat(F.lit("/"), "file_path"), F.lit("/gloss/")))
    notes = entities.where(is_note).select(F.col("entity_id").alias("src"), F.explode(linked_entities(F.col("source_code"))).alias("dst"))
    known = entities.select(F.col("entity_id").alias("dst")).distinct()
    return notes.join(known, "dst", "left_semi").distinct().select("src", "dst", F.lit("gloss").alias("relationship"), F.lit(GLOSS).alias("confidence"))


def enriched_edges(entities: DataFrame, common: tuple[str, ...] = ()) -> DataFrame:
    """``src, dst, relationship, confidence`` of all three."""
    parts = [exposes(entities), tested_by(entities, common), gloss(entities)]
    return reduce(DataFrame.unionByName, [p.select("src", "dst", "relationship", "confidence") for p in parts])
