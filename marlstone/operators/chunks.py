"""What a chunk says about itself: signature, preview, file name, the text that is indexed, and chunks made of commands and memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
SIGNATURE_CHARS, PREVIEW_CHARS, SENTENCE_CHARS, NAME_CHARS, DIGEST_CHARS = 200, 160, 140, 120, 10
ADD_PARSER = r"add_parser\(\s*['\"]([\w-]+)['\"](?:\s*,\s*help\s*=\s*['\"]([^'\"]*)['\"])?"
NAMED_AFTER = r"\b(?:cli|command|subcommand)\s+([a-z][\w-]*)"
NAMED_BEFORE = r"\b([a-z][\w-]*)\s+(?:cli|command|subcommand)\b"
COMMAND_STOP = ("the", "a", "an", "this", "that", "which", "what", "is", "for", "each", "any", "cli", "command", "subcommand")


def _first_line(text: Column) -> Column:
    return F.trim(F.split_part(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(1)))


def signature(kind: Column, name: Column, params: Column, bases: Column, content: Column, path: Column) -> Column:
    """A function's name and parameters (its first line where these are unknown), a class and its bases, else the name or the path."""
    called = lambda xs: F.concat(F.coalesce(name, F.lit("")), F.lit("("), F.array_join(xs, ", "), F.lit(")"))
    named = F.nullif(name, F.lit(""))
    first = F.nullif(F.substring(_first_line(content), 1, SIGNATURE_CHARS), F.lit(""))
    function = F.when(params.isNotNull(), called(params)).otherwise(F.coalesce(first, named))
    cls = F.when(F.size(F.coalesce(bases, F.array().cast("array<string>"))) > 0, called(bases)).otherwise(F.coalesce(named, first))
    return F.when(kind.isin("function", "method"), function).when(kind == "class", cls).otherwise(F.coalesce(named, path))


def doc_preview(docstring: Column, content: Column, most: int = PREVIEW_CHARS) -> Column:
    """The first sentence of a doc string (or of the first triple-quoted text in the content), on one line, with dots where it is cut."""
    own = F.trim(F.coalesce(docstring, F.lit("")))
    quoted = F.trim(F.regexp_extract(F.coalesce(content, F.lit("")), '(?s)"""(.*?)"""', 1))
    raw = F.when(own != "", own).otherwise(quoted)
    line = F.trim(F.replace(F.split_part(raw, F.lit("\n\n"), F.lit(1)), F.lit("\n"), F.lit(" ")))

    def cut(text: Column, sign: str) -> Column:
        at = F.call_function("instr", text, F.lit(sign))
        return F.when((at > 0) & (at <= SENTENCE_CHARS + 1), F.substr(text, F.lit(1), at))

    short = F.coalesce(cut(line, "."), cut(line, "!"), cut(line, "?"), line)
    return F.when(F.length(short) > most, F.concat(F.substring(short, 1, most - 1), F.lit("…"))).otherwise(short)


def safe_name(chunk_id: Column) -> Column:
    """A file name for a chunk's original: what is safe of its id, and a digest that keeps names apart."""
    bare = F.regexp_replace(F.regexp_replace(chunk_id, "[^A-Za-z0-9._-]+", "_"), "^[._]+|[._]+$", "")
    return F.concat(F.substring(F.coalesce(F.nullif(bare, F.lit("")), F.lit("chunk")), 1, NAME_CHARS), F.lit("."), F.substring(F.sha1(chunk_id.cast("binary")), 1, DIGEST_CHARS))


def command_catalog(chunks: DataFrame) -> DataFrame:
    """``file_path, handler, command, help``: commands that a file's code adds to a parser, each once a file; the handler is named after the command."""
    found = F.arrays_zip(F.regexp_extract_all("content", F.lit(ADD_PARSER), F.lit(1)).alias("c"), F.regexp_extract_all("content", F.lit(ADD_PARSER), F.lit(2)).alias("h"))
    rows = chunks.select("file_path", F.explode(found).alias("x")).select("file_path", F.col("x.c").alias("command"), F.coalesce(F.col("x.h"), F.lit("")).alias("help"))
    return rows.groupBy("file_path", "command").agg(F.max("help").alias("help")).select("file_path", F.concat(F.lit("cmd_"), F.replace("command", F.lit("-"), F.lit("_"))).alias("handler"), "command", "help")


def command_docs(chunks: DataFrame) -> DataFrame:
    """One small chunk for each command whose handler is known: ``chunk_id, content, entity_id, entity_name, file_path, kind``. They share the
    handler's entity, the first chunk of its name."""
    real = chunks.groupBy(F.col("entity_name").alias("handler")).agg(F.min_by(F.struct("entity_id", "file_path"), "chunk_id").alias("r"))
    catalog = command_catalog(chunks).groupBy("handler").agg(F.max(F.struct("command", "help")).alias("c"))
    rows = catalog.join(real, "handler").select("handler", "c.*", "r.*")
    body = F.concat(
        F.lit("The "), "command", F.lit(" CLI command is defined as "), "handler", F.lit(" in "), "file_path", F.lit(". argparse add_parser('"), "command", F.lit("')."),
        F.when(F.col("help") != "", F.concat(F.lit(" Help: "), "help", F.lit("."))).otherwise(""),
    )
    first = Window.partitionBy("entity_id").orderBy("handler")
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return rows.select(F.concat("entity_id", F.lit(":cli-doc")).alias("chunk_id"), body.alias("content"), "entity_id", F.col("handler").alias("entity_name"), "file_path", F.lit("cli_doc").alias("kind"))


def index_text(chunks: DataFrame, catalog: DataFrame) -> DataFrame:
    """``chunk_id, content``: handlers' texts begin with what their command is called and does."""
    info = catalog.groupBy(F.col("handler").alias("entity_name")).agg(F.max(F.struct("command", "help")).alias("c"))
    head = F.concat(F.lit("CLI command "), F.col("c.command"), F.lit(". Handler "), F.col("entity_name"), F.lit("."), F.when(F.col("c.help") != "", F.concat(F.lit(" Help: "), F.col("c.help"), F.lit("."))).otherwise(""))
    return chunks.join(info, "entity_name", "left").select("chunk_id", F.when(F.col("c").isNull(), F.col("content")).otherwise(F.concat(head, F.lit("\n"), F.col("content"))).alias("content"))


def asked_commands(query: Column) -> Column:
    """Handlers that a question about a command names, each once."""
    low = F.lower(F.trim(F.coalesce(query, F.lit(""))))
    stems = F.array_union(F.regexp_extract_all(low, F.lit(NAMED_AFTER), F.lit(1)), F.regexp_extract_all(low, F.lit(NAMED_BEFORE), F.lit(1)))
    kept = F.filter(stems, lambda s: (F.coalesce(s, F.lit("")) != "") & ~s.isin(*COMMAND_STOP))
    return F.array_distinct(F.transform(kept, lambda s: F.concat(F.lit("cmd_"), F.replace(s, F.lit("-"), F.lit("_")))))


def memory_chunks(memories: DataFrame) -> DataFrame:
    """Memories as chunks: ``chunk_id, content, entity_id, entity_name, entity_type, file_path, start_line, end_line, kind``. ``memories`` carry ``path``."""
    links = F.array_join(F.transform("links", lambda x: F.concat(F.lit("`"), x, F.lit("`"))), " ") if "links" in memories.columns else F.lit("")
    parts = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.lit(""), F.coalesce("body", F.lit("")), F.when(links != "", F.concat(F.lit("\n"), links)))
    content = F.concat(F.regexp_replace(parts, r"^\s+|\s+$", ""), F.lit("\n"))
    rows = memories.withColumn("_c", content)
    lines = F.length("_c") - F.length(F.replace("_c", F.lit("\n"), F.lit("")))
    return rows.select(
        F.col("id").alias("chunk_id"), F.col("_c").alias("content"), F.col("id").alias("entity_id"), F.col("title").alias("entity_name"), F.lit("documentation").alias("entity_type"), F.col("path").alias("file_path"),
        F.lit(1).alias("start_line"), F.greatest(F.lit(1), lines).alias("end_line"), F.lit("memory").alias("kind"),
    )


def union_first(lists: list[DataFrame], key: str = "chunk_id", by: str = "query_id") -> DataFrame:
    """The rows of several lists, each key once: as the first list that has it gives it."""
    rows = lists[0].withColumn("_list", F.lit(0))
    for i, other in enumerate(lists[1:], 1):
        rows = rows.unionByName(other.withColumn("_list", F.lit(i)), allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in (by, key)]
    best = rows.groupBy(by, key).agg(F.min_by(F.struct(*rest), "_list").alias("_r"))
    return best.select(by, key, "_r.*").drop("_list")


def linked_chunks(packed: DataFrame, chunks: DataFrame) -> DataFrame:
    """``query_id, chunk_id``: chunks that packed texts cite as ``path:symbol``, but for those that are packed already. ``packed``: ``query_id,
    chunk_id, content``; ``chunks``: ``chunk_id, file_path, entity_name``."""
    from marlstone.functions.text import normalize_path, path_matches
    from marlstone.operators.verify import cited_references

    last = lambda c: F.element_at(F.split(c, "/"), -1)
    cites = cited_references(packed.select(F.col("query_id").alias("answer_id"), F.col("content").alias("text"))).where("symbol <> ''")
    cites = cites.select(F.col("answer_id").alias("query_id"), "path", F.lower(F.element_at(F.split("symbol", r"\."), -1)).alias("_s"), last(F.col("path")).alias("_l"))
    have = chunks.select("chunk_id", normalize_path(F.col("file_path")).alias("_p"), F.lower(F.element_at(F.split("entity_name", r"\."), -1)).alias("_s")).withColumn("_l", last(F.col("_p")))
    found = cites.join(have, ["_l", "_s"]).where(path_matches(F.col("path"), F.col("_p"))).select("query_id", "chunk_id").distinct()
    return found.join(packed.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")


def expansions(wanted: DataFrame, originals: DataFrame) -> DataFrame:
    """``query_id, chunk_id, block``: full originals of asked-for chunks as they are appended to a context; a note where one is lost."""
    rows = wanted.select("query_id", "chunk_id").join(originals.select("chunk_id", "content"), "chunk_id", "left")
    head = F.concat(F.lit("### retrieve_chunk "), F.col("chunk_id").cast("string"))
    full = F.concat(head, F.lit(" (full)\n```\n"), "content", F.lit("\n```\n"))
    return rows.select("query_id", "chunk_id", F.coalesce(full, F.concat(head, F.lit("\n[not in cache]\n"))).alias("block"))
