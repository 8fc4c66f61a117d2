"""Predicates on chunks: wiki and memory pages, tests, stubs, real source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SYNTHETIC_KINDS = ("cli_doc", "catalog", "generated", "synthetic")
SYNTHETIC_TAILS = ("cli-doc", "catalog", "generated", "synthetic")
WIKI_SOURCES = ("wiki", "knowledge/wiki")
TEST_FILE = r"(?:^|/)(?:tests?/.*|test_[^/]+|[^/]+_test)\.(?:py|go|js|ts)$"


def _slashed(path: Column) -> Column:
    """``/path`` with forward slashes and without leading dots, so that a folder is found by its slashes alone."""
    return F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(F.coalesce(path, F.lit("")), r"\\", "/"), r"^[./]+", ""))


def _within(path: Column, *folders: str) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(_slashed(path), F.lit(f"/{f}/")) for f in folders])


def is_wiki_path(path: Column) -> Column:
    return _within(path, "knowledge/wiki")


def is_memory_path(path: Column, overlay: str = "local/memory") -> Column:
    """Below the shared folder of memories, or below ``overlay``, where a machine keeps its own."""
    return _within(path, "knowledge/memory", overlay)


def is_test_path(path: Column) -> Column:
    return F.regexp(F.regexp_replace(F.coalesce(path, F.lit("")), r"\\", "/"), F.lit(TEST_FILE))


def _tag(metadata: Column, key: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.try_element_at(metadata, F.lit(key)), F.lit(""))))


def is_wiki_chunk(metadata: Column, path: Column) -> Column:
    return (_tag(metadata, "kind") == "wiki") | _tag(metadata, "source").isin(*WIKI_SOURCES) | is_wiki_path(path)


def is_memory_chunk(metadata: Column, path: Column) -> Column:
    return (_tag(metadata, "kind") == "memory") | (_tag(metadata, "memory_kind") != "") | is_memory_path(path)


def id_is_synthetic(chunk_id: Column) -> Column:
    tail = F.element_at(F.split(chunk_id, ":"), -1)
    return F.coalesce(tail.isin(*SYNTHETIC_TAILS) | F.contains(chunk_id, F.lit(":cli-doc:")), F.lit(False))


def is_synthetic_chunk(metadata: Column, chunk_id: Column) -> Column:
    marked = (_tag(metadata, "generated") != "") | (_tag(metadata, "synthetic") != "")
    return _tag(metadata, "kind").isin(*SYNTHETIC_KINDS) | marked | id_is_synthetic(chunk_id)


def is_source_backed(metadata: Column, chunk_id: Column, path: Column, start: Column, end: Column) -> Column:
    """Real file text with a line range, not a stub."""
    lines = F.coalesce((start >= 1) & (end >= start), F.lit(False))
    return ~is_synthetic_chunk(metadata, chunk_id) & (F.trim(F.coalesce(path, F.lit(""))) != "") & lines
