"""Text expressions: tokens, identifiers, paths, citations, snippets. All are built from JVM-side functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "([A-Za-z0-9_]+)"


def tokenize(text: str | Column) -> Column:
    """ASCII word tokens in order, duplicates kept. Extracted before lower-casing, so that case folding can't create tokens."""
    col = F.col(text) if isinstance(text, str) else text
    return F.transform(F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(TOKEN), F.lit(1)), lambda t: F.lower(t))


def split_identifier(token: Column) -> Column:
    """Snake and camel pieces of an identifier, lower-cased; empty pieces are dropped."""
    spaced = F.regexp_replace(token, "([a-z0-9])([A-Z])", "$1_$2")
    spaced = F.regexp_replace(spaced, "([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.filter(F.split(F.lower(spaced), "_+"), lambda p: p != "")


def tokenize_identifiers(text: str | Column) -> Column:
    """Like ``tokenize``, with each token followed by its identifier pieces that differ from it."""
    col = F.col(text) if isinstance(text, str) else text
    raw = F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(TOKEN), F.lit(1))
    return F.flatten(F.transform(raw, lambda t: F.concat(F.array(F.lower(t)), F.filter(split_identifier(t), lambda p: p != F.lower(t)))))


def normalize_query(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0b]+", " "))


def normalize_path(path: Column) -> Column:
    """Forward slashes, no leading ``./`` or ``/``, no doubled slashes."""
    p = F.regexp_replace(F.regexp_replace(F.trim(path), r"\\", "/"), "/{2,}", "/")
    return F.regexp_replace(p, r"^(\./|/)+", "")


def path_matches(a: Column, b: Column) -> Column:
    """Equal, or one is a whole-segment suffix of the other."""
    return (a == b) | F.endswith(a, F.concat(F.lit("/"), b)) | F.endswith(b, F.concat(F.lit("/"), a))


def entity_kind(entity_id: Column) -> Column:
    return F.split_part(entity_id, F.lit(":"), F.lit(1))


def entity_path(entity_id: Column) -> Column:
    return F.split_part(entity_id, F.lit(":"), F.lit(2))


def entity_name(entity_id: Column) -> Column:
    return F.split_part(entity_id, F.lit(":"), F.lit(3))


def cite(path: Column, name: Column) -> Column:
    """``path:name``, or the path alone where there is no name."""
    return F.concat(path, F.when(F.length(name) > 0, F.concat(F.lit(":"), name)).otherwise(F.lit("")))


def slug(text: Column, most: int = 48) -> Column:
    """Lower-case letters and digits joined by single hyphens, at most ``most`` characters; ``item`` if nothing is left."""
    s = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    s = F.regexp_replace(F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, most), "-+$", "")
    return F.when(s == "", F.lit("item")).otherwise(s)


def snippet(text: Column, term: Column, lead: int = 32, width: int = 160) -> Column:
    """``width`` characters from ``lead`` before the first place of ``term`` (case ignored), with dots where text is cut."""
    at = F.call_function("instr", F.lower(text), F.lower(term))
    start = F.greatest(at - lead, F.lit(1))
    body = F.substr(text, start, F.lit(width))
    return F.concat(F.when(start > 1, F.lit("...")).otherwise(F.lit("")), body, F.when(F.length(text) > start + width - 1, F.lit("...")).otherwise(F.lit("")))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(text) / 4).cast("long")


def overlap_share(tokens: Column, query_tokens: Column) -> Column:
    """Share of the distinct query tokens that the text has; 0 for an empty query."""
    q = F.array_distinct(query_tokens)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens)) / F.size(q)).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(both_empty))


def logistic(x: Column, scale: float = 5.0) -> Column:
    return 1 / (1 + F.exp(-x / scale))


def fence_language(path: Column) -> Column:
    """The fence label of a file by its suffix, else empty."""
    known = {"py": "python", "js": "javascript", "ts": "typescript", "go": "go", "rs": "rust", "java": "java", "kt": "kotlin", "rb": "ruby", "php": "php", "c": "c", "h": "c", "cpp": "cpp", "md": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml", "sh": "bash"}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))), F.lit(""))
