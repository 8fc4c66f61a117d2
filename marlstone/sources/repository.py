"""Source trees: discovery, parsing into entities, chunking. Files are read by Spark, so any store that it reads will do."""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LANGUAGES = {
    "py": "python", "js": "js", "jsx": "js", "ts": "js", "tsx": "js", "go": "go", "rs": "rust", "java": "java", "kt": "java", "scala": "java",
    "c": "c", "h": "c", "cpp": "c", "hpp": "c", "cc": "c", "rb": "ruby", "php": "php", "md": "doc", "rst": "doc", "json": "data",
    "yaml": "data", "yml": "data", "toml": "data", "cs": "any", "swift": "any",
}
EXCLUDED = ("node_modules", "__pycache__", "venv", "dist", "build", "target", "vendor")
MOST_BYTES = 512 * 1024

FILE_SCHEMA = "repo string, path string, ext string, language string, size long, n_lines int, content string"
ENTITY_SCHEMA = (
    "entity_id string, name string, type string, file_path string, start_line int, end_line int, docstring string, source_code string, "
    "params array<string>, bases array<string>, methods array<string>, imports array<string>, refs array<string>, `class` string, kind string, ordinal long"
)


def discover_files(spark: SparkSession, root: str, repo: str, excluded: tuple[str, ...] = EXCLUDED, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The ``files`` table of a tree: known suffixes, ``most_bytes`` at most, no excluded or dotted folder. Undecodable bytes are replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    full = F.regexp_replace("path", "^[a-z]+:/*", "/")
    base = re.sub("^[a-z]+:/*", "/", root).rstrip("/")
    rel = F.regexp_replace(full, F.lit("^" + re.escape(base) + "/"), F.lit(""))
    rows = files.where(F.col("length") <= most_bytes).withColumn("rel", rel).withColumn("ext", F.lower(F.regexp_extract("rel", r"\.([A-Za-z0-9]+)$", 1)))
    parts = F.split("rel", "/")
    rows = rows.where(F.col("ext").isin(*LANGUAGES) & ~F.exists(parts, lambda p: p.isin(*excluded) | F.startswith(p, F.lit("."))))
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])

    @F.pandas_udf("string")
    def text(data: pd.Series) -> pd.Series:
        return data.map(lambda b: bytes(b).decode("utf-8", "replace"))

    rows = rows.withColumn("content", text("content"))
    return rows.select(
        F.lit(repo).alias("repo"), F.col("rel").alias("path"), "ext", table[F.col("ext")].alias("language"), F.col("length").alias("size"),
        F.size(F.split("content", "\n")).alias("n_lines"), "content",
    )


def _entity(kind: str, path: str, name: str, start: int, end: int, source: str, /, **more) -> dict:
    return {
        "entity_id": f"{more.pop('prefix', kind)}:{path}:{more.pop('full', name)}", "name": name, "type": kind, "file_path": path, "start_line": start, "end_line": end,
        "docstring": "", "source_code": source, "params": [], "bases": [], "methods": [], "imports": [], "refs": [], "class": None, "kind": "",
    } | more


def _python(path: str, source: str) -> list[dict]:
    tree, lines, out = ast.parse(source), source.split("\n"), []
    owner = {f: c.name for c in ast.walk(tree) if isinstance(c, ast.ClassDef) for f in c.body if isinstance(f, ast.FunctionDef | ast.AsyncFunctionDef)}
    for node in ast.walk(tree):
        if not isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
            continue
        text = "\n".join(lines[node.lineno - 1 : node.end_lineno])
        doc = ast.get_docstring(node) or ""
        names = sorted({n.id for n in ast.walk(node) if isinstance(n, ast.Name)} | {n.attr for n in ast.walk(node) if isinstance(n, ast.Attribute)})
        calls = sorted({n.name.rpartition(".")[2] for i in ast.walk(node) if isinstance(i, ast.Import | ast.ImportFrom) for n in i.names})
        if isinstance(node, ast.ClassDef):
            bases = [ast.unparse(b).rpartition(".")[2] for b in node.bases]
            methods = [f.name for f in node.body if isinstance(f, ast.FunctionDef | ast.AsyncFunctionDef)]
            out.append(_entity("class", path, node.name, node.lineno, node.end_lineno, text, docstring=doc, bases=bases, methods=methods))
        else:
            params, own = [a.arg for a in node.args.args], owner.get(node)
            more = {"docstring": doc, "params": params, "refs": names, "imports": calls}
            kind, prefix, full = ("method", "method", f"{own}.{node.name}") if own else ("function", "func", node.name)
            out.append(_entity(kind, path, node.name, node.lineno, node.end_lineno, text, prefix=prefix, full=full, **({"class": own} if own else {}), **more))
    return out


def block_end(source: str, at: int) -> int:
    """Offset after the brace block that opens at or after ``at``; strings are skipped; the end of the text if it never closes."""
    depth, quote, i = 0, "", at
    while i < len(source):
        c = source[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote or (c == "\n" and quote != "`"):
                quote = ""
        elif c in "\"'`":
            quote = c
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0:
                return i + 1
        elif c == ";" and depth == 0:
            return i + 1
        i += 1
    return len(source)


_KEYWORDS = frozenset("if for while switch catch return else do try new await function sizeof throw synchronized super this".split())
_CLASS = r"^[ \t]*(?:(?:export|default|public|private|protected|internal|static|final|abstract|sealed|data|open|template|partial)\s+)*(?:class|interface|trait|struct|object|enum)\s+(?P<name>\w+)(?:[^\n{]*?(?:extends|:)\s*(?:public\s+)?(?P<base>\w+))?"
_RULES = {
    "js": [("class", _CLASS), ("function", r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>\w+)\s*\("), ("function", r"^[ \t]*(?:export\s+)?(?:const|let|var)\s+(?P<name>\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>"), ("method", r"^[ \t]+(?:async\s+|static\s+)*(?P<name>\w+)\s*\([^)\n]*\)\s*\{")],
    "go": [("class", r"^type\s+(?P<name>\w+)\s+(?:struct|interface)\b"), ("function", r"^func\s+(?:\([^)]*\)\s*)?(?P<name>\w+)\s*[\[(]")],
    "rust": [("class", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+(?P<name>\w+)"), ("function", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*fn\s+(?P<name>\w+)")],
    "java": [("class", _CLASS), ("method", r"^[ \t]+(?:(?:public|private|protected|static|final|abstract|synchronized|override|suspend)\s+)*(?:fun\s+|def\s+)?(?:[\w<>\[\], ?]+\s+)?(?P<name>\w+)\s*\([^;{}\n]*\)[^;{}\n]*\{")],
    "c": [("class", r"^[ \t]*(?:typedef\s+)?(?:class|struct)\s+(?P<name>\w+)\s*(?::[^{\n]*?(?P<base>\w+)\s*)?\{"), ("function", r"^(?:[A-Za-z_][\w:<>,*& \t]*[ \t*&])(?P<name>\w+)\s*\([^;{}]*\)\s*(?:const\s*)?\{")],
    "php": [("class", _CLASS), ("function", r"^[ \t]*(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+&?(?P<name>\w+)\s*\(")],
    "any": [("class", _CLASS), ("function", r"^[ \t]*(?:(?:public|private|internal|static|override|async)\s+)*(?:func|fn|fun|def|function)\s+(?P<name>\w+)")],
}
_COMPILED = {k: [(t, re.compile(p, re.M)) for t, p in v] for k, v in _RULES.items()}


def _braces(language: str, path: str, source: str) -> list[dict]:
    out, seen = [], set()
    for kind, pattern in _COMPILED[language]:
        for m in pattern.finditer(source):
            name, start = m["name"], source.count("\n", 0, m.start("name")) + 1
            if name in _KEYWORDS or (start, name) in seen:
                continue
            seen.add((start, name))
            stop = block_end(source, m.start("name"))
            base = m.groupdict().get("base")
            text = source[m.start() : stop]
            words = sorted(set(re.findall(r"[A-Za-z_]\w*", text)) - {name} - _KEYWORDS)
            out.append(_entity(kind, path, name, start, source.count("\n", 0, stop) + 1, text, prefix={"function": "func"}.get(kind, kind), bases=[base] if base else [], refs=[] if kind == "class" else words))
    return sorted(out, key=lambda e: (e["start_line"], e["name"]))


def _ruby(path: str, source: str) -> list[dict]:
    lines, out = source.split("\n"), []
    for i, line in enumerate(lines):
        if m := re.match(r"^(\s*)(class|module|def)\s+(?:self\.)?([\w]+[?!=]?)(?:\s*<\s*(\w+))?", line):
            end = next((j for j in range(i + 1, len(lines)) if re.match(rf"^{m[1]}end\b", lines[j])), len(lines) - 1)
            kind = "function" if m[2] == "def" else "class"
            out.append(_entity(kind, path, m[3], i + 1, end + 1, "\n".join(lines[i : end + 1]), prefix={"function": "func"}.get(kind, kind), bases=[m[4]] if m[4] else []))
    return out


def _sections(path: str, source: str) -> list[dict]:
    lines = source.split("\n")
    heads = [i for i, x in enumerate(lines) if re.match(r"^#{1,6}\s+\S", x) or (i + 1 < len(lines) and x.strip() and re.match(r"^(={3,}|-{3,})\s*$", lines[i + 1]))]
    cuts = sorted({0, *heads})
    out = []
    for a, b in zip(cuts, [*cuts[1:], len(lines)], strict=True):
        text = "\n".join(lines[a:b]).strip("\n")
        if text.strip():
            title = lines[a].lstrip("#").strip() or path.rpartition("/")[2]
            out.append(_entity("documentation", path, title, a + 1, b, text, prefix="doc", kind="wiki" if "/wiki/" in f"/{path}" else ""))
    return out


def parse_source(path: str, language: str, source: str) -> list[dict]:
    """A file entity, then the entities of its language; a syntax error falls back to the general patterns."""
    whole = _entity("file", path, path.rpartition("/")[2], 1, source.count("\n") + 1, source, full=path.rpartition("/")[2])
    try:
        if language == "python":
            found = _python(path, source)
        elif language == "doc":
            found = _sections(path, source)
        elif language == "ruby":
            found = _ruby(path, source)
        else:
            found = _braces(language, path, source) if language in _COMPILED else []
    except (SyntaxError, ValueError, RecursionError):
        found = _braces("any", path, source)
    return [whole, *found]


def parse_repository(files: DataFrame) -> DataFrame:
    """The ``entities`` table; ``ordinal`` orders them by path, then place in the file, whatever the partitioning."""
    columns = [c.split()[0].strip("`") for c in ENTITY_SCHEMA.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, language, content in zip(b["path"], b["language"], b["content"], strict=True):
                out += [e | {"ordinal": i} for i, e in enumerate(parse_source(path, language, content or ""))]
            yield pd.DataFrame(out, columns=columns)

    # One narrow row a file: the order of paths is found without a shuffle of sources. Range partitioning numbers them in parallel.
    places = files.select("path").distinct().repartitionByRange("path").sortWithinPartitions("path").select(F.col("path").alias("_p"), F.monotonically_increasing_id().alias("_place"))
    parsed = files.select("path", "language", "content").mapInPandas(parse, ENTITY_SCHEMA)
    ordered = parsed.join(places, F.col("file_path") == F.col("_p")).withColumn("ordinal", F.col("_place") * (1 << 16) + F.col("ordinal"))
    return ordered.select(*columns)


CHUNK_SCHEMA = (
    "chunk_id string, content string, entity_id string, entity_name string, entity_type string, file_path string, start_line int, end_line int, "
    "docstring string, repo_name string, section string, kind string"
)


def line_windows(lines: list[str], most: int = 1500, least: int = 50, overlap: int = 20) -> list[tuple[int, int]]:
    """Half-open line ranges: lines while they fit ``most`` characters (newlines counted) once ``least`` are held; the next begins ``overlap``
    lines before the end, but always goes forward; the last one reaches the end."""
    if sum(len(x) + 1 for x in lines) - 1 <= most:
        return [(0, len(lines))]
    out, start = [], 0
    while start < len(lines):
        end, size = start, 0
        while end < len(lines) and (size + len(lines[end]) + 1 <= most or size < least):
            size += len(lines[end]) + 1
            end += 1
        out.append((start, end))
        if end >= len(lines):
            break
        start = max(start + 1, end - overlap)
    return out


def chunk_entity(e: dict, most: int = 1500, least: int = 50, least_lines: int = 50, overlap: int = 20) -> list[tuple[str, str, int, int]]:
    """Label, text, first and last line of the chunks of an entity."""
    lines = e["source_code"].split("\n")
    first = e["start_line"]
    if e["type"] == "class" and len(e["source_code"]) > most:
        out = [("header", f"{lines[0]}\n    ...", first, first)]
        start = 1
        while start < len(lines):
            end, size = start, 0
            while end < len(lines) and (size + len(lines[end]) + 1 <= most or end - start < least_lines):
                size += len(lines[end]) + 1
                end += 1
            out.append(("body", "\n".join([lines[0], *lines[start:end]]), first + start, first + end - 1))
            if end >= len(lines):
                break
            start = max(start + 1, end - overlap)
        return out
    if e["type"] in ("file", "documentation"):
        return [("chunk" if e["type"] == "file" else "section", "\n".join(lines[a:b]), first + a, first + b - 1) for a, b in line_windows(lines, most, least, overlap)]
    return [("chunk", e["source_code"], first, e["end_line"])]


def chunk_entities(entities: DataFrame, repo: str, most: int = 1500, least: int = 50, overlap: int = 20) -> DataFrame:
    """The ``chunks`` table. A chunk's id ends in eight hex digits of its entity, number and text, so indexing again gives the same ids."""

    def chunk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for e in b.to_dict("records"):
                for i, (label, text, start, end) in enumerate(chunk_entity(e, most, least, overlap=overlap)):
                    mark = hashlib.sha256(f"{e['entity_id']}\x1f{i}\x1f{text}".encode()).hexdigest()[:8]
                    tag = "" if label == "chunk" else f"{label}:"
                    out.append((f"{e['entity_id']}:{tag}{mark}", text, e["entity_id"], e["name"], e["type"], e["file_path"], start, end, e["docstring"], repo, label, e["kind"]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CHUNK_SCHEMA.split(", ")])

    return entities.select("entity_id", "name", "type", "file_path", "start_line", "end_line", "docstring", "source_code", "kind").mapInPandas(chunk, CHUNK_SCHEMA)


def sliding_chunks(docs: DataFrame, id_col: str, text_col: str, most: int = 1500, least: int = 50, overlap: int = 20) -> DataFrame:
    """``id, chunk_no, start_line, end_line, n_chars`` of the line windows of plain texts."""
    kind = docs.schema[id_col].dataType.simpleString()

    def chunk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, t in zip(b[id_col], b[text_col], strict=True):
                lines = (t or "").split("\n")
                out += [(i, n, a + 1, z, len("\n".join(lines[a:z]))) for n, (a, z) in enumerate(line_windows(lines, most, least, overlap))]
            yield pd.DataFrame(out, columns=[id_col, "chunk_no", "start_line", "end_line", "n_chars"]).astype({id_col: b[id_col].dtype})

    return docs.select(id_col, text_col).mapInPandas(chunk, f"{id_col} {kind}, chunk_no int, start_line int, end_line int, n_chars int")
