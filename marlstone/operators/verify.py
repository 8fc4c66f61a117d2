"""Answer validity and completion criteria."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import normalize_path

# What counts as a citation and as a claimed relation.
SUFFIXES = ("py", "js", "ts", "tsx", "jsx", "go", "rs", "java", "rb", "md")
REFERENCE = r"(?<![A-Za-z0-9_/])([A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)*\.(?:" + "|".join(SUFFIXES) + r"))(?::([A-Za-z_][A-Za-z0-9_.]*))?"
NAME = r"`?([A-Za-z_][A-Za-z0-9_.]*)`?"
RELATIONS = {"calls": r"calls", "inherits": r"inherits", "tested_by": r"(?:is\s+)?tested by"}


def cited_references(answers: DataFrame) -> DataFrame:
    """``answer_id, path, symbol`` (empty where none is named), each once; paths are normalised."""
    found = F.arrays_zip(F.regexp_extract_all("text", F.lit(REFERENCE), F.lit(1)).alias("p"), F.regexp_extract_all("text", F.lit(REFERENCE), F.lit(2)).alias("s"))
    rows = answers.select("answer_id", F.explode(found).alias("r"))
    return rows.select("answer_id", normalize_path(F.col("r.p")).alias("path"), F.coalesce(F.col("r.s"), F.lit("")).alias("symbol")).distinct()


def claimed_relations(answers: DataFrame) -> DataFrame:
    """``answer_id, src, rel, dst, raw``: each claim once, ``raw`` as it was said first."""

    def said(rel: str, verb: str) -> Column:
        pattern = F.lit(rf"(?i){NAME}\s+{verb}\s+{NAME}")
        parts = F.arrays_zip(*[F.regexp_extract_all("text", pattern, F.lit(i)).alias(n) for i, n in ((1, "src"), (2, "dst"), (0, "raw"))])
        return F.transform(parts, lambda c: F.struct(c["src"].alias("src"), F.lit(rel).alias("rel"), c["dst"].alias("dst"), F.trim(c["raw"]).alias("raw")))

    claims = answers.select("answer_id", F.posexplode(F.concat(*[said(r, v) for r, v in RELATIONS.items()])).alias("_at", "_c")).select("answer_id", "_at", "_c.*")
    return claims.groupBy("answer_id", "src", "rel", "dst").agg(F.min_by("raw", "_at").alias("raw"))


def _key(name: Column) -> Column:
    return F.lower(F.element_at(F.split(F.trim(name), r"\."), -1))


def _tails(path: Column) -> Column:
    """The path, and what follows each of its slashes."""
    pieces = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda i: F.array_join(F.slice(pieces, i, F.size(pieces)), "/"))


def resolve_names(wanted: DataFrame, records: DataFrame) -> DataFrame:
    """``name, id``: records whose last name part equals that of ``name`` (case ignored); where there is none, those whose id ends in
    ``:name`` or ``.name``."""
    names = wanted.select("name").distinct()
    direct = names.withColumn("_k", _key(F.col("name"))).join(records.select("id", _key(F.col("name")).alias("_k")).where("_k <> ''"), "_k").select("name", "id")
    # Every end of an id that follows a colon or a stop, so that the match is an equi-join.
    pieces = F.split("id", r"(?<=[:.])")
    ends = F.transform(F.sequence(F.lit(2), F.size(pieces)), lambda i: F.array_join(F.slice(pieces, i, F.size(pieces)), ""))
    tails = records.where(F.size(pieces) > 1).select("id", F.explode(ends).alias("name"))
    return direct.unionByName(names.join(direct.select("name").distinct(), "name", "left_anti").join(tails, "name")).distinct()


def borne_out(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """The distinct ``path, symbol`` of ``wanted`` that a row of ``have`` (``id, name, _have``) bears out; see ``validity_flags``.

    Both sides are keyed by path and by what the symbol has to equal, and each key is kept once, so that a file of many names, or a name of many files, makes
    no pairs. Paths match where the one is among the other's tails. The last part of a name says all of a match by name: names that are equal, or end in a
    stop and the symbol, have it in common.
    """
    symbol, mark = F.col("symbol"), lambda kind, x: F.concat(F.lit(kind), x)
    asked = F.when(symbol == "", F.array(F.lit("p"))).otherwise(F.array(mark("n", _key(symbol)), mark("i", symbol), mark("c", F.concat(F.col("path"), F.lit(":"), symbol))))
    want = wanted.select("path", "symbol", F.explode(asked).alias("_m"))
    pieces = F.split("id", ":")
    last = F.when(F.size(pieces) > 1, mark("i", F.element_at(pieces, -1)))
    own = have.select("_have", F.explode(F.array_compact(F.array(F.lit("p"), mark("n", _key(F.col("name"))), last))).alias("_m"))
    # An id that holds ":path:" and something that begins with the symbol: only where such a path is cited, and only to a cited length.
    inner = have.where(F.size(pieces) > 2).select("_have", F.posexplode(pieces).alias("_i", "path"), pieces.alias("_p")).where((F.col("_i") > 0) & (F.col("_i") < F.size("_p") - 1))
    inner = inner.select("_have", "path", F.get("_p", F.col("_i") + 1).alias("_s")).distinct()
    lengths = wanted.where("symbol <> ''").groupBy("path").agg(F.collect_set(F.length("symbol")).alias("_n"))
    begun = inner.join(lengths, "path").select("_have", "path", "_s", F.explode("_n").alias("_n")).where("_n <= length(_s)")
    own = own.unionByName(begun.select("_have", mark("c", F.concat(F.col("path"), F.lit(":"), F.substring("_s", F.lit(1), F.col("_n")))).alias("_m"))).distinct()
    longer = own.select(F.explode(_tails(F.col("_have"))).alias("path"), "_m").distinct()
    shorter = want.withColumn("_have", F.explode(_tails(F.col("path"))))
    return want.join(longer, ["path", "_m"], "left_semi").select("path", "symbol").unionByName(shorter.join(own, ["_have", "_m"], "left_semi").select("path", "symbol")).distinct()


def validity_flags(answers: DataFrame, records: DataFrame, edges: DataFrame) -> DataFrame:
    """``answer_id, kind, citation``: citations that no record bears out (``missing_symbol`` where a symbol is named, else ``missing_path``) and
    claimed relations between known names that no edge has (``contradicted_edge``).

    ``records``: ``id, name, file_path``; ``edges``: ``src, rel, dst`` of ids. A record bears a citation out if one path ends in the other and
    the symbol is its name, ends it, has its last part (case ignored) or ends its id.
    """
    refs = cited_references(answers)
    have = records.select("id", F.trim("name").alias("name"), normalize_path(F.col("file_path")).alias("_have")).where("_have <> ''").distinct()
    known = borne_out(refs.select("path", "symbol").distinct(), have)
    symbol = F.col("symbol")
    lost = refs.join(known, ["path", "symbol"], "left_anti")
    missing = lost.select("answer_id", F.when(symbol == "", "missing_path").otherwise("missing_symbol").alias("kind"), F.concat_ws(":", "path", F.nullif(symbol, F.lit(""))).alias("citation"))

    claims = claimed_relations(answers)
    ids = resolve_names(claims.select(F.col("src").alias("name")).unionByName(claims.select(F.col("dst").alias("name"))), records)
    both = claims.join(ids.select(F.col("name").alias("src"), F.col("id").alias("_s")), "src").join(ids.select(F.col("name").alias("dst"), F.col("id").alias("_d")), "dst")
    drawn = edges.select(F.col("src").alias("_s"), "rel", F.col("dst").alias("_d"), F.lit(1).alias("_e")).distinct()
    checked = both.join(drawn, ["_s", "rel", "_d"], "left").groupBy("answer_id", "src", "rel", "dst").agg(F.max("_e").alias("_e"), F.first("raw").alias("raw"))
    wrong = checked.where("_e is null").select("answer_id", F.lit("contradicted_edge").alias("kind"), F.col("raw").alias("citation"))
    return missing.unionByName(wrong).distinct()


def check_criteria(criteria: DataFrame, files: DataFrame, results: DataFrame) -> DataFrame:
    """``criteria``: ``id, kind, check, expect``; ``files``: ``path, content``; ``results``: ``id, exit_code, value`` from outside - nothing is
    executed here. Adds ``met``: false unless shown. ``file``: the path exists; ``contains``: its content has ``expect``; ``command``: exit code 0;
    ``coverage``: value of at least ``expect``; other kinds stay false."""
    f = files.select(normalize_path(F.col("path")).alias("_p"), F.col("content").alias("_c"))
    rows = criteria.drop("met").join(f, normalize_path(F.col("check")) == F.col("_p"), "left").join(results, "id", "left")
    met = (
        F.when(F.col("kind") == "file", F.col("_p").isNotNull())
        .when(F.col("kind") == "contains", F.contains("_c", "expect"))
        .when(F.col("kind") == "command", F.col("exit_code") == 0)
        .when(F.col("kind") == "coverage", F.col("value") >= F.try_to_number("expect", F.lit("999999.999")))
    )
    return rows.withColumn("met", F.coalesce(met, F.lit(False))).drop("_p", "_c", "exit_code", "value")
