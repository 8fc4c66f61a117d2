"""Result cache, content fingerprints and dirty sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import normalize_query


def cache_key(query: Column, knobs: dict[str, object], version: int = 0) -> Column:
    """SHA-256 over the normalised query, every result-affecting knob (by name) and the index version."""
    stamp = ";".join(f"{k}={knobs[k]}" for k in sorted(knobs))
    return F.sha2(F.concat_ws("\n", normalize_query(query), F.lit(stamp), F.lit(str(version))), 256)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of one key in ``old``."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def lookup(requests: DataFrame, cache: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """Hits (with their payload) and misses."""
    return requests.join(cache, key), requests.join(cache.select(key), key, "left_anti")


def content_fingerprint(rows: DataFrame, group: str, *parts: str) -> DataFrame:
    """``group, fingerprint`` (16 hex digits) over the group's rows in any order: each row is hashed first, so a group of any size costs
    four sums of 60 bits of the hashes and a count, never its contents."""
    line = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]), 256)
    hashed = rows.select(group, line.alias("_h"))
    parts = [F.sum(F.conv(F.substring("_h", 1 + 15 * i, 15), 16, 10).cast("decimal(28,0)")).alias(f"s{i}") for i in range(4)]
    sums = hashed.groupBy(group).agg(*parts, F.count("*").alias("n"))
    return sums.select(group, F.substring(F.sha2(F.concat_ws(":", *[F.col(c).cast("string") for c in ("s0", "s1", "s2", "s3", "n")]), 256), 1, 16).alias("fingerprint"))


def dirty_set(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """``key, state``: added, removed or changed; equal fingerprints drop out."""
    b, a = before.select(key, F.col("fingerprint").alias("was")), after.select(key, F.col("fingerprint").alias("now"))
    both = b.join(a, key, "full_outer").where(~F.col("was").eqNullSafe(F.col("now")))
    return both.select(key, F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed").alias("state"))


def live_entries(entries: DataFrame, epochs: DataFrame) -> DataFrame:
    """Entries of their repository's current epoch; a bump leaves older ones behind. ``epochs``: ``repo, epoch``, of which the greatest holds."""
    now = epochs.groupBy("repo").agg(F.max("epoch").alias("epoch"))
    return entries.join(now, ["repo", "epoch"], "left_semi")


def rates(lookups: DataFrame, by: str) -> DataFrame:
    """``by, n, hit_rate, verify_rate, invalid_rate`` over ``hit, verified, citations, invalid``: shares of hits, of verified among the checked, and
    of invalid among all citations; null where there is nothing to share."""
    share = lambda a, b: F.when(b > 0, a / b)
    yes = lambda c: F.sum(F.col(c).cast("int"))
    return lookups.groupBy(by).agg(
        F.count("*").alias("n"), share(yes("hit"), F.count("hit")).alias("hit_rate"), share(yes("verified"), F.count("verified")).alias("verify_rate"), share(F.sum("invalid"), F.sum("citations")).alias("invalid_rate")
    )
