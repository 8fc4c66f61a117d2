"""The frozen front of a prompt: sections in a fixed order, and digests that tell when one of them changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The order of the sections, and the length of a digest.
SECTIONS = ("system", "tools", "project_docs", "memory_brief", "knowledge_prefix")
DIGEST = 12


def digest(text: Column) -> Column:
    return F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, DIGEST)


def assemble(sections: DataFrame, by: str) -> DataFrame:
    """``by, prefix, digest`` over ``by, section, text``: the sections that have text, in their order, a blank line between them."""
    place = F.array_position(F.lit(list(SECTIONS)), F.col("section"))
    rows = sections.where((place > 0) & (F.coalesce("text", F.lit("")) != ""))
    listed = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(place.alias("p"), F.regexp_replace("text", r"\s+$", "").alias("t")))).alias("_l"))
    joined = listed.select(by, F.concat(F.array_join(F.transform("_l", lambda s: s["t"]), "\n\n"), F.lit("\n")).alias("prefix"))
    return joined.withColumn("digest", digest(F.col("prefix")))


def changed(before: DataFrame, after: DataFrame, by: str) -> DataFrame:
    """``by, section``: sections whose digest differs, is new or gone. Inputs: ``by, section, text``."""
    b, a = (df.select(by, "section", digest(F.col("text")).alias(n)) for df, n in ((before, "was"), (after, "now")))
    return b.join(a, [by, "section"], "full_outer").where(~F.col("was").eqNullSafe(F.col("now"))).select(by, "section")
