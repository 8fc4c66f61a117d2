"""Exact dedup: local dedup, salted digest groups, then a global merge of the salt winners, over full contents.

Built from DataFrame expressions alone. A first pass reads every text once and writes a narrow table of digests. A text alone with its
digest has no equal, so only texts of repeated digests are read again, and their contents are the grouping keys of every merge. Where
one digest turns out to hold several contents, its rows find their class by content too.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import SPACE, documents, materialize, text_or_empty

#: A digest is hot if it holds over this share of all rows (and ``HOT_ROWS`` rows). At most 1 / share digests are, so their list
#: has a proven size and may be broadcast.
HOT_SHARE = 1 / 20_000
HOT_ROWS = 100
SALTS = 64
#: Ids of rows with repeated digests are broadcast up to this many (16 MB); beyond it the texts are joined by shuffle.
BROADCAST_IDS = 1_000_000


def normalized(text: str = "text") -> Column:
    """The text without white space. A chain of byte searches takes less than half the time of ``translate``."""
    return reduce(lambda c, x: F.replace(c, F.lit(x), F.lit("")), SPACE, text_or_empty(text))


def _sha256(norm: Column) -> Column:
    return F.unhex(F.sha2(norm.cast("binary"), 256))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = _sha256,
    hot_share: float = HOT_SHARE,
    salts: int = SALTS,
    broadcast_ids: int = BROADCAST_IDS,
) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    Rows are equal when their texts are, after deleting white space; null counts as empty. Of equal rows the
    one with the most code points stays, then the smallest id (a null id ranks after all others). Repeated rows
    (same id and text) stay or go together. Extra columns are ignored; an empty table gives no rows.
    """
    read = docs.select(F.col(id_col).alias("_id"), F.length(text_or_empty(text_col)).cast("long").alias("_cp"), normalized(text_col).alias("_norm"))
    hashed = read.withColumn("_dig", digest(F.col("_norm")))
    narrow = hashed.select("_id", "_cp", "_dig", (F.col("_dig") if digest is _sha256 else _sha256(F.col("_norm"))).alias("_sha"))
    narrow = materialize(narrow, "digests")
    total = narrow.count()
    repeated = materialize(narrow.groupBy("_dig").agg(F.count("*").alias("_rows")).where("_rows > 1"), "repeated")
    is_hot = F.col("_rows") > max(float(HOT_ROWS), hot_share * total)
    hot = repeated.where(is_hot).select("_dig")

    # Texts that need a comparison: those of a repeated digest. Where the ids of all such rows are few they tell the scan what to keep.
    alike = narrow.join(F.broadcast(hot), "_dig", "left_semi").select("_id").unionByName(
        narrow.join(repeated.where(~is_hot), "_dig", "left_semi").select("_id")
    )
    ids = materialize(alike.where("_id is not null").distinct(), "alike")
    few = ids.count() <= broadcast_ids
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    if few:
        known = F.broadcast(ids.withColumnRenamed("_id", "_alike"))
        texts = texts.join(known, F.col("_id") == F.col("_alike"), "left_semi").unionByName(texts.where("_id is null"))
    held = texts.select("_id", F.length(text_or_empty("_text")).cast("long").alias("_cp"), normalized("_text").alias("_norm"))
    held = held.withColumn("_dig", digest(F.col("_norm")))

    # The winner as one fixed-width value, so that all merges stay in hash aggregation: most code points, least id.
    two64, top = F.lit(str(2**64)).cast("decimal(20,0)"), F.lit(2**63 - 1).cast("decimal(20,0)")
    rank = (F.col("_cp").cast("decimal(17,0)") * two64 + (top - F.coalesce(F.col("_id"), F.lit(2**63 - 1)).cast("decimal(20,0)"))).cast("decimal(38,0)")
    tally = (F.count("*").alias("_n"), F.max(rank).alias("_best"))

    def contents(rows: DataFrame) -> DataFrame:
        # A task has one salt, so its copies of a text meet in the map-side half of this aggregate, the local dedup; the other
        # half merges the salted groups. Only hot digests are salted.
        marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), "_dig", "left")
        salt = F.when(F.col("_hot"), F.pmod(F.spark_partition_id(), F.lit(salts))).otherwise(F.lit(-1))
        local = marked.withColumn("_salt", salt).groupBy("_dig", "_salt", "_norm").agg(*tally)
        return local.groupBy("_dig", "_norm").agg(F.sum("_n").alias("_n"), F.max("_best").alias("_best"))

    if few:
        winners = contents(held)
    else:
        cold = held.join(F.broadcast(hot), "_dig", "left_anti").join(repeated.where(~is_hot), "_dig", "left_semi")
        winners = contents(held.join(F.broadcast(hot), "_dig", "left_semi")).unionByName(cold.groupBy("_dig", "_norm").agg(*tally))
    keep = F.nullif((top - F.col("_best") % two64).cast("long"), F.lit(2**63 - 1)).alias("_keep")
    classes = materialize(winners.select("_dig", "_n", keep), "classes")

    shared = materialize(classes.groupBy("_dig").agg(F.count("*").alias("_texts")).where("_texts > 1").select("_dig"), "collisions")
    several = not shared.isEmpty()
    single = classes.join(shared, "_dig", "left_anti") if several else classes
    rest = narrow.join(shared, "_dig", "left_anti") if several else narrow
    # The verified class of a digest goes back to its rows: to those of hot digests by broadcast, to the others by a join on the digest.
    hot_classes = F.broadcast(single.join(F.broadcast(hot), "_dig", "left_semi"))
    marked = rest.join(hot_classes, "_dig").unionByName(rest.join(F.broadcast(hot), "_dig", "left_anti").join(single.where("_n > 1"), "_dig", "left"), allowMissingColumns=True)
    out = _marks(marked, id_col)
    if several:
        by_text = winners.join(shared, "_dig", "left_semi").select("_dig", "_norm", "_n", keep)
        found = held.join(shared, "_dig", "left_semi").withColumn("_sha", _sha256(F.col("_norm"))).join(by_text, ["_dig", "_norm"])
        out = out.unionByName(_marks(found, id_col))
    return out


def _marks(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.select(
        F.col("_id").alias(id_col),
        F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_n", F.lit(1).cast("long")).alias("group_size"),
        (F.col("_n").isNull() | F.col("_keep").eqNullSafe(F.col("_id"))).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS cp,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY cp DESC, doc_id)
"""
