"""Mixing sources to target weights by hash-threshold histograms.

Each document has a fixed 64-bit hash; a source takes all documents below a threshold. Token sums by source and
hash bucket give the bucket where a budget runs out, and only that bucket is split further, until it holds one
hash value. Nothing is sorted, a larger budget always takes what a smaller one takes, and reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import documents, materialize, text_or_empty

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
#: Bits of the hash that each histogram level resolves; they add up to 64.
LEVEL_BITS = (16, 16, 16, 16)


def word_count(text: str = "text") -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` runs: white space is mapped to blanks, then the starts of words are counted."""
    flat = F.regexp_replace(F.concat(F.lit(" "), text_or_empty(text)), r"[\x20\x09-\x0D]+", " ")
    return (F.octet_length(flat) - F.octet_length(F.replace(flat, F.lit(" "), F.lit(""))) - F.endswith(flat, F.lit(" ")).cast("int")).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``sizes`` has one row for each source: ``source, source_size``. Returns ``source, source_size, target``.

    Sources by code point (null last) weigh ``weights``, repeating, and share ``share`` times all sizes; a target stops
    at ``cap`` times its source's size and the excess is reshared by weight until none is above. Filling up by rising
    ``cap * size / weight`` reaches that fixed point in one pass: the capped sources are a prefix of this order.
    The windows run over one row for each source, never over documents, and all sources meet in one task: they name collections, some
    millions of which a task can hold.
    """
    every = Window.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    pick = F.lit([float(w) for w in weights])
    ranked = sizes.withColumn("_w", F.get(pick, (F.row_number().over(every) - 1) % F.lit(len(weights))))
    ranked = ranked.withColumn("_cap", F.col("source_size") * F.lit(float(cap))).withColumn("_r", F.col("_cap") / F.col("_w"))
    rising = Window.orderBy("_r", F.col("source").isNull(), "source")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    rest = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_rows = Window.partitionBy()
    ranked = ranked.withColumn("_all", F.sum("source_size").over(all_rows) * F.lit(float(share)))
    ranked = ranked.withColumn(
        "_level", (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(rest)
    ).withColumn("_open", F.col("_r") > F.col("_level"))
    # The level of the first source that stays below its cap is the water line.
    line = F.first(F.when(F.col("_open"), F.col("_level")), ignorenulls=True).over(
        rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    ranked = ranked.withColumn("_line", line)
    target = F.when(F.col("_line").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_line") * F.col("_w")))
    return ranked.select("source", "source_size", target.cast("double").alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """For each row of ``budgets`` (``source, budget``) the hash threshold that takes about ``budget`` words.

    ``sized``: ``source, size, h`` with ``h`` an unsigned hash in ``[0, 2**64)`` kept as two longs (``hi`` 32 bits, ``lo``
    32 bits). Returns ``source, t_hi, t_lo, t_all``: documents with ``(hi, lo) < (t_hi, t_lo)`` are taken, all if ``t_all``.
    """
    shifts = []
    left = 64
    for bits in LEVEL_BITS:
        left -= bits
        shifts.append((left, bits))

    def bucket(shift: int, bits: int) -> Column:
        word, at = ("hi", shift - 32) if shift >= 32 else ("lo", shift)
        return F.shiftright(F.col(word), at).bitwiseAND(F.lit(2**bits - 1))

    state = budgets.select("source", F.col("budget").cast("double").alias("_left"), F.lit(0).cast("long").alias("_hi"), F.lit(0).cast("long").alias("_lo"))
    inside = sized
    for shift, bits in shifts:
        hist = inside.groupBy("source", bucket(shift, bits).alias("_b")).agg(F.sum("size").alias("_words"))
        run = Window.partitionBy("source").orderBy("_b")
        hist = hist.withColumn("_end", F.sum("_words").over(run)).withColumnRenamed("source", "_s")
        joined = state.join(hist, F.col("source").eqNullSafe(F.col("_s")))
        # The boundary bucket is the first whose running sum passes the budget.
        edge = joined.where(F.col("_end") > F.col("_left")).groupBy("source", "_left", "_hi", "_lo").agg(F.min(F.struct("_b", "_end", "_words")).alias("_e"))
        b = F.col("_e._b") * F.lit(2 ** (shift - 32 if shift >= 32 else shift))
        state = edge.select(
            "source",
            (F.col("_left") - (F.col("_e._end") - F.col("_e._words"))).alias("_left"),
            (F.col("_hi") + (b if shift >= 32 else F.lit(0))).alias("_hi"),
            (F.col("_lo") + (b if shift < 32 else F.lit(0))).alias("_lo"),
            F.col("_e._words").alias("_words"),
        )
        # One row a source: small enough to be joined without moving the documents when Spark's size check allows it.
        state = materialize(state, "mix")
        if shift:
            last = state.select(F.col("source").alias("_s"), "_hi", "_lo")
            same = bucket(shift, bits) == F.shiftright(F.col("_hi" if shift >= 32 else "_lo"), shift - 32 if shift >= 32 else shift).bitwiseAND(F.lit(2**bits - 1))
            inside = inside.join(last, F.col("source").eqNullSafe(F.col("_s")) & same).select("source", "size", "hi", "lo")
            inside = materialize(inside, "mix")
        state = state.drop("_words") if shift else state
    # The boundary is one hash value now; it is taken if that comes nearer to the budget.
    step = (F.col("_left") * 2 >= F.col("_words")).cast("long")
    lo = F.col("_lo") + step
    full = budgets.select(F.col("source").alias("_s"))
    return (
        full.join(state, F.col("source").eqNullSafe(F.col("_s")), "left")
        .select(
            F.col("_s").alias("source"),
            F.when(lo >= 2**32, F.col("_hi") + 1).otherwise(F.col("_hi")).alias("t_hi"),
            F.when(lo >= 2**32, F.lit(0)).otherwise(lo).cast("long").alias("t_lo"),
            F.col("_left").isNull().alias("t_all"),
        )
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per input row: ``id_col, source, size, source_size, target, copies, taken``.

    A source with target ``q`` times its size takes every document ``floor(q)`` times and those below its hash threshold
    once more; ``taken = copies * size``. Null or empty texts have size 0 and follow the same threshold. A null source is a
    source of its own, the last. Rows with one id share their hash and stay together. Extra columns are ignored; an empty table
    gives no rows. The threshold hits the target to half of the words that share one hash value, one document as a rule.
    """
    spread = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    sized = materialize(
        docs.select(
            F.col(id_col).alias("_id"),
            F.col(source_col).alias("source"),
            word_count(text_col).alias("size"),
            F.conv(F.substring(spread, 1, 8), 16, 10).cast("long").alias("hi"),
            F.conv(F.substring(spread, 9, 8), 16, 10).cast("long").alias("lo"),
        ),
        "sized",
    )
    targets = materialize(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap), "targets")
    whole = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))
    targets = targets.withColumn("_whole", whole.cast("long"))
    cut = thresholds(sized, targets.select("source", (F.col("target") - F.col("_whole") * F.col("source_size")).alias("budget")))
    plan = targets.join(cut.withColumnRenamed("source", "_c"), F.col("source").eqNullSafe(F.col("_c"))).drop("_c").withColumnRenamed("source", "_s")
    more = F.coalesce(F.col("t_all") & (F.col("target") > F.col("_whole") * F.col("source_size")), F.lit(False)) | F.coalesce(
        (F.col("hi") < F.col("t_hi")) | ((F.col("hi") == F.col("t_hi")) & (F.col("lo") < F.col("t_lo"))), F.lit(False)
    )
    copies = (F.col("_whole") + more.cast("long")).alias("copies")
    return (
        sized.join(plan, F.col("source").eqNullSafe(F.col("_s")))
        .select(F.col("_id").alias(id_col), "source", "size", "source_size", "target", copies)
        .withColumn("taken", F.col("copies") * F.col("size"))
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(doc_id::VARCHAR) AS m FROM documents),
h AS (SELECT doc_id, source, size, ('0x' || substr(m, 1, 16))::UBIGINT AS h FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM h GROUP BY source),
w AS (SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[((row_number() OVER (ORDER BY source IS NULL, encode(source))) - 1) % 3 + 1] AS w,
             source_size * 2.0::DOUBLE AS cap FROM s),
r AS (SELECT *, cap / w AS r, sum(source_size) OVER () * 1.5::DOUBLE AS t FROM w),
v AS (SELECT *, (t - coalesce(sum(cap) OVER (ORDER BY r, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY r, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
l AS (SELECT arg_min(level, r) AS line FROM v WHERE r > level),
g AS (SELECT source, source_size, CASE WHEN line IS NULL THEN cap ELSE least(cap, line * w) END AS target FROM v LEFT JOIN l ON true),
q AS (SELECT *, floor(target / greatest(source_size, 1))::BIGINT AS whole FROM g),
b AS (SELECT h.source, h.h, sum(h.size) AS words FROM h GROUP BY ALL),
e AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto FROM b),
x AS (SELECT e.source, e.h, target - whole * source_size AS budget, upto - words AS below, upto, words
      FROM e JOIN q ON e.source IS NOT DISTINCT FROM q.source),
c AS (SELECT source, min(h) AS edge, arg_min(budget - below, h) AS rest, arg_min(words, h) AS edge_words FROM x WHERE upto > budget GROUP BY source)
SELECT h.doc_id, h.source, h.size, q.source_size, q.target, k AS copies, k * h.size AS taken
FROM h JOIN q ON h.source IS NOT DISTINCT FROM q.source LEFT JOIN c ON h.source IS NOT DISTINCT FROM c.source,
LATERAL (SELECT whole + CASE WHEN c.edge IS NULL THEN (target > whole * source_size)::INT
  WHEN h.h < c.edge OR (h.h = c.edge AND c.rest * 2 >= c.edge_words) THEN 1 ELSE 0 END AS k)
"""
