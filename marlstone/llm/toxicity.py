"""Toxicity: a factorization machine over hashed terms.

``score = sigmoid(w0 + sum w_i + sum_{i<j} <v_i, v_j>)`` over the distinct terms of a text, so that a pair of terms (an insult
and the mention of a group) can weigh what neither weighs alone. Terms are screened by how many texts hold them, never by their own
effect on the label: a term that only counts together with another has none. What keeps rare words from being learned by heart
is shrinkage towards zero of weights and factors and a held-back part of the rows that picks the moment to stop.
"""

from __future__ import annotations

import string
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import documents, labels, small_batches

#: Hash space of the terms; the model is two float32 arrays of this length, about 5 MB to broadcast.
TERM_BITS = 18
FACTORS = 4
#: Labelled rows to fit on at most, those with the smallest hash of their id.
TRAIN_ROWS = 12_000
#: Terms that get weights are those in at least this many, and this share, of the fitted rows.
MIN_DOCS, MIN_SHARE = 3, 0.001
#: Words longer than this also count as their first letters, which inflected forms share.
STEM = 5
_EDGE = string.punctuation + "«»„“”‘’…¡¿–—"


def term_ids(text: str | None, bits: int = TERM_BITS) -> np.ndarray:
    """Sorted distinct hashes of the lower-cased words of the whole text, stripped of punctuation, and of the stems of long words."""
    words = {w.strip(_EDGE) for w in set((text or "").lower().split())}
    words |= {w[:STEM] + "-" for w in words if len(w) > STEM}
    words.discard("")
    mask = (1 << bits) - 1
    return np.unique(np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) & mask for w in words), dtype=np.int32, count=len(words)))


@dataclass
class FactorizationMachine:
    w0: float
    w: np.ndarray
    v: np.ndarray

    def margin(self, ids: np.ndarray) -> float:
        rows = self.v[ids]
        total = rows.sum(axis=0)
        return float(self.w0 + self.w[ids].sum() + 0.5 * (float(total @ total) - float((rows * rows).sum())))

    def score(self, ids: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(ids), -60, 60))))


def _margins(w0: float, w: np.ndarray, v: np.ndarray, ids: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Margins of ``n`` rows whose terms are ``ids`` (``owner``: the row of each), and the sums of their factors."""
    own = v[ids]
    total = np.stack([np.bincount(owner, weights=own[:, k], minlength=n) for k in range(v.shape[1])], axis=1) if v.shape[1] else np.zeros((n, 0))
    square = np.bincount(owner, weights=(own * own).sum(axis=1), minlength=n)
    return w0 + np.bincount(owner, weights=w[ids], minlength=n) + 0.5 * ((total * total).sum(axis=1) - square), total


def _shrunk(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Rows moved towards zero by ``by``, and to zero where they are shorter."""
    size = np.abs(x) if x.ndim == 1 else np.sqrt((x * x).sum(axis=1))
    keep = np.maximum(0.0, 1 - by / np.maximum(size, 1e-12))
    return x * (keep if x.ndim == 1 else keep[:, None])


def fit(
    docs: list[np.ndarray], y: np.ndarray, bits: int = TERM_BITS, factors: int = FACTORS, steps: int = 1500, batch: int = 128, rate: float = 0.15, l1: float = 1e-3, l1_factors: float = 3e-3, patience: int = 6, seed: int = 7
) -> FactorizationMachine:
    """Mini-batch AdaGrad on the log loss with shrinkage; each eighth row is held back and picks the step whose model stays.

    One class alone, or no rows (one half), gives the smoothed base rate and no terms.
    """
    size, n = 1 << bits, len(docs)
    base = (float(y.sum()) + 0.5) / (n + 1)
    model = FactorizationMachine(float(np.log(base / (1 - base))), np.zeros(size, np.float32), np.zeros((size, factors), np.float32))
    if n == 0 or y.min() == y.max():
        return model
    df = np.zeros(size, np.int64)
    for ids in docs:
        df[ids] += 1
    kept = np.flatnonzero(df >= max(MIN_DOCS, MIN_SHARE * n))
    compact = np.full(size, -1, np.int32)
    compact[kept] = np.arange(len(kept), dtype=np.int32)
    rows = [c[c >= 0] for c in (compact[ids] for ids in docs)]
    rng = np.random.default_rng(seed)
    order = rng.permutation(n)
    held, used = (order[: n // 8], order[n // 8 :]) if n >= 80 else (order, order)

    def flat(pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([rows[i] for i in pick]), np.repeat(np.arange(len(pick)), [len(rows[i]) for i in pick])

    # Positives are few; the root of the odds keeps a single strong term above the threshold without flooding it.
    weight = np.where(y > 0, np.sqrt((1 - base) / base), 1.0) if base < 0.5 else np.ones(n)
    m = len(kept)
    w, v, w0 = np.zeros(m), rng.normal(0, 0.02, (m, factors)), model.w0
    gw, gv, g0 = np.full(m, 1e-6), np.full((m, factors), 1e-5), 1e-6

    def held_loss() -> float:
        # Slice by slice, so that the driver never holds the factors of all held-back terms at once.
        total = 0.0
        for at in range(0, len(held), batch):
            part = held[at : at + batch]
            z, _ = _margins(w0, w, v, *flat(part), len(part))
            total += float((weight[part] * np.logaddexp(0, np.where(y[part] > 0, -z, z))).sum())
        return total / len(held)

    best, since = (np.inf, w0, w, v), 0
    frozen = False
    for step in range(1, 2 * steps + 1):
        pick = used[rng.integers(0, len(used), batch)]
        ids, owner = flat(pick)
        z, total = _margins(w0, w, v, ids, owner, batch)
        g = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y[pick]) * weight[pick] / batch
        dw = np.bincount(ids, weights=g[owner], minlength=m)
        pull = g[owner, None] * (total[owner] - v[ids])
        dv = np.stack([np.bincount(ids, weights=pull[:, k], minlength=m) for k in range(factors)], axis=1) if factors else np.zeros((m, 0))
        gw += dw * dw
        g0 += g.sum() ** 2
        seen = np.bincount(ids, minlength=m) > 0
        pace = rate / np.sqrt(gw)
        w = _shrunk(w - pace * dw, np.where(seen, l1 * pace, 0))
        if not frozen:
            gv += dv * dv
            pace_v = rate / np.sqrt(gv)
            v = _shrunk(v - pace_v * dv, np.where(seen, l1_factors * pace_v.mean(axis=1), 0) if factors else np.zeros(m))
        w0 -= 0.3 * rate * g.sum() / np.sqrt(g0)
        if step % 50 == 0:
            loss = held_loss()
            best, since = ((loss, w0, w.copy(), v.copy()), 0) if loss < best[0] - 1e-5 else (best, since + 1)
            if frozen and since >= patience:
                break
            if not frozen and (step >= steps or since >= patience and step >= steps // 3):
                # The factors stay as they were at their best; the weights settle around them.
                frozen, since, (_, w0, w, v) = True, 0, (best[0], best[1], best[2].copy(), best[3])
                gw, g0 = np.full(m, 1e-6), 1e-6
    _, model.w0, model.w[kept], model.v[kept] = best
    return model


def held_out(id_col: str) -> Column:
    """Rows that no label is learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, truth: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> FactorizationMachine:
    """Fit on at most ``rows`` labelled rows that aren't held out; only their term hashes reach the driver."""

    @F.pandas_udf("binary")
    def terms(texts: pd.Series) -> pd.Series:
        return pd.Series([term_ids(t).astype("<i4").tobytes() for t in texts], dtype=object)

    small_batches(docs)
    picked = (
        truth.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(label_col).cast("int").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(rows)
    )
    # At most ``rows`` ids: a proven bound.
    found = (
        docs.join(F.broadcast(picked), F.col(id_col) == F.col("_id"))
        .select("_id", "_y", terms(F.col(text_col)).alias("_t"))
        .dropDuplicates(["_id"])
        .orderBy("_id")
        .limit(rows)
        .select("_y", "_t")
        .collect()
    )
    y = np.array([r["_y"] for r in found], dtype=float)
    terms_of = [np.frombuffer(r["_t"], dtype="<i4") for r in found]
    del found
    return fit(terms_of, y)


def scored(docs: DataFrame, model: FactorizationMachine, text_col: str = "text") -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series([m.score(term_ids(t)) for t in texts], dtype="float64")

    small_batches(docs)
    return score(F.col(text_col))


def toxicity(docs: DataFrame, truth: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per input row: ``id_col, held_out, score, predicted``.

    Null and empty texts have no terms and get the score of the intercept. Repeated rows get equal scores. Without labels of
    both classes every score is the base rate. Extra columns are ignored; an empty table gives no rows.
    """
    model = train(docs, truth, id_col=id_col, text_col=text_col)
    return docs.select(F.col(id_col), held_out(id_col).alias("held_out"), scored(docs, model, text_col).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), labels(spark, sf_dir))
