"""Context packing: overlap dedupe, diversity selection, previews, token budgets.

The greedy folds run once for each query in a grouped map over that query's candidates, which the retrieval's own ``k`` bounds.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import token_estimate

HEAD, TAIL, SLACK, LINE_CHARS = 12, 8, 8, 16


def dedupe_rows(rows: list[dict]) -> list[dict]:
    """By falling score, drops a row whose lines meet those of a kept row of the same file."""
    kept: list[dict] = []
    for r in sorted(rows, key=lambda r: (-r["score"], r["chunk_id"])):
        if not any(k["file_path"] == r["file_path"] and k["start_line"] <= r["end_line"] and r["start_line"] <= k["end_line"] for k in kept):
            kept.append(r)
    return kept


def likeness(a: dict, b: dict) -> float:
    """.6 in one file; else .3 for one type and .1 for each shared part of the names (case ignored, split at ``_`` and ``-``), .95 at most."""
    if a["file_path"] == b["file_path"]:
        return 0.6
    pieces = lambda r: set(r["entity_name"].lower()[:30].replace("-", "_").split("_"))
    parts = len(pieces(a) & pieces(b))
    return min(0.95, (0.3 if a["entity_type"] == b["entity_type"] else 0.0) + min(0.4, 0.1 * parts))


def mmr_rows(rows: list[dict], weight: float = 0.3) -> list[dict]:
    """Greedy: the row with the best score less ``weight`` times its greatest likeness to a picked one; the first of equals."""
    left, picked = list(rows), []
    if len(left) <= 2:
        return left
    while left:
        best = max(range(len(left)), key=lambda i: (left[i]["score"] - weight * max((likeness(left[i], p) for p in picked), default=0.0), -i))
        picked.append(left.pop(best))
    return picked


def _grouped(hits: DataFrame, fold) -> DataFrame:
    columns = hits.columns

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = fold(group.sort_values(["score", "chunk_id"], ascending=[False, True], kind="stable").to_dict("records"))
        return pd.DataFrame([r | {"pick": i} for i, r in enumerate(rows)], columns=[*columns, "pick"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hits.schema) + ", pick int"
    return hits.groupBy("query_id").applyInPandas(run, schema)


def range_dedupe(hits: DataFrame) -> DataFrame:
    """``hits``: ``query_id, chunk_id, score, file_path, start_line, end_line``; adds ``pick``, the order from 0."""
    return _grouped(hits, dedupe_rows)


def mmr_select(hits: DataFrame, weight: float = 0.3) -> DataFrame:
    """``hits``: also ``entity_name, entity_type``; adds ``pick``."""
    return _grouped(hits, lambda rows: mmr_rows(rows, weight))


def preview(content: Column, head: int = HEAD, tail: int = TAIL) -> Column:
    """First and last lines with a count of those left out between, where the text is long enough to gain by it."""
    lines = F.split(content, "\n")
    n = F.size(lines)
    long = (n > head + tail) & ((n > head + tail + SLACK) | (F.length(content) > (head + tail + SLACK) * LINE_CHARS))
    note = F.concat(F.lit("... "), (n - head - tail).cast("string"), F.lit(" lines omitted ..."))
    cut = F.concat(F.slice(lines, 1, head), F.array(note), F.slice(lines, F.greatest(n - tail + 1, F.lit(1)), F.lit(tail)))
    return F.when(long, F.array_join(cut, "\n")).otherwise(content)


def running_budget(hits: DataFrame, budget: int, rank: str = "rank", tokens: str = "tokens") -> DataFrame:
    """Adds ``used`` (running tokens) and ``stub``: true from the first row on that passes the budget; no row is dropped."""
    order = Window.partitionBy("query_id").orderBy(rank).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    used = hits.withColumn("used", F.sum(tokens).over(order))
    return used.withColumn("stub", F.max((F.col("used") > budget).cast("int")).over(order) == 1)


def full_pack_rows(rows: list[dict], budget: int) -> list[dict]:
    """Files in order, their rows by start line; the first row of a file that doesn't fit is cut if over 50 tokens are left, and the rest of
    that file is left out, while later files still get their turn. Adds ``packed_tokens`` and ``cut``."""
    out, used = [], 0
    for path in sorted({r["file_path"] for r in rows}):
        for r in sorted((r for r in rows if r["file_path"] == path), key=lambda r: (r["start_line"], r["chunk_id"])):
            need = len(r["content"]) // 4
            if used + need <= budget:
                out.append(r | {"packed_tokens": need, "cut": False})
                used += need
                continue
            if budget - used > 50:
                out.append(r | {"packed_tokens": budget - used, "cut": True})
                used = budget
            break
    return out


def full_pack(hits: DataFrame, budget: int) -> DataFrame:
    """``query_id, chunk_id, packed_tokens, cut, pick`` of what a full pack holds."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = full_pack_rows(group.to_dict("records"), budget)
        return pd.DataFrame([(r["query_id"], r["chunk_id"], r["packed_tokens"], r["cut"], i) for i, r in enumerate(rows)], columns=["query_id", "chunk_id", "packed_tokens", "cut", "pick"])

    kinds = {f.name: f.dataType.simpleString() for f in hits.schema}
    schema = f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, packed_tokens long, cut boolean, pick int"
    return hits.groupBy("query_id").applyInPandas(run, schema)


def lite_pack(hits: DataFrame, budget: int) -> DataFrame:
    """Previews in rank order; from the first that passes the budget on, rows become stubs. Adds ``body, tokens, used, stub``."""
    rows = hits.withColumn("body", preview(F.col("content"))).withColumn("tokens", token_estimate(F.col("body")))
    return running_budget(rows, budget)
