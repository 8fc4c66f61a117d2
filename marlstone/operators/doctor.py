"""Health of what is stored: each check is one row, ``name, status (ok, warn, fail), detail``; a failing one doesn't stop the others."""

from __future__ import annotations

import importlib.util
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.index import open_index

NEEDED, LEAST_PYTHON = ("pyspark", "pyarrow", "pandas", "numpy"), (3, 10)

Check = Callable[[], tuple[str, str]]


def python_version() -> tuple[str, str]:
    now = sys.version_info[:2]
    return "ok" if now >= LEAST_PYTHON else "fail", ".".join(map(str, now))


def packages(needed: tuple[str, ...] = NEEDED) -> tuple[str, str]:
    lost = [n for n in needed if importlib.util.find_spec(n) is None]
    return ("fail", "missing: " + ", ".join(lost)) if lost else ("ok", f"{len(needed)} packages")


def stored_index(spark: SparkSession, path: str) -> tuple[str, str]:
    found = open_index(spark, path)
    if found is None:
        return "warn", "no finished index; searches will build one"
    return ("ok", "index with postings") if found.limit(1).count() else ("warn", "the index is empty")


def edge_ends(nodes: DataFrame, edges: DataFrame) -> tuple[str, str]:
    """Edges whose ends are no nodes."""
    ids = nodes.select(F.col("entity_id").alias("id")).distinct()
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    lost = ends.join(ids, "id", "left_anti").count()
    return ("ok", "all ends are known") if not lost else ("fail", f"{lost} ends without a node")


def one_model(embeddings: DataFrame, want: str | None = None) -> tuple[str, str]:
    """Vectors of one model and one length; at most three models reach the driver."""
    seen = embeddings.groupBy("model", F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).limit(3).collect()
    if not seen:
        return "warn", "no vectors"
    if len(seen) > 1:
        return "fail", "vectors of several models or lengths"
    return ("ok", f"{seen[0]['model']}, {seen[0]['dim']} numbers") if want in (None, seen[0]["model"]) else ("fail", f"vectors of {seen[0]['model']}, asked for {want}")


def run_checks(spark: SparkSession, checks: dict[str, Check]) -> DataFrame:
    """``name, status, detail`` in order; an exception is a failure with its message."""
    rows = []
    for name, check in checks.items():
        try:
            rows.append((name, *check()))
        except Exception as e:  # noqa: BLE001
            rows.append((name, "fail", f"{type(e).__name__}: {str(e).splitlines()[0][:160] if str(e) else ''}"))
    return spark.createDataFrame(rows, "name string, status string, detail string")


def exit_code(report: DataFrame) -> int:
    return 0 if report.where("status = 'fail'").isEmpty() else 1
