"""Connected components over an edge table: forests of what each task holds, then alternating large-star and small-star steps.

A task replaces its edges by a star for each component that they form alone, ``CHUNK`` edges at a time. Up to ``GATHERED`` edges (16 MB)
left of that are joined by one task; more go through rounds until they are that few or at rest. Every step of a round is a map-side
combined minimum and one equi-join. Hubs, nodes with over a fixed share of all edges, are so few that their minima are broadcast, so
their edges stay where they are. No edge passes through the driver. A round's table is deleted once the next one is written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import discard, materialize

#: A node is a hub from this share of all edges on, and from so many edges: at most 2 / share nodes are, 40,000 rows of 16 bytes.
HUB_SHARE, HUB_EDGES = 1 / 20_000, 100
#: Edges that one task joins at the end at most, and edges that a task holds at once before that.
GATHERED, CHUNK = 1_000_000, 1_000_000


def star(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges but the least of its component, and that least node."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(names))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (up := root[root])).any():
            root = up
    rest = root != np.arange(len(names))
    return names[rest], names[root[rest]]


def _stars(edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The edges ``u, v`` of each task as stars, joined whenever ``chunk`` of them are held."""

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        us, vs, held = [], [], 0
        for b in batches:
            us.append(b["u"].to_numpy(dtype=np.int64))
            vs.append(b["v"].to_numpy(dtype=np.int64))
            held += len(b)
            if held >= chunk:
                u, v = star(np.concatenate(us), np.concatenate(vs))
                if len(u) > chunk // 2:
                    yield pd.DataFrame({"u": u, "v": v})
                    u, v = u[:0], v[:0]
                us, vs, held = [u], [v], len(u)
        if held:
            u, v = star(np.concatenate(us), np.concatenate(vs))
            yield pd.DataFrame({"u": u, "v": v})

    return edges.mapInPandas(join, "u long, v long")


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _with_least(edges: DataFrame, hub: float) -> DataFrame:
    """``u, v, m``: each edge with the least ``v`` of its ``u``."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n"))
    hubs, rest = F.broadcast(least.where(F.col("_n") > hub).select("u", "m")), least.where(F.col("_n") <= hub).select("u", "m")
    return edges.join(hubs, "u").unionByName(edges.join(hubs, "u", "left_anti").join(rest, "u"))


def _large_star(edges: DataFrame, hub: float) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, hub).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame, hub: float) -> DataFrame:
    moved = _with_least(edges, hub).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str, b: str, gathered: int = GATHERED) -> DataFrame:
    """``edges`` holds pairs of long ids in columns ``a`` and ``b``.

    Returns ``node, component`` (the smallest id reachable) for every node of a pair of two different ids.
    Loops, repeated pairs and nulls add nothing; an empty table gives an empty table. ``gathered``: edges that one task joins at most.
    """
    now = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(
        F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")
    )
    now = materialize(_stars(now), "edges")
    seen = _digest(now)
    # The steps come to rest after some rounds, about the square of the logarithm of a component's size.
    while seen[0] > gathered:
        hub = max(float(HUB_EDGES), 2 * HUB_SHARE * seen[0])
        last, now = now, materialize(_small_star(_large_star(now, hub).distinct(), hub), "edges")
        discard(last)
        found = _digest(now)
        if found == seen:
            break
        seen = found
    else:
        last, now = now, materialize(_stars(now.coalesce(1), 2 * gathered + 1), "edges")
        discard(last)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
