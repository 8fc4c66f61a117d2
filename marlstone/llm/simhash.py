"""SimHash near-dedup: shards that share fingerprint bits, a BK-tree for each shard, components over the links.

Two users: ``simhash_dedup`` links fingerprints within 3 bits, as its query asks; ``near_dedup`` finds texts whose five-word shingles
are 0.8 alike or more, and verifies every link by exact Jaccard similarity.

Two fingerprints within 3 bits of 64 agree on at least one of four 16-bit blocks, so shards keyed by (block, bits)
lose no link. A shard with more distinct fingerprints than ``SHARD_ROWS`` is never gathered: its remaining bits are
split into four blocks again, where the same argument holds. The tree of a shard goes to the task that holds the
shard's fingerprints; it isn't broadcast, as the trees together grow with the data.

Texts that are 0.8 alike are some ten bits of 64 apart, where blocks that are certain to agree are too short to tell texts apart. There
shards are keyed by many random sets of bits: as many bits as keep shards small, and as many sets as give the asked recall.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import documents, materialize, small_batches
from marlstone.llm.components import connected_components

BITS = 64
RADIUS = 3
SHARD_ROWS = 1024
MAX_DEPTH = 7
#: Near copies: shingle, exact similarity, bits apart at most, share of the pairs at that distance that some shard holds, and the
#: fingerprints that a shard has on average.
NEAR_SHINGLE, NEAR_SIMILARITY, NEAR_RADIUS, NEAR_RECALL, NEAR_SHARD = 5, 0.8, 10, 0.95, 16
#: Ids of texts to verify that are broadcast at most (16 MB); beyond it texts are joined by shuffle.
BROADCAST_IDS = 1_000_000


def fingerprint_of(text: str | None, shingle: int = 3) -> int:
    """The fingerprint as a signed long. Words are runs of ``[^\\x20\\x09-\\x0D]``; only A-Z are lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= shingle:
        digests, n = xxhash.xxh64_digest(flat, 42), 1
    else:
        ends = np.cumsum([len(w) + 1 for w in words]).tolist()
        n = len(words) - shingle + 1
        h = xxhash.xxh64_digest
        digests = b"".join([h(flat[a : b - 1], 42) for a, b in zip([0, *ends[: n - 1]], ends[shingle - 1 :], strict=True)])
    ones = np.zeros(BITS, dtype=np.int64)
    raw = np.frombuffer(digests, dtype=np.uint8).reshape(n, 8)
    for at in range(0, n, 8192):
        ones += np.unpackbits(raw[at : at + 8192], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def fingerprint(text: str | Column, shingle: int = 3) -> Column:
    """64-bit SimHash over word shingles: a bit is 1 if it is set in over half of the shingles' XXH64 hashes (seed 42)."""

    @F.pandas_udf("long")
    def udf(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, shingle) for t in texts], dtype="int64")

    return udf(text)


class BKTree:
    """Children are keyed by their integer Hamming distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        new, at = len(self.values) - 1, 0
        while new:
            d = (self.values[at] ^ value).bit_count()
            nxt = self.children[at].setdefault(d, new)
            if nxt == new:
                return
            at = nxt

    def within(self, value: int, radius: int) -> list[int]:
        """Indices of the values at most ``radius`` bits away; only edges within the radius are followed."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            kids = self.children[at]
            todo += [kids[k] for k in range(d - radius, d + radius + 1) if k in kids] if len(kids) > 2 * radius else [c for k, c in kids.items() if abs(k - d) <= radius]
        return found


def shard_links(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that connect the shard's fingerprints as all its pairs within the radius would; fewer than its values."""
    tree, root = BKTree(), list(range(len(values)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []
    for i, v in enumerate(values):
        # The closest first, so that links run through the most alike.
        for j in sorted(tree.within(v & (2**BITS - 1), radius), key=lambda k: ((values[k] ^ v) & (2**BITS - 1)).bit_count()):
            a, b = find(i), find(j)
            if a != b:
                root[b] = a
                links.append((v, values[j]))
        tree.add(v & (2**BITS - 1))
    return links


def _masks(mask: int, radius: int) -> list[int]:
    """Masks that add to ``mask`` one of ``radius + 1`` blocks of the bits that it leaves free."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    cuts = [len(free) * i // (radius + 1) for i in range(radius + 2)]
    return [mask | sum(1 << b for b in free[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def bit_sets(n: int, radius: int = NEAR_RADIUS, recall: float = NEAR_RECALL, shard: int = NEAR_SHARD, seed: int = 9) -> list[int]:
    """Random masks: enough bits that ``n`` fingerprints fall into shards of about ``shard``, and enough masks that two fingerprints ``radius`` bits
    apart agree on one of them with probability ``recall``."""
    bits = min(BITS - radius, max(4, math.ceil(math.log2(max(2, n / shard)))))
    agree = math.comb(BITS - radius, bits) / math.comb(BITS, bits)
    r = random.Random(seed)
    return [sum(1 << b for b in r.sample(range(BITS), bits)) for _ in range(math.ceil(math.log(1 - recall) / math.log(1 - agree)))]


def hamming_links(prints: DataFrame, col: str, radius: int = RADIUS, shard_rows: int = SHARD_ROWS, max_depth: int = MAX_DEPTH, masks: list[int] | None = None) -> DataFrame:
    """``prints``: distinct fingerprints in ``col``. Returns links ``a, b`` that connect them as all pairs within ``radius`` bits do.

    With ``masks``, as those pairs do that agree on the bits of one of them.
    """

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            now = batch if held is None else pd.concat([held, batch], ignore_index=True)
            paths, keys, values = now["path"].to_numpy(), now["key"].to_numpy(), now["value"].to_numpy()
            starts = np.flatnonzero(np.r_[True, (paths[1:] != paths[:-1]) | (keys[1:] != keys[:-1])])
            # The last shard may go on in the next batch.
            held = now.iloc[starts[-1] :]
            yield from flush(values, starts)
        if held is not None:
            yield from flush(held["value"].to_numpy(), np.array([0, len(held)]))

    def flush(values: np.ndarray, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        out: list[tuple[int, int]] = []
        for at in np.flatnonzero(np.diff(starts) > 1):
            out += shard_links(values[starts[at] : starts[at + 1]].tolist(), radius)
        if out:
            yield pd.DataFrame(out, columns=["a", "b"])

    def keyed(rows: DataFrame, parents: list[int]) -> tuple[DataFrame, list[int]]:
        """Rows (with the index ``parent`` of their mask) once for each finer mask."""
        finer = [_masks(m, radius) for m in parents] if given is None else [given]
        flat = [_signed(m) for own in finer for m in own]
        table = F.array(*[F.array(*[F.lit(_signed(m)) for m in own]) for own in finer])
        spread = rows.select("value", "parent", F.posexplode(F.get(table, F.col("parent"))).alias("i", "mask"))
        path = (F.col("parent") * len(finer[0]) + F.col("i")).cast("int").alias("path")
        return spread.select("value", path, F.col("value").bitwiseAND(F.col("mask")).alias("key")), [m % 2**64 for m in flat]

    given = masks
    rows, masks = keyed(prints.select(F.col(col).alias("value"), F.lit(0).alias("parent")), [0])
    out = None
    for depth in range(1, max_depth + 1):
        large = None
        if depth < max_depth and given is None:
            counts = rows.groupBy("path", "key").count().where(F.col("count") > shard_rows).select("path", "key")
            large = materialize(counts, "large")
            large = None if large.isEmpty() else large
        small = rows if large is None else rows.join(large, ["path", "key"], "left_anti")
        dealt = small.repartition("path", "key").sortWithinPartitions("path", "key")
        found = dealt.mapInPandas(links, "a long, b long")
        out = found if out is None else out.unionByName(found)
        if large is None:
            break
        rows, masks = keyed(rows.join(large, ["path", "key"], "left_semi").select("value", F.col("path").alias("parent")), masks)
    return out


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = 3, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per input row: ``id_col, fingerprint`` (16 hex digits), ``component_id`` (the smallest id reachable by links).

    Null and empty texts have fingerprint zero and link like any other. Rows with one id but different texts each keep
    their own fingerprint. Extra columns are ignored; an empty table gives no rows.
    """
    small_batches(docs)
    prints = materialize(docs.select(F.col(id_col).alias("_id"), fingerprint(F.col(text_col), shingle).alias("_fp")), "prints")
    least = materialize(prints.groupBy("_fp").agg(F.min("_id").alias("_least")), "distinct")
    nodes = connected_components(hamming_links(least, "_fp", radius, shard_rows), "a", "b")
    grouped = least.join(nodes, least["_fp"] == nodes["node"], "left").select("_fp", "_least", F.coalesce("component", "_fp").alias("_root"))
    grouped = materialize(grouped, "grouped")
    roots = grouped.groupBy("_root").agg(F.min("_least").alias("component_id"))
    found = grouped.join(roots, "_root").select("_fp", "component_id")
    return prints.join(found, "_fp").select(
        F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def shingles(text: str | None, shingle: int = NEAR_SHINGLE) -> frozenset[bytes]:
    """The distinct shingles of a text (of fewer words: the whole sequence; of none: one empty shingle)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return frozenset(b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1)))


def alike(a: frozenset, b: frozenset, least: float = NEAR_SIMILARITY) -> bool:
    """Jaccard similarity of at least ``least``; sizes alone often settle it."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(a & b)
    return both >= least * (len(a) + len(b) - both) - 1e-9


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """The rows of ``pairs`` (``u, v``) whose texts (``_id, _text``) are alike. ``v`` is the one that many pairs share."""
    pairs = materialize(pairs, "pairs")
    ids = pairs.select(F.col("u").alias("_i")).unionByName(pairs.select(F.col("v").alias("_i"))).distinct()
    ids = materialize(ids, "ids")
    if ids.count() <= broadcast_ids:
        texts = texts.join(F.broadcast(ids), F.col("_id") == F.col("_i"), "left_semi")
    texts = texts.dropDuplicates(["_id"])
    left = pairs.join(texts.select(F.col("_id").alias("u"), F.col("_text").alias("a")), "u")
    both = left.join(texts.select(F.col("_id").alias("v"), F.col("_text").alias("b")), "v").select("u", "v", "a", "b")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[str | None, frozenset] | None = None
        for batch in batches:
            keep = []
            for a, b in zip(batch["a"], batch["b"], strict=True):
                # Rows come sorted by ``v`` as a rule, so the shared text's shingles serve many rows.
                if held is None or held[0] != b:
                    held = (b, shingles(b, shingle))
                keep.append(a == b or alike(shingles(a, shingle), held[1], similarity))
            yield batch.loc[keep, ["u", "v"]]

    # Nothing is dealt anew after this join, so a text that a third of all pairs share is a skewed join that can be split.
    return materialize(both.mapInPandas(check, "u long, v long"), "verified")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = NEAR_SIMILARITY, shingle: int = NEAR_SHINGLE, radius: int = NEAR_RADIUS, recall: float = NEAR_RECALL) -> DataFrame:
    """One row per input row: ``id_col, fingerprint, component_id`` (the smallest id reachable over verified links; ids must tell rows apart).

    A link is two texts whose word shingles have an exact Jaccard similarity of ``similarity`` or more. Candidates: equal fingerprints;
    fingerprints within 3 bits, all of them; and, among one fingerprint for each group that these connect, those within ``radius`` bits that share
    a bit set, which ``recall`` of the pairs at that distance do. Null and empty texts are alike. Extra columns are ignored; an empty
    table gives no rows; a row with a null id stays alone.
    """
    small_batches(docs)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    prints = materialize(texts.select("_id", fingerprint(F.col("_text"), shingle).alias("_fp")), "prints")
    known = prints.where("_id is not null")
    least = materialize(known.groupBy("_fp").agg(F.min("_id").alias("_least"), F.count("*").alias("_n")), "distinct")
    close = materialize(hamming_links(least, "_fp"), "close")
    # One fingerprint for each group of close ones: a crowd of near copies is thinned before the wide search.
    roots = connected_components(close, "a", "b")
    thin = least.join(roots.where("node <> component"), least["_fp"] == F.col("node"), "left_anti")
    thin = materialize(thin.select("_fp"), "thin")
    wide = hamming_links(thin, "_fp", radius, max_depth=1, masks=bit_sets(thin.count(), radius, recall))
    links = materialize(close.unionByName(wide).distinct(), "links")
    names = least.select(F.col("_fp").alias("a"), F.col("_least").alias("u"))
    far = links.join(names, "a").join(names.select(F.col("a").alias("b"), F.col("u").alias("v")), "b").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    same = known.join(least.where("_n > 1"), "_fp").where("_id <> _least").select(F.col("_id").alias("u"), F.col("_least").alias("v"))
    found = connected_components(verified(far.unionByName(same).distinct(), texts, shingle, similarity), "u", "v")
    return prints.join(found, prints["_id"] == found["node"], "left").select(
        F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), F.coalesce("component", "_id").alias("component_id")
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(documents(spark, sf_dir))
