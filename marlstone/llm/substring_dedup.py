"""Substring dedup: MinHash banding over paragraphs, exact verification, removals clustered by components.

A document's units are its paragraphs (lines, and blocks of several lines up to a blank one), sketched by MinHash bands over
five-word shingles, and windows of ``WINDOW`` words that begin at winnowed anchors (the least three-word hash of any ``WINDOW`` in
a row), whose one band is all of their words. The registered query sketches every paragraph that holds a shingle. Both ends of a
passage that two documents share sit anywhere in a line, and every shared run of ``2 * WINDOW - 1`` words has a window in common.

Each text is sketched once, into a table. First pass: only 64-bit band keys are counted. Second pass: only units with a key of
several documents are kept, each with the 128-bit digest of its words; lines keep their words too. Units are verified (windows:
equal digests of all their words; lines: exact Jaccard similarity), linked, and clustered by connected components; of each cluster
the document with the smallest id keeps its passage.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import count

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import discard, documents, materialize, slot_map, small_batches
from marlstone.llm.components import connected_components

WINDOW = 25
SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.995
#: Bits of the map of repeated keys that executors get: 16 MB, whatever the corpus holds. A fuller map lets more units through
#: to verification; results don't depend on it.
MAP_BITS = 27
#: Repeated keys for each bit of the map below which two bits a key let fewer others through than one: the log of the golden ratio.
TWO_PROBES = 0.48
#: Distinct paragraphs of a band bucket that one task compares; larger buckets are compared block against block.
BLOCK = 1000
PIECE = 4096

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_HIGH, _LOW = np.uint64(31), np.uint64(29)


def tune_bands(similarity: float = SIMILARITY, recall: float = RECALL, most_hashes: int = 64) -> tuple[int, int]:
    """Bands and rows: the most rows (fewest false candidates) whose bands find a pair at ``similarity`` with ``recall``."""
    best = (most_hashes, 1)
    for rows in range(1, most_hashes + 1):
        miss = 1 - similarity**rows
        bands = 1 if miss <= 0 else int(np.ceil(np.log(1 - recall) / np.log(miss)))
        if bands * rows > most_hashes:
            break
        best = (bands, rows)
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    y = x >> _HIGH
    y ^= x
    y *= _Q
    x = y >> _LOW
    x ^= y
    return x


@lru_cache
def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _P)], dtype=np.uint64)


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words."""
    out = np.zeros(max(0, len(h) - n + 1), dtype=np.uint64)
    for k, p in enumerate(_powers(n)):
        out += h[k : k + len(out)] * p
    return _mix(out)


def _sliding(x: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """``op`` over each run of ``width`` values, by doubling."""
    size, now = 1, x
    while size * 2 <= width:
        now = op(now[:-size], now[size:])
        size *= 2
    return op(now[: len(x) - width + 1], now[width - size :]) if size < width else now


@dataclass
class Sketch:
    words: list[bytes]
    windows: np.ndarray  # starts
    window_keys: np.ndarray
    lines: list[tuple[int, int]]  # start, words: lines and blocks of several lines
    line_keys: np.ndarray  # a row of band keys for each line


class Sketcher:
    def __init__(self, window: int = WINDOW, shingle: int = SHINGLE, similarity: float = SIMILARITY, recall: float = RECALL, least: int | None = None) -> None:
        self.window, self.shingle = window, shingle
        #: Fewest words of a paragraph; less than a shingle can't be compared.
        self.least = max(window if least is None else least, shingle)
        self.bands, self.rows = tune_bands(similarity, recall)
        rng = np.random.default_rng(2024)
        k = self.bands * self.rows
        self.a = rng.integers(1, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, k, dtype=np.uint64)
        self.powers = _powers(max(window, self.rows))

    def sketch(self, text: str | None) -> Sketch:
        words: list[bytes] = []
        lines: list[tuple[int, int]] = []
        begin, held = 0, 0
        for line in [*(text or "").encode("utf-8", "replace").lower().split(b"\n"), b""]:
            own = line.split()
            if not own:
                if held > 1 and len(words) - begin >= self.least:
                    lines.append((begin, len(words) - begin))
                held = 0
                continue
            begin, held = begin if held else len(words), held + 1
            if len(own) >= self.least:
                lines.append((len(words), len(own)))
            words += own
        none = np.zeros(0, dtype=np.uint64)
        if len(words) < min(self.window, self.least):
            return Sketch(words, none.astype(np.int64), none, [], none.reshape(0, self.bands))
        h = _mix(np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words)) * _P + _Q)
        if len(words) < self.window:
            return Sketch(words, none.astype(np.int64), none, lines, self.line_keys(h, lines))
        starts = self.anchors(h)
        at = starts[:, None] + np.arange(self.window)
        keys = _mix(h[at] @ self.powers[: self.window])
        # A run of one repeated word has an anchor at each word; windows that say the same may step over each other.
        keep, last = np.ones(len(starts), dtype=bool), {}
        if len(set(keys.tolist())) < len(keys):
            for i, (s, key) in enumerate(zip(starts.tolist(), keys.tolist(), strict=True)):
                keep[i] = s - last.get(key, -self.window) >= self.window
                if keep[i]:
                    last[key] = s
        return Sketch(words, starts[keep], keys[keep], lines, self.line_keys(h, lines))

    def anchors(self, h: np.ndarray) -> np.ndarray:
        """Starts whose three-word hash is the least of some ``window`` neighbouring ones (ties all count)."""
        grams = _grams(h, 3)
        width = min(self.window, len(grams))
        least = _sliding(grams, width, np.minimum)
        edge = np.zeros(width - 1, dtype=np.uint64)
        starts = np.flatnonzero(grams == _sliding(np.concatenate([edge, least, edge]), width, np.maximum))
        return starts[starts + self.window <= len(h)]

    def line_keys(self, h: np.ndarray, lines: list[tuple[int, int]]) -> np.ndarray:
        if not lines:
            return np.zeros((0, self.bands), dtype=np.uint64)
        grams = _grams(h, self.shingle)
        first = np.array([s for s, _ in lines])
        end = first + np.array([n for _, n in lines]) - self.shingle + 1
        # Blocks hold lines, so the shingles between any two bounds are hashed once and each paragraph takes the least of its parts.
        cuts = np.unique(np.concatenate([first, end, np.arange(0, len(grams), PIECE)]))
        cuts = cuts[cuts < len(grams)]
        parts = np.empty((len(cuts) + 1, len(self.a)), dtype=np.uint64)
        parts[-1] = 0
        for i in range(0, len(grams), PIECE):
            lo, hi = np.searchsorted(cuts, (i, i + PIECE))
            np.minimum.reduceat(self.hashes(grams[i : i + PIECE]), cuts[lo:hi] - i, axis=0, out=parts[lo:hi])
        least = np.minimum.reduceat(parts, np.searchsorted(cuts, np.stack([first, end], axis=1).ravel()), axis=0)[::2]
        salt = np.arange(self.bands, dtype=np.uint64) * _Q
        return _mix(least.reshape(-1, self.bands, self.rows) @ self.powers[: self.rows] + salt)

    def hashes(self, grams: np.ndarray) -> np.ndarray:
        out = grams[:, None] * self.a
        out += self.b
        return out


def shingle_set(text: str, shingle: int = SHINGLE) -> frozenset[tuple[str, ...]]:
    w = text.split(" ")
    return frozenset(tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1))


def shingle_numbers(texts: list[str], shingle: int = SHINGLE) -> list[frozenset[int]]:
    """``shingle_set`` of each text with a number for each distinct shingle: sets of numbers are compared without looking at words."""
    name = defaultdict(count().__next__).__getitem__
    words = (t.split(" ") for t in texts)
    return [frozenset(map(name, zip(*(w[k:] for k in range(shingle)), strict=False))) for w in words]


def similar(a: frozenset, b: frozenset, least: float) -> bool:
    """Exact Jaccard similarity of at least ``least``; sizes alone often settle it."""
    small, large = sorted((len(a), len(b)))
    if small < least * large:
        return False
    both = len(a & b)
    return both >= least * (len(a) + len(b) - both) - 1e-9


def slots(keys: np.ndarray, probes: int) -> list[np.ndarray]:
    """The bits of the map that stand for each key: its highest bits, then the next ones."""
    return [keys << np.uint64(i * MAP_BITS) >> np.uint64(64 - MAP_BITS) for i in range(probes)]


def marked(shared: np.ndarray, keys: np.ndarray, probes: int) -> np.ndarray:
    """Which keys have all their bits set: every repeated one, and few others."""
    found = np.ones(keys.shape, dtype=bool)
    for slot in slots(keys, probes):
        found &= (shared[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
    return found


SKETCHES = "id long, sig long, n long, text string, starts binary, windows binary, lines binary, bands binary"


def sketches(docs: DataFrame, id_col: str, text_col: str, sketcher: Sketcher) -> DataFrame:
    """A row for each document with its text and sketch, kept as a table so that both passes read what was computed once.

    ``starts, windows``: windows' starts and keys. ``lines, bands``: start and words of each line, and its row of band keys.
    """

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple] = []
            for i, t in zip(b["id"], b["text"], strict=True):
                s = sketcher.sketch(t)
                sig = int(np.uint64(xxhash.xxh64_intdigest((t or "").encode("utf-8", "replace"))).view(np.int64))
                parts = (s.windows.astype(np.int32), s.window_keys, np.array(s.lines, dtype=np.int32), s.line_keys)
                out.append((None if pd.isna(i) else int(i), sig, len(s.words), t, *(x.tobytes() for x in parts)))
            yield pd.DataFrame(out, columns=["id", "sig", "n", "text", "starts", "windows", "lines", "bands"]).astype({"id": "Int64"})

    return materialize(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(emit, SKETCHES), "sketches")


def repeated_map(table: DataFrame) -> tuple[np.ndarray, int]:
    """Bits for the keys that several rows of ``sketches`` hold, and how many for each; the driver gets at most ``2 ** (MAP_BITS - 3)`` bytes."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [np.unique(np.frombuffer(w + k, dtype=np.int64)) for w, k in zip(b["windows"], b["bands"], strict=True)]
            yield pd.DataFrame({"key": np.concatenate(out) if out else np.zeros(0, np.int64)})

    counted = table.select("windows", "bands").mapInPandas(keys, "key long").groupBy("key").count().where("count > 1")
    repeated = materialize(counted.select("key"), "repeated")
    probes = 2 if repeated.count() < TWO_PROBES * 2**MAP_BITS else 1
    bits = [F.shiftrightunsigned(F.shiftleft("key", i * MAP_BITS), 64 - MAP_BITS) for i in range(probes)]
    found = slot_map(repeated.select(F.explode(F.array(*bits)).alias("s")), MAP_BITS)
    discard(repeated)
    return found, probes


def repeated_keys(docs: DataFrame, text_col: str, sketcher: Sketcher) -> tuple[np.ndarray, int]:
    """``repeated_map`` of texts."""
    table = sketches(docs.select(F.lit(None).alias("id"), text_col), "id", text_col, sketcher)
    found = repeated_map(table)
    discard(table)
    return found


UNITS = "id long, sig long, kind int, start int, n int, d1 long, d2 long, text string, keys array<long>"


def units(docs: DataFrame, id_col: str, text_col: str, sketcher: Sketcher) -> DataFrame:
    """A row of kind 0 for each document, then its windows (1) and lines (2) that hold a repeated key.

    ``d1, d2``: 128-bit digest of a unit's words, seeded by its kind. Only lines carry ``text`` and ``keys``.
    """
    table = sketches(docs, id_col, text_col, sketcher)
    found, probes = repeated_map(table)
    shared = docs.sparkSession.sparkContext.broadcast(found)
    del found

    def column(values: pd.Series, dtype: type) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all rows, and the row of each."""
        sizes = values.map(len).to_numpy(dtype=np.int64) // np.dtype(dtype).itemsize
        return np.frombuffer(b"".join(values), dtype=dtype), np.repeat(np.arange(len(values)), sizes)

    def rows(b: pd.DataFrame, at: np.ndarray, kind: int, start: np.ndarray, n: np.ndarray, digests: list[bytes], text: list | None, keys: list | None) -> pd.DataFrame:
        d = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
        own = b[["id", "sig"]].iloc[at].reset_index(drop=True)
        return own.assign(kind=kind, start=start, n=n, d1=d[:, 0], d2=d[:, 1], text=text, keys=keys)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["id", "sig"]].assign(kind=0, start=0, n=b["n"], d1=None, d2=None, text=None, keys=None)
            b = b[b["id"].notna()].reset_index(drop=True).astype({"id": "int64"})
            starts, row = column(b["starts"], np.int32)
            hit = marked(shared.value, column(b["windows"], np.uint64)[0], probes)
            starts, row = starts[hit], row[hit]
            lines, line_row = column(b["lines"], np.int64)
            lines = lines.view(np.int32).reshape(-1, 2)
            bands = column(b["bands"], np.uint64)[0].reshape(-1, sketcher.bands)
            marks = marked(shared.value, bands, probes)
            hit = marks.any(axis=1)
            lines, line_row, bands, marks = lines[hit], line_row[hit], bands[hit].view(np.int64), marks[hit]
            of_row, texts = [np.searchsorted(x, np.arange(len(b) + 1)).tolist() for x in (row, line_row)], b["text"].tolist()
            places, spans = starts.tolist(), lines.tolist()
            window_digests, line_digests, line_texts = [], [], []
            for i, t in enumerate(texts):
                (w, w_end), (k, k_end) = ((x[i], x[i + 1]) for x in of_row)
                if w == w_end and k == k_end:
                    continue
                words = t.encode("utf-8", "replace").lower().split()
                window_digests += [xxhash.xxh3_128_digest(b" ".join(words[s : s + sketcher.window]), 1) for s in places[w:w_end]]
                joined = [b" ".join(words[s : s + n]) for s, n in spans[k:k_end]]
                line_digests += [xxhash.xxh3_128_digest(x, 2) for x in joined]
                line_texts += [x.decode() for x in joined]
            if len(row):
                yield rows(b, row, 1, starts, sketcher.window, window_digests, None, None)
            if len(line_row):
                yield rows(b, line_row, 2, lines[:, 0], lines[:, 1], line_digests, line_texts, [k[m] for k, m in zip(bands, marks, strict=True)])

    out = materialize(table.mapInPandas(emit, UNITS), "units")
    discard(table)
    return out


def buckets(rows: DataFrame) -> DataFrame:
    """``key, count`` of the band buckets (``rows``: ``node, key``) to compare: those of several lines, of those with equal lines one.

    Near copies share most of their bands. Buckets are told apart by their size and 128 bits of their lines' numbers.
    """
    members = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"m{i}") for i in range(2)]
    return rows.groupBy("key").agg(F.count("*").alias("count"), *members).where("count > 1").groupBy("count", "m0", "m1").agg(F.min("key").alias("key")).select("key", "count")


def line_links(classes: DataFrame, similarity: float, shingle: int, block: int = BLOCK) -> DataFrame:
    """``classes``: ``node, text, keys`` of distinct lines. Links ``a, b`` that connect them as all verified pairs of a band do."""
    rows = classes.select("node", F.explode("keys").alias("key"))
    sizes = buckets(rows).select("key", F.ceil(F.col("count") / block).cast("int").alias("g"))
    own = F.pmod(F.xxhash64("node"), F.col("g")).cast("int")
    # Texts move only for keys that several distinct lines hold.
    live = rows.join(sizes, "key").groupBy("node").agg(F.collect_list(F.struct("key", "g")).alias("live"))
    dealt = (
        classes.select("node", "text")
        .join(live, "node")
        .select("node", "text", F.inline("live"))
        .withColumn("own", own)
        .select("key", "node", "text", "own", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("other"))
        .select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "text")
    )

    def compare(nodes: list[int], own: list[int], texts: list[str], cross: bool) -> list[tuple[int, int]]:
        sets = shingle_numbers(texts, shingle)
        root, found = list(range(len(nodes))), []

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i in range(len(nodes)):
            for j in range(i):
                # What is connected already needs no second look.
                if (not cross or own[i] != own[j]) and find(i) != find(j) and similar(sets[i], sets[j], similarity):
                    root[find(i)] = find(j)
                    found.append((nodes[i], nodes[j]))
        return found

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            now = b if held is None else pd.concat([held, b], ignore_index=True)
            group = now[["key", "lo", "hi"]].to_numpy()
            starts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(axis=1)]).tolist()
            yield from flush(now, starts)
            held = now.iloc[starts[-1] :]
        if held is not None:
            yield from flush(held, [0, len(held)])

    def flush(rows: pd.DataFrame, starts: list[int]) -> Iterator[pd.DataFrame]:
        """Links of the groups that lie between ``starts``."""
        nodes, own, texts = (rows[c].tolist() for c in ("node", "own", "text"))
        cross = (rows["lo"] != rows["hi"]).tolist()
        out: list[tuple[int, int]] = []
        for a, z in zip(starts, starts[1:], strict=False):
            out += compare(nodes[a:z], own[a:z], texts[a:z], cross[a]) if z - a > 1 else []
        if out:
            yield pd.DataFrame(out, columns=["a", "b"])

    return dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInPandas(links, "a long, b long")


def substring_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
    similarity: float = SIMILARITY,
    recall: float = RECALL,
    block: int = BLOCK,
    least: int | None = None,
) -> DataFrame:
    """One row per input row: ``id_col, component_id, n_links, n_words, removed_words, removed_spans``.

    Words are split at white space, A-Z lower-cased. ``component_id``: the smallest id reachable over shared passages, its own id
    if there are none. ``n_links``: clusters of passages that the document shares with others. ``removed_spans``: ``start:end``
    word ranges, comma-joined, that a document with a smaller id keeps; ``removed_words`` is their length. Null and empty
    texts share nothing. Rows with one id count as one document, so copies of a row aren't removed for each other; each
    has the spans of its own text. Rows with a null id share nothing. Extra columns are ignored; an empty table gives no rows.
    ``least``: fewest words of a paragraph that is sketched, ``window`` if not given; ``shingle`` leaves none out.
    """
    small_batches(docs)
    table = units(docs, id_col, text_col, Sketcher(window, shingle, similarity, recall, least))
    parts = table.where("kind > 0")
    # Equal units first: each distinct one is a class, however many documents hold it. A window's class is its cluster.
    windows = parts.where("kind = 1").groupBy("d1", "d2").agg(F.min("id").alias("keep"), F.max("id").alias("most")).where("keep < most").drop("most")
    lines = parts.where("kind = 2").groupBy("d1", "d2").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.first("text").alias("text"), F.first("keys").alias("keys"))
    lines = materialize(lines.withColumn("node", F.monotonically_increasing_id()), "lines")
    roots = connected_components(line_links(lines, similarity, shingle, block), "a", "b")
    grouped = materialize(lines.select("d1", "d2", "node", "lo", "hi").join(roots, "node", "left").select("d1", "d2", F.coalesce("component", "node").alias("cluster"), "lo", "hi"), "clusters")
    keeps = grouped.groupBy("cluster").agg(F.min("lo").alias("keep"), F.max("hi").alias("most")).where("keep < most").drop("most")
    # Class names of lines are row numbers, those of windows a digest's half with the top bit set: they can't meet.
    shared = grouped.join(keeps, "cluster").select("d1", "d2", "cluster", "keep")
    shared = shared.unionByName(windows.withColumn("cluster", F.col("d1").bitwiseOR(F.lit(-(2**63)))))
    held = materialize(parts.select("id", "sig", "start", "n", "d1", "d2").join(shared, ["d1", "d2"]).select("id", "sig", "start", "n", "cluster", "keep"), "held")

    linked = connected_components(held.select("id", "keep").distinct(), "id", "keep")
    spans = held.groupBy("id", "sig").agg(
        F.count_distinct("cluster").alias("n_links"),
        F.array_sort(F.collect_set(F.when(F.col("id") != F.col("keep"), F.struct("start", (F.col("start") + F.col("n")).alias("end"))))).alias("spans"),
    )

    def step(acc, s):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["end"] >= s["start"]), joined).otherwise(F.concat(acc, F.array(s)))

    merged = F.aggregate("spans", F.array().cast("array<struct<start:int,end:int>>"), step)
    spans = spans.select("id", "sig", "n_links", merged.alias("spans"))
    whole = table.where("kind = 0").select("id", "sig", F.col("n").cast("long").alias("n_words"))
    out = whole.join(spans, ["id", "sig"], "left").join(linked.withColumnRenamed("node", "id"), "id", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        "n_words",
        F.coalesce(F.aggregate("spans", F.lit(0), lambda a, s: a + s["end"] - s["start"]), F.lit(0)).cast("long").alias("removed_words"),
        F.coalesce(F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ","), F.lit("")).alias("removed_spans"),
    )


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir), least=SHINGLE)
