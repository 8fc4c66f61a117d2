"""Mixture-controlled packing: deficit round-robin over source queues.

Documents are tokenized once into a table. Each source's queue is its documents in hash order, cut into slots. Prefix sums of the
slots' tokens and the sources' shares tell when a slot is due, and so the bucket of its documents; prefix sums over (bucket,
source) tell each bucket where in the packed stream it begins and which deficits its queues carry in. A bucket then serves its
queues and gives every document its place in the stream; a window is the stream's next ``width`` tokens. So windows and deficits
run on over buckets, and only the very last window of all is padded.

The prefix sums over slots are one task a source, those over buckets one task in all: with ``BUCKET_ROWS`` rows a bucket and ``SLOTS`` slots, a
billion documents make 50,000 buckets and 800,000 slots, rows of some bytes. The table of sources is broadcast; sources name
collections, and one row of them is some tens of bytes.
"""

from __future__ import annotations

import re
import threading
import zlib
from collections import deque
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import documents, materialize, small_batches, text_or_empty

WIDTH = 4096
END_ID = 2
#: Rows of a bucket, on average: what one task of the scheduler holds.
BUCKET_ROWS = 20_000
#: Slots of a source for each bucket.
SLOTS = 16
#: Words and word parts whose ids a Python worker remembers, about 150 bytes each.
CACHE_WORDS = 1_000_000
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def id_kind(vocabulary: int) -> str:
    """How ids are stored: 16 bits where they suffice."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


class WordTokenizer:
    """Ids of the ``tokenizers`` library, from a memory of white-space separated words.

    That is exact for a tokenizer that drops white space and whose pieces never hold any. A word of plain letters with
    trailing stops is handed to the model directly, as its normalizer and splitter change nothing there beyond lower case.
    """

    plain = re.compile("([A-Za-zÀ-ÖØ-Þß-öø-ÿ]+)([.,;:!?|*#$%&]*)")

    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        self.kind = id_kind(self.full.get_vocab_size())
        self.cache, self.pieces = _Memory(self.word), _Memory(self.piece)
        self.cache_words = cache_words
        split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {c: split.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.size = np.dtype(self.kind).itemsize

    def packed(self, ids: list[int]) -> bytes:
        return b"".join([i.to_bytes(self.size, "little") for i in ids])

    def piece(self, text: str) -> bytes:
        return self.packed([t.id for t in self.model.tokenize(text if text.isascii() else text.translate(self.bytes))])

    def word(self, word: bytes) -> bytes:
        text = word.decode("utf-8")
        if m := self.plain.fullmatch(text):
            head, tail = m.groups()
            return self.pieces[head.lower()] + self.pieces[tail] if tail else self.pieces[head.lower()]
        return self.packed(self.full.encode(text, add_special_tokens=False).ids)

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned ids of the whole text, ``kind`` each."""
        if len(self.cache) + len(self.pieces) > self.cache_words:
            self.cache.clear()
            self.pieces.clear()
        # One pass: a word that isn't remembered yet is looked up on the way.
        return b"".join(map(self.cache.__getitem__, text.encode("utf-8", "replace").split()))


class _Memory(dict):
    """Remembers what ``made`` gives for each key."""

    def __init__(self, made: Callable[[Any], bytes]) -> None:
        super().__init__()
        self.made = made

    def __missing__(self, key: Any) -> bytes:
        value = self[key] = self.made(key)
        return value


_tokenizers: dict[str, WordTokenizer] = {}
_lock = threading.Lock()


def tokenizer(path: str) -> WordTokenizer:
    """One for each worker process, so that its memory of words serves all its tasks."""
    with _lock:
        if path not in _tokenizers:
            _tokenizers[path] = WordTokenizer(path)
        return _tokenizers[path]


def tokenized(docs: DataFrame, path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``row, doc_id, source, n, ids``: ``ids`` are little-endian unsigned ids of ``id_kind`` bits with ``end_id`` appended."""
    kind = tokenizer(path).kind
    end = np.array([end_id], dtype=kind).tobytes()

    @F.pandas_udf("binary")
    def encode(texts: pd.Series) -> pd.Series:
        t = tokenizer(path)
        return pd.Series([t.ids(x) + end for x in texts], dtype=object)

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), encode(text_or_empty(text_col)).alias("ids")
    )
    return rows.withColumn("n", (F.octet_length("ids") / np.dtype(kind).itemsize).cast("long"))


def serve(queues: dict[str | None, deque], share: Mapping[str | None, float], deficit: dict[str | None, float], at: int, width: int) -> Iterator[tuple[int, int]]:
    """Deficit round-robin. ``queues``: (row, tokens) in order. Yields (row, place in the stream), from place ``at`` on.

    A round is a window: it adds to each live queue's deficit its share of ``width``, then visits the queues in turn; a queue is
    served while its deficit is above zero, and what a document takes beyond it stays as debt for later windows. A document
    that passes a window's end goes on in the next one.
    """
    order = sorted((s for s in queues if queues[s]), key=lambda s: (s is None, s or ""))
    while order:
        live = sum(share.get(s, 0.0) for s in order)
        quantum = {s: (share.get(s, 0.0) / live if live > 0 else 1 / len(order)) * width for s in order}
        # Rounds in which every queue would still be in debt are taken at once.
        waits = [-deficit[s] // q for s, q in quantum.items() if q > 0]
        skip = max(0.0, min(waits, default=0.0))
        idle = not any(q > 0 for q in quantum.values())
        for s in order:
            deficit[s] += quantum[s] * (1 + skip)
        for s in order:
            queue = queues[s]
            while queue and (deficit[s] > 0 or idle):
                row, n = queue.popleft()
                yield row, at
                at += n
                deficit[s] -= n
        order = [s for s in order if queues[s]]


def pack(
    docs: DataFrame,
    path: str | None = None,
    width: int = WIDTH,
    end_id: int = END_ID,
    weights: Mapping[str | None, float] | None = None,
    bucket_rows: int = BUCKET_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source``.

    ``weights``: target token shares by source; by default each source's share of all tokens, so that the queues drain together. When
    a queue is empty the others share what it had; sources without a weight come last.
    Null or empty texts hold the end id alone. A null source is a queue of its own. Repeated rows are packed each. Extra columns are
    ignored; an empty table gives no rows. Every sequence but the last of all has ``width`` tokens.
    """
    spark = docs.sparkSession
    small_batches(docs)
    path = path or vocabulary_path()
    stored = tokenizer(path).kind
    table = materialize(tokenized(docs, path, end_id, id_col, text_col, source_col), "tokens")
    buckets = max(1, -(-table.count() // bucket_rows))
    place = F.xxhash64(F.lit("pack"), F.col("doc_id"), F.col("row"))
    narrow = table.select("row", "source", "n", F.pmod(place, F.lit(buckets * SLOTS)).alias("slot"), place.alias("h"))

    # Slots are fixed random parts of each source's queue; the clock at which a slot is due picks its bucket.
    slots = materialize(narrow.groupBy("slot", "source").agg(F.sum("n").alias("tokens"), F.count("*").alias("rows")), "slots")
    total = slots.groupBy("source").agg(F.sum("tokens").alias("all"), F.sum("rows").alias("rows"))
    if weights is None:
        share = F.col("all") / F.sum("all").over(Window.partitionBy())
        total = total.withColumn("share", share)
    else:
        whole = float(sum(weights.values())) or 1.0
        given = spark.createDataFrame([(k, float(v) / whole) for k, v in weights.items()], "s string, share double")
        total = total.join(given, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "all", "rows", F.coalesce("share", F.lit(0.0)).alias("share"))
    # One row a source.
    total = materialize(total, "sources")
    curve = total.agg(F.collect_list(F.struct("all", "rows", "share")).alias("curve"))
    before = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    due = slots.withColumn("served", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("double"))
    due = due.join(total.select(F.col("source").alias("s"), "share"), F.col("source").eqNullSafe(F.col("s"))).crossJoin(F.broadcast(curve))
    # At clock v a source has served v times its share, or all that it has; sources without a share come after the others.
    v = F.when(F.col("share") > 0, F.col("served") / F.col("share")).otherwise(F.lit(float("inf")))
    at = F.aggregate("curve", F.lit(0.0), lambda acc, x: acc + F.when(x["share"] > 0, F.least(F.lit(1.0), F.col("_v") * x["share"] / x["all"])).otherwise(F.lit(0.0)) * x["rows"])
    late = F.when(F.col("share") > 0, F.lit(0.0)).otherwise(F.col("slot") / F.lit(buckets * SLOTS) * (F.aggregate("curve", F.lit(0.0), lambda acc, x: acc + F.when(x["share"] > 0, F.lit(0.0)).otherwise(x["rows"].cast("double")))))
    rank = F.floor((F.col("_at") + late) / bucket_rows)
    due = due.withColumn("_v", v).withColumn("_at", at).select(F.col("slot").alias("_slot"), F.col("source").alias("_source"), "tokens", F.least(rank, F.lit(buckets - 1)).cast("int").alias("bucket"))
    due = materialize(due, "due")
    narrow = narrow.join(due.drop("tokens"), (F.col("slot") == F.col("_slot")) & F.col("source").eqNullSafe(F.col("_source"))).select("bucket", "row", "source", "n", "h")

    sums = due.groupBy("bucket", F.col("_source").alias("source")).agg(F.sum("tokens").alias("tokens"))
    by_source = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    by_bucket = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.groupBy("bucket").agg(F.sum("tokens").alias("tokens")).select("bucket", F.coalesce(F.sum("tokens").over(by_bucket), F.lit(0)).alias("begin"))
    # What each bucket's queues hold and have served before, and the clock there: that at which the deficits cancel out.
    served = sums.withColumn("served", F.coalesce(F.sum("tokens").over(by_source), F.lit(0)))
    state = (
        served.join(total.select(F.col("source").alias("s"), "share"), F.col("source").eqNullSafe(F.col("s")))
        .join(begins, "bucket")
        .groupBy(F.col("bucket").alias("b"), "begin")
        .agg(F.collect_list(F.struct("source", "share", "served")).alias("sources"), (F.sum(F.when(F.col("share") > 0, F.col("served"))) / F.sum("share")).alias("clock"))
    )

    def schedule(key: tuple, rows: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        begin, sources = int(states["begin"].iloc[0]), states["sources"].iloc[0]
        clock = 0.0 if pd.isna(states["clock"].iloc[0]) else float(states["clock"].iloc[0])
        share = {x["source"]: float(x["share"]) for x in sources}
        deficit = {s: share[s] * clock - float(x["served"]) if share[s] > 0 else 0.0 for x in sources for s in [x["source"]]}
        queues: dict[str | None, deque] = {s: deque() for s in share}
        rows = rows.sort_values(["h", "row"])
        names = [None if pd.isna(s) else s for s in rows["source"]]
        for s, row, n in zip(names, rows["row"].tolist(), rows["n"].tolist(), strict=True):
            queues[s].append((row, n))
        return pd.DataFrame(list(serve(queues, share, deficit, begin, width)), columns=["row", "at"])

    placed = narrow.groupBy("bucket").cogroup(state.groupBy("b")).applyInPandas(schedule, "row long, at long")

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for doc, source, n, ids, at in zip(batch["doc_id"], batch["source"], batch["n"].tolist(), batch["ids"], batch["at"].tolist(), strict=True):
                start, whole = 0, np.frombuffer(ids, dtype=stored).astype("<u4").tobytes()
                while start < n:
                    seq, off = divmod(at + start, width)
                    length = min(width - off, n - start)
                    out.append((doc, start, length, zlib.crc32(whole[4 * start : 4 * (start + length)]), n, seq, off, source))
                    start += length
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]).astype({"doc_id": batch["doc_id"].dtype})

    kind, named = docs.schema[id_col].dataType.simpleString(), docs.schema[source_col].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source {named}"
    return table.join(placed, "row").select("doc_id", "source", "n", "ids", "at").mapInPandas(pieces, schema)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
