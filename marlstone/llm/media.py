"""Media columns: content-defined chunks, a chunk store deduplicated by Spark joins, ordered chunk lists.

Every payload becomes a WAV file, and that file is what is cut, stored and read back. It is cut where a rolling gear hash of its last
32 bytes meets a mask, so equal passages give equal chunks wherever they stand. A first, narrow pass counts chunk digests. A second
writes the media: chunks that occur once stay inline in their media row; the others go to a store that holds each digest once, and the
media row's ordered list refers to them. So the corpus itself is never shuffled: only digests and repeated chunks are. Reading joins
the lists with the store, puts each file together, checks its digest and only then reads samples from it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import documents, materialize, slot_map, small_batches, text_or_empty

UNIT = 64
MIN_CHUNK, MAX_CHUNK, MASK_BITS = 256, 8192, 10
SAMPLE_RATE = 8000
#: The map of repeated digests that executors get has at least 32 slots for each, and at most 2 ** 28 slots (32 MB). Beyond 8 million
#: repeated digests it fills up, which only sends more chunks to the store; results don't depend on it.
LEAST_BITS, MOST_BITS, SLOT_BITS = 18, 28, 5
#: Digests of stored chunks that a task remembers, so that it writes a chunk of its own copies once.
REMEMBERED = 100_000

_GEAR = np.frombuffer(b"".join(hashlib.sha256(f"gear-{i}".encode()).digest()[:4] for i in range(256)), dtype="<u4")


def gear_hashes(data: bytes) -> np.ndarray:
    """At each position ``sum(GEAR[byte i back] << i)`` over the last 32 bytes, modulo 2**32, in five doubling steps."""
    h = _GEAR[np.frombuffer(data, dtype=np.uint8)]
    for step in (1, 2, 4, 8, 16):
        shifted = np.zeros_like(h)
        shifted[step:] = h[:-step] << np.uint32(step)
        h = h + shifted
    return h


def cuts(data: bytes, least: int = MIN_CHUNK, most: int = MAX_CHUNK, mask_bits: int = MASK_BITS) -> list[int]:
    """Ends of the chunks, the last being the length; every chunk has at most ``most`` bytes and all but the last at least ``least``."""
    ends: list[int] = []
    start, n = 0, len(data)
    if n > least:
        places = np.flatnonzero((gear_hashes(data) >> np.uint32(32 - mask_bits)) == 0) + 1
        for p in places.tolist():
            while p - start > most:
                start += most
                ends.append(start)
            if p - start >= least and p < n:
                ends.append(p)
                start = p
    while n - start > most:
        start += most
        ends.append(start)
    if n > start or not ends:
        ends.append(n)
    return ends


def padded(text: str | None) -> tuple[int, bytes]:
    """Length of the text in UTF-8, and the payload: that text with zero bytes up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "replace")
    return len(raw), raw + b"\0" * ((-len(raw)) % UNIT or (UNIT if not raw else 0))


def wav(samples: bytes, rate: int = SAMPLE_RATE) -> bytes:
    """A mono WAV file of unsigned 8-bit samples."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples


def wav_samples(data: bytes) -> bytes:
    """The samples of a file that ``wav`` made; ValueError if it is another kind or cut off."""
    if data[:4] != b"RIFF" or data[8:16] != b"WAVEfmt " or data[34:36] != b"\x08\0" or data[36:40] != b"data":
        raise ValueError("not a mono 8-bit WAV file")
    (n,) = struct.unpack_from("<I", data, 40)
    if len(data) != 44 + n:
        raise ValueError("the file is cut off")
    return data[44:]


def feature(samples: bytes) -> str:
    """Mean, root mean square about the middle, zero crossings and an 8-bin histogram of the samples."""
    x = np.frombuffer(samples, dtype=np.uint8).astype(np.int16) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    bins = np.bincount((x + 128) >> 5, minlength=8)
    return f"mean={x.mean():.6f};rms={np.sqrt((x.astype(np.float64) ** 2).mean()):.6f};crossings={crossings};histogram={'/'.join(map(str, bins))}"


def _chunks(payload: bytes) -> list[bytes]:
    at, out = 0, []
    for end in cuts(payload):
        out.append(payload[at:end])
        at = end
    return out


def _inflated(data: bytes) -> bytes:
    try:
        return zlib.decompress(data)
    except zlib.error:
        return b""


def _slot(digest: bytes, bits: int) -> int:
    return int.from_bytes(digest[:4], "big") >> (32 - bits)


def repeated_map(texts: DataFrame) -> tuple[np.ndarray, int]:
    """A bit for each slot of repeated chunk digests, and the bits of a slot number."""

    @F.pandas_udf("array<binary>")
    def digests(batch: pd.Series) -> pd.Series:
        return pd.Series([[hashlib.sha256(c).digest() for c in _chunks(wav(padded(t)[1]))] for t in batch])

    repeated = materialize(texts.select(F.explode(digests("_text")).alias("d")).groupBy("d").count().where("count > 1").select(F.substring("d", 1, 4).alias("d")), "repeated")
    bits = min(MOST_BITS, max(LEAST_BITS, repeated.count().bit_length() + SLOT_BITS))
    slot = F.shiftrightunsigned(F.conv(F.hex("d"), 16, 10).cast("long"), 32 - bits)
    return slot_map(repeated.select(slot.alias("s")), bits), bits


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Writes both tables and returns them as read back.

    Media: ``row, id, n_bytes, sha, size, lengths, digests, inline`` - digest and length of the file, and for each chunk its length and,
    if it is in the store, its digest (else null); ``inline`` has the other chunks' bytes in order. Store: ``digest, bytes``, each digest once.
    """
    spark = docs.sparkSession
    small_batches(docs)
    texts = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    held, bits = repeated_map(texts)
    shared = spark.sparkContext.broadcast(held)
    columns = ["row", "id", "n_bytes", "sha", "size", "lengths", "digests", "inline", "digest", "bytes"]

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()
        for b in batches:
            out: list[tuple] = []
            for row, i, t in zip(b["row"], b["id"], b["text"], strict=True):
                n, payload = padded(t)
                data = wav(payload)
                parts, keys = _chunks(data), []
                for c in parts:
                    d = hashlib.sha256(c).digest()
                    s = _slot(d, bits)
                    keys.append(d if int(shared.value[s >> 6]) >> (s & 63) & 1 else None)
                    if keys[-1] is not None and d not in seen:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(d)
                        out.append((row, None, None, None, None, None, None, None, d, zlib.compress(c, 6)))
                inline = b"".join(c for c, k in zip(parts, keys, strict=True) if k is None)
                out.append((row, i, n, hashlib.sha256(data).hexdigest(), len(data), [len(c) for c in parts], keys, inline, None, None))
            made = pd.DataFrame(out, columns=columns)
            yield made.astype({"n_bytes": "Int64", "size": "Int64"} | ({"id": "Int64"} if kind in ("bigint", "int") else {}))

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"row long, id {kind}, n_bytes long, sha string, size long, lengths array<int>, digests array<binary>, inline binary, digest binary, bytes binary"
    rows = texts.select(F.monotonically_increasing_id().alias("row"), F.col("_id").alias("id"), F.col("_text").alias("text"))
    table = materialize(rows.mapInPandas(write, schema), "media")
    # Each digest once; a task's copies have met already. Readers check every file, so a wrong chunk can't pass unseen.
    store = table.where("digest is not null").groupBy("digest").agg(F.first("bytes").alias("bytes"))
    return table.where("digest is null").drop("digest", "bytes"), materialize(store, "chunks")


def read_media(table: DataFrame, store: DataFrame) -> DataFrame:
    """``id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature``: every file put together from its
    chunks and its digest checked; a chunk that is lost or damaged is a ValueError."""
    has = F.exists("digests", lambda d: d.isNotNull())
    refs = table.where(has).select("row", F.explode(F.array_distinct(F.filter("digests", lambda d: d.isNotNull()))).alias("digest"))
    parts = refs.join(store, "digest").groupBy("row").agg(F.collect_list(F.struct("digest", "bytes")).alias("parts"))
    kind = table.schema["id"].dataType.simpleString()

    def assemble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, n, sha, size, lengths, digests, inline, own in zip(*(b[c] for c in ("id", "n_bytes", "sha", "size", "lengths", "digests", "inline", "parts")), strict=True):
                held = {bytes(p["digest"]): p["bytes"] for p in own} if own is not None else {}
                at, pieces = 0, []
                for length, d in zip(lengths, digests, strict=True):
                    if d is None:
                        pieces.append(inline[at : at + length])
                        at += length
                    else:
                        pieces.append(_inflated(held.get(bytes(d), b"")))
                data = b"".join(pieces)
                found = hashlib.sha256(data).hexdigest()
                if len(data) != size or found != sha:
                    raise ValueError(f"the chunks of {i} don't give back its file")
                x = wav_samples(data)
                out.append((i, n, len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-UNIT:]), len(data), found, feature(x)))
            yield pd.DataFrame(out, columns=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]).astype({"id": b["id"].dtype})

    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    plain = table.where(~has).withColumn("parts", F.lit(None).cast("array<struct<digest: binary, bytes: binary>>"))
    # A file all of whose references are lost must fail its check, so no row is dropped here.
    joined = table.where(has).join(parts, "row", "left")
    return plain.mapInPandas(assemble, schema).unionByName(joined.select(*plain.columns).mapInPandas(assemble, schema))


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature``.

    A null text is empty: 64 zero bytes. All values but the id depend on the text alone. Repeated rows each give a row. Extra
    columns are ignored; an empty table gives no rows.
    """
    return read_media(*store_media(docs, id_col, text_col)).withColumnRenamed("id", id_col)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(documents(spark, sf_dir))
