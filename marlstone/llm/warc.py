"""WARC archives: a writer with one gzip member a record, and a salvage reader.

Archives are written by Spark's text writer, so they reach any store that Spark can write to: each record's gzip member is one
row, and the row separator is a zero byte, which gzip readers take for padding between members. The reader checks each member
(deflate stream, CRC, length) and each record (version line, header, content length, closing blank lines, block digest). After a
failed check it searches on for the next member or version line whose record passes, and logs the bytes between as a gap. Inside a
member that holds several records the search goes on in the inflated bytes, and of a member that is damaged or cut off the records
inflated before the damage stay, if their own digests vouch for them.

An archive is read whole by one task, so archives are to be cut to at most 2 GB, the reader's bound on a file; the writer's are parts of
a partition each.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import scratch_path, small_batches

DATE = "2024-01-01T00:00:00Z"
VERSION = b"WARC/1."
GZIP = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6f1c9a64-3f0e-4a0b-9d3c-5d0c8b6f2a11")


def sha1_32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, keep_id: int | None, date: str = DATE) -> bytes:
    """A response record, or a revisit of ``keep_id``'s response where that is given."""
    digest = sha1_32(payload)
    name = lambda i: f"<urn:uuid:{uuid.uuid5(_SPACE, f'{i}:{digest}')}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if keep_id is not None else http + payload
    target = "".join(c for c in url or "" if c > " " and c != "\x7f")
    head = {
        "WARC-Type": "response" if keep_id is None else "revisit",
        "WARC-Record-ID": name(f"{page_id}" if keep_id is None else f"{page_id}>{keep_id}"),
        "WARC-Date": date,
        "WARC-Target-URI": target,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{sha1_32(block)}",
    }
    if page_id is not None:
        head["X-Page-Id"] = str(page_id)
    if keep_id is not None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": name(f"{keep_id}"), "X-Refers-To-Page-Id": str(keep_id)}
    head |= {"Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


@dataclass
class Found:
    """A record, or a gap (``head`` is None), with the archive's bytes ``[start, end)`` that hold it."""

    start: int
    end: int
    head: dict[str, str] | None = None
    block: bytes = b""
    reason: str = ""


class Bad(Exception):
    """A failed check."""


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """The record that begins at ``at``: header (lower-case names), block and end; ``Bad`` if a check fails."""
    if not data.startswith(VERSION, at):
        raise Bad("no version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise Bad("header without end")
    if data.find(b"\r\n" + VERSION, at, stop) >= 0:
        raise Bad("another record begins in the header")
    head = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Bad("header line without colon")
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    try:
        length = int(head["content-length"])
    except (KeyError, ValueError):
        raise Bad("no content length") from None
    begin = stop + 4
    end = begin + length
    if length < 0 or data[end : end + 4] != b"\r\n\r\n":
        raise Bad("the block doesn't end where its length says")
    block = data[begin:end]
    said = head.get("warc-block-digest", "")
    if said.startswith("sha1:") and said[5:] != sha1_32(block):
        raise Bad("the block digest differs")
    return head, block, end + 4


def inflate(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What can be inflated of the gzip member at ``at``, its end, and what is wrong with it (empty if nothing is)."""
    unpack, view, out, pos = zlib.decompressobj(31), memoryview(data), [], at
    try:
        while not unpack.eof and pos < len(data):
            # Small pieces, so that little before the damage is lost with it.
            piece = view[pos : pos + 4096]
            out.append(unpack.decompress(piece))
            pos += len(piece)
    except zlib.error as e:
        return b"".join(out), pos, f"damaged member: {e}"
    return b"".join(out), pos - len(unpack.unused_data), "" if unpack.eof else "the member is cut off"


def plain_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes, str]]:
    """Start, end, header, block and reason of the records in bytes that aren't compressed; header None for a run that no record owns."""
    at, gap, reason = 0, -1, ""
    while at < len(data):
        try:
            head, block, end = parse_record(data, at)
        except Bad as e:
            if gap < 0:
                gap, reason = at, str(e)
            at = data.find(VERSION, at + 1)
            at = len(data) if at < 0 else at
            continue
        if gap >= 0:
            yield gap, at, None, b"", reason
            gap = -1
        yield at, end, head, block, ""
        at = end
    if gap >= 0:
        yield gap, len(data), None, b"", reason


def salvage(data: bytes) -> Iterator[Found]:
    """All records of an archive (plain, or gzip members) in order, with a gap for each run of bytes that no record owns.

    A gap inside a sound member has the member's range and says which inflated bytes are lost. Records saved from a damaged member
    have the range of the gap that follows them.
    """
    at, size, gap, reason = 0, len(data), -1, ""
    saved: list[Found] = []
    while at < size:
        found: list[Found] = []
        end = at + 1
        try:
            if data.startswith(GZIP, at):
                inner, end, wrong = inflate(data, at)
                parts = list(plain_records(inner))
                if wrong:
                    saved += [Found(at, at, h, block) for _, _, h, block, _ in parts if h is not None and h.get("warc-block-digest", "").startswith("sha1:")]
                    raise Bad(wrong)
                if not any(h is not None for _, _, h, _, _ in parts):
                    raise Bad(parts[0][4] if parts else "an empty member")
                for a, z, head, block, why in parts:
                    found.append(Found(at, end, head, block) if head is not None else Found(at, end, reason=f"inflated bytes {a} to {z}: {why}"))
            elif data.startswith(VERSION, at):
                head, block, end = parse_record(data, at)
                found.append(Found(at, end, head, block))
            elif gap < 0 and data[at] in b"\x00\r\n":
                at += 1
                continue
            else:
                raise Bad("neither a member nor a version line")
        except Bad as e:
            if gap < 0:
                gap, reason = at, str(e)
            nexts = [p for p in (data.find(GZIP, at + 1), data.find(VERSION, at + 1)) if p >= 0]
            at = min(nexts, default=size)
            continue
        if gap >= 0:
            yield from (Found(gap, at, f.head, f.block) for f in saved)
            yield Found(gap, at, reason=reason)
            gap, saved = -1, []
        yield from found
        at = end
    if gap >= 0:
        yield from (Found(gap, size, f.head, f.block) for f in saved)
        yield Found(gap, size, reason=reason)


def write_archives(pages: DataFrame, path: str, min_payload: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """One record per row in ``.txt`` files of gzip members below ``path``.

    Of rows with equal payloads of at least ``min_payload`` bytes that with the smallest id is a response and the others revisit
    it; all else are responses. A null payload is empty. A row whose id is null is a response, as nothing could tell it apart.
    Rows that repeat the response's own id are responses too.
    """
    small_batches(pages)
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload")
    ).withColumn("sha", F.unhex(F.sha1("payload")))
    ids = rows.select("id", "sha", F.octet_length("payload").alias("n")).where("id is not null").distinct()
    least = ids.where(F.col("n") >= min_payload).groupBy("sha", "n").agg(F.min("id").alias("keep"), F.count("*").alias("c")).where("c > 1").drop("c", "n")
    revisits = ids.select("id", "sha").join(least, "sha").where("id <> keep")

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [
                gzip_member(record(None if pd.isna(i) else int(i), u, bytes(p), None if pd.isna(k) else int(k)))
                for i, u, p, k in zip(b["id"], b["url"], b["payload"], b["keep"], strict=True)
            ]
            yield pd.DataFrame({"member": out})

    wide = rows.join(revisits, ["id", "sha"], "left").select("id", "url", "payload", "keep")
    wide.mapInPandas(members, "member binary").select(F.col("member").cast("string")).write.option("lineSep", "\u0000").text(path)


def read_archives(spark: SparkSession, path: str, with_block: bool = True, glob: str = "*.{txt,warc,gz}") -> DataFrame:
    """Every record and quarantined gap below ``path``.

    ``archive, start, end`` (byte range), ``kind`` (record or gap), ``reason`` (of a gap), ``record_type, record_id, page_id, target_uri,
    refers_to`` (the page id a revisit names), ``payload_digest`` (bare base32 SHA-1, of the bytes read for a response, as stated for a
    revisit), ``payload_bytes`` (null for a revisit), ``payload`` (null unless ``with_block``). An empty file gives no rows.
    """
    small_batches(files := spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path))

    def number(x: str | None) -> int | None:
        try:
            return int(x) if x is not None else None
        except ValueError:
            return None

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"], strict=True):
                out: list[tuple] = []
                held = 0
                for f in salvage(bytes(data)):
                    if f.head is None:
                        out.append((name, f.start, f.end, "gap", f.reason, None, None, None, None, None, None, None, None))
                        continue
                    h, kind = f.head, f.head.get("warc-type")
                    payload = digest = None
                    if kind == "revisit":
                        digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    else:
                        http = f.block.startswith(b"HTTP/")
                        payload = f.block[f.block.find(b"\r\n\r\n") + 4 :] if http else f.block
                        digest = sha1_32(payload)
                    size = None if payload is None else len(payload)
                    out.append((name, f.start, f.end, "record", None, kind, h.get("warc-record-id"), number(h.get("x-page-id")), h.get("warc-target-uri"), number(h.get("x-refers-to-page-id")), digest, size, payload if with_block else None))
                    held += len(f.block) if with_block else 0
                    if len(out) >= 2000 or held > 1 << 24:
                        yield frame(out)
                        out, held = [], 0
                if out:
                    yield frame(out)

    columns = ["archive", "start", "end", "kind", "reason", "record_type", "record_id", "page_id", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload"]

    def frame(out: list[tuple]) -> pd.DataFrame:
        made = pd.DataFrame(out, columns=columns)
        return made.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})

    return files.select("path", "content").mapInPandas(
        parse,
        "archive string, start long, end long, kind string, reason string, record_type string, record_id string, page_id long, target_uri string, refers_to long, payload_digest string, payload_bytes long, payload binary",
    )


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Give each revisit the payload size of the response that it names (null if that is lost)."""
    sizes = (
        records.where("kind = 'record' and record_type = 'response'")
        .groupBy(F.col("page_id").alias("_p"), F.col("payload_digest").alias("_d"))
        .agg(F.max("payload_bytes").alias("_n"))
    )
    on = (F.col("refers_to") == F.col("_p")) & (F.col("payload_digest") == F.col("_d"))
    return records.join(sizes, on, "left").withColumn("payload_bytes", F.coalesce("payload_bytes", "_n")).drop("_p", "_d", "_n")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    read = read_archives(spark, path, with_block=False).where("kind = 'record'").drop("payload")
    return resolve_revisits(read).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB has no SHA-1 as base32; the digest is made from the hex digits of sha1(), five bits at a time.
SQL = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT page_id, n, h, min(page_id) OVER (PARTITION BY h, n) AS k FROM p),
b AS (SELECT *, list_aggregate(list_transform(range(0, 32), lambda i:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
    ((('0x' || substr(h || '0000', (i * 5 // 4)::INT + 1, 3))::BIGINT) >> (7 - (i * 5) % 4)) & 31)::INT, 1)), 'string_agg', '') AS d FROM r)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN page_id = k THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = k THEN NULL ELSE k END AS refers_to
FROM b
"""
