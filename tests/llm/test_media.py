import hashlib
import math
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.llm.common import documents
from marlstone.llm.media import MAX_CHUNK, MIN_CHUNK, cuts, feature, gear_hashes, media_columns, read_media, store_media, wav, wav_samples


def payload(text):
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def check(out, rows):
    assert len(out) == len(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, t)
    for r in out:
        p = payload(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len((texts[r.doc_id] or "").encode()), len(p), hashlib.sha256(p).hexdigest())
        assert r.tail_crc32 == zlib.crc32(p[-64:]) and r.media_bytes == len(wav(p)) and r.media_sha256 == hashlib.sha256(wav(p)).hexdigest()


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=40_000))
def test_cuts(data):
    ends = cuts(data)
    sizes = [b - a for a, b in zip([0, *ends], ends, strict=False)]
    assert ends[-1] == len(data) and all(0 <= s <= MAX_CHUNK for s in sizes) and all(s >= MIN_CHUNK for s in sizes[:-1])


def test_cuts_follow_content():
    r = random.Random(1)
    body = bytes(r.randrange(32, 127) for _ in range(60_000))
    chunks = lambda d: {d[a:b] for a, b in zip([0, *cuts(d)], cuts(d), strict=False)}
    assert len(chunks(body) & chunks(b"something before" + body)) > 0.8 * len(chunks(body))
    h, g = gear_hashes(body), gear_hashes(body[1000:])
    assert (h[1032:] == g[32:]).all()


def test_wav():
    assert wav_samples(wav(b"abc")) == b"abc"
    for bad in (b"", wav(b"abc")[:-1], b"x" + wav(b"abc")[1:]):
        with pytest.raises(ValueError):
            wav_samples(bad)


def test_edges(docs, edge_rows):
    check(media_columns(docs(edge_rows)).collect(), [(i, t) for i, t, _ in edge_rows])
    assert media_columns(docs([])).count() == 0


def test_all_documents_and_each_digest_once(spark):
    d = documents(spark, "/root/testdata/sf0.001")
    table, store = store_media(d)
    check(read_media(table, store).withColumnRenamed("id", "doc_id").collect(), [(r.doc_id, r.text) for r in d.collect()])
    assert store.count() == store.select("digest").distinct().count() > 0


@pytest.mark.parametrize("damage", ["cut", "other", "lost"])
def test_a_lost_or_wrong_chunk_is_noticed(spark, docs, damage):
    r = random.Random(4)
    text = "".join(r.choice("abcdef ") for _ in range(20_000))
    table, store = store_media(docs([(1, text, "s"), (2, text, "s")]))
    wrong = {"cut": store.withColumn("bytes", store["bytes"].substr(1, 3)), "other": store.withColumn("bytes", F.lit(zlib.compress(b"other"))), "lost": store.where("false")}
    with pytest.raises(Exception, match="don't give back its file"):
        read_media(table, wrong[damage]).collect()


def test_the_stored_bytes_are_the_wav_file(docs):
    text = "a stored text " * 5
    table, store = store_media(docs([(1, text, "s")]))
    (row,) = table.collect()
    assert store.count() == 0 and bytes(row.inline) == wav(payload(text)) and row.sha == hashlib.sha256(wav(payload(text))).hexdigest()


def test_null_ids(docs):
    out = media_columns(docs([(None, "a", "s"), (7, None, "s"), (None, "a", "s")])).collect()
    assert sorted((r.doc_id is None, r.n_bytes) for r in out) == [(False, 0), (True, 1), (True, 1)]


def by_hand(samples):
    """The feature string, sample by sample."""
    x = [b - 128 for b in samples]
    crossings = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))
    bins = [sum(b // 32 == k for b in samples) for k in range(8)]
    return f"mean={sum(x) / len(x):.6f};rms={math.sqrt(sum(v * v for v in x) / len(x)):.6f};crossings={crossings};histogram={'/'.join(map(str, bins))}"


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=1, max_size=300))
def test_feature(samples):
    assert feature(samples) == by_hand(samples)


def test_feature_of_documents(spark):
    d = documents(spark, "/root/testdata/sf0.001")
    texts = {r.doc_id: r.text for r in d.collect()}
    assert all(r.feature == by_hand(payload(texts[r.doc_id])) for r in media_columns(d).collect())
