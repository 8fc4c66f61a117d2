import gzip
import random

import pytest

from marlstone.llm.warc import gzip_member, read_archives, record, resolve_revisits, salvage, sha1_32, write_archives

PAGES = "page_id long, url string, html string, kind string, archive string"


def write(spark, path, rows):
    write_archives(spark.createDataFrame([(*r, "k", "a") for r in rows], PAGES), path)
    return resolve_revisits(read_archives(spark, path)).collect()


def test_round_trip_with_edges(spark, tmp_path):
    rows = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, None, None), (4, "http://a/ü x", ""), (5, "u", "é😀\r\n\r\nWARC/1.1\r\n\0"), (6, "u", "z" * 2_000_000), (2, "http://a/2", "<p>x</p>"), (None, "n", "<p>x</p>")]
    out = write(spark, str(tmp_path / "w"), rows)
    assert len(out) == len(rows) and all(r.kind == "record" for r in out)
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in out}
    assert kinds == {(1, "response", None), (2, "revisit", 1), (3, "response", None), (4, "revisit", 3), (5, "response", None), (6, "response", None), (None, "response", None)}
    for r in out:
        html = next((h for i, _, h in rows if i == r.page_id), "") or ""
        assert r.payload_digest == sha1_32(html.encode()) and r.payload_bytes == len(html.encode())
        assert r.record_type == "revisit" or bytes(r.payload) == html.encode()
    assert write(spark, str(tmp_path / "none"), []) == []


def test_archives_are_plain_gzip(spark, tmp_path):
    write(spark, str(tmp_path / "w"), [(i, "u", f"page {i}") for i in range(5)])
    whole = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w").glob("part-*")) if p.stat().st_size)
    assert whole.count(b"WARC/1.1\r\n") == 5


def members(n):
    return [gzip_member(record(i, f"http://h/{i}", (f"page {i} " * 50).encode(), None)) for i in range(n)]


def ids(found):
    return [int(f.head["x-page-id"]) for f in found if f.head]


@pytest.mark.parametrize("seed", range(12))
def test_salvage_recovers_all_undamaged_members(seed):
    r, parts = random.Random(seed), members(12)
    hurt = set(r.sample(range(12), 3))
    data = b""
    for i, m in enumerate(parts):
        if i in hurt:
            at = r.randrange(len(m))
            m = [m[:at], m[:at] + bytes([m[at] ^ 0x5A]) + m[at + 1 :], bytes(r.randrange(256) for _ in range(50)) + m[60:]][r.randrange(3)]
        data += m
    found = list(salvage(data))
    assert [i for i in ids(found) if i not in hurt] == [i for i in range(12) if i not in hurt]
    # Records and gaps cover every byte once, in order.
    edges = sorted({(f.start, f.end) for f in found})
    assert edges[0][0] == 0 and edges[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(edges, edges[1:], strict=False))


def test_salvage_of_plain_records():
    good = [record(i, "u", b"body %d" % i, None) for i in range(4)]
    bad = good[1].replace(b"body 1", b"bodY 1")
    found = list(salvage(good[0] + bad + good[2] + b"junk" + good[3]))
    assert ids(found) == [0, 2, 3]
    gaps = [(f.start, f.end, f.reason) for f in found if f.head is None]
    assert gaps[0] == (len(good[0]), len(good[0]) + len(bad), "the block digest differs") and gaps[1][1] - gaps[1][0] == 4


def test_gaps_reach_the_table(spark, tmp_path):
    a, b, c = members(3)
    (tmp_path / "x.warc").write_bytes(a + b[:-30] + c)
    (tmp_path / "empty.warc").write_bytes(b"")
    out = read_archives(spark, str(tmp_path)).orderBy("start").collect()
    assert [(r.kind, r.page_id) for r in out] == [("record", 0), ("gap", None), ("record", 2)]
    assert (out[1].start, out[1].end) == (len(a), len(a) + len(b) - 30)


def test_a_bad_record_in_a_member_costs_only_itself():
    good = [record(i, "u", b"body %d" % i * 9, None) for i in range(4)]
    bad = good[2].replace(b"body 2", b"bodY 2")
    data = gzip_member(good[0] + good[1] + bad + good[3]) + gzip_member(record(9, "u", b"next", None))
    found = list(salvage(data))
    assert ids(found) == [0, 1, 3, 9]
    (gap,) = [f for f in found if f.head is None]
    a = len(good[0] + good[1])
    assert gap.reason == f"inflated bytes {a} to {a + len(bad)}: the block digest differs" and gap.start == 0


@pytest.mark.parametrize("cut", [0.5, 0.9])
def test_records_before_the_damage_of_a_member_are_saved(cut):
    r = random.Random(1)
    good = [record(i, "u", bytes(r.randrange(256) for _ in range(3000)), None) for i in range(20)]
    whole = gzip_member(b"".join(good))
    at = int(len(whole) * cut)
    for hurt in (whole[:at], whole[:at] + bytes([whole[at] ^ 0xFF]) + whole[at + 1 :]):
        data = hurt + gzip_member(record(99, "u", b"after", None))
        found = list(salvage(data))
        got = ids(found)
        # Damage that inflating passes over costs one record, other damage all after it.
        assert got == sorted(got) and got[-1] == 99 and set(range(int(20 * cut) - 2)) <= set(got) and len(got) < 21
        assert [f for f in found if f.head is None][0].start == 0


def test_a_stream_of_many_megabytes_is_one_member(spark, tmp_path):
    """No bound on a member's inflated bytes but memory."""
    body = b"x" * 40_000_000
    (tmp_path / "x.warc.gz").write_bytes(gzip_member(record(1, "u", body, None) + record(2, "u", b"y", None)))
    out = read_archives(spark, str(tmp_path), with_block=False).orderBy("page_id").collect()
    assert [(r.page_id, r.payload_bytes, r.kind) for r in out] == [(1, len(body), "record"), (2, 1, "record")]
