import zlib
from collections import defaultdict, deque

import numpy as np
from tokenizers import Tokenizer

from marlstone.llm.common import documents
from marlstone.llm.packing import pack, serve, tokenizer, vocabulary_path


def ids(full, text):
    return [*full.encode(text or "", add_special_tokens=False).ids, 2]


def check(out, texts, width=4096):
    full = Tokenizer.from_file(vocabulary_path())
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for i, copies in texts.items():
        want = ids(full, copies[0])
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert sum(r.length for r in pieces) == len(copies) * len(want) and {r.doc_tokens for r in pieces} == {len(want)}
        for r in pieces:
            assert r.ids_crc32 == zlib.crc32(np.array(want[r.start : r.start + r.length], dtype="<u4").tobytes())
    for s, pieces in by_seq.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == width or (s == max(by_seq) and at < width)


def test_edges(docs, edge_rows):
    texts = defaultdict(list)
    for i, t, _ in edge_rows:
        texts[i].append(t)
    for buckets in (3, 20_000):
        check(pack(docs(edge_rows), bucket_rows=buckets).collect(), texts)
    assert pack(docs([])).count() == 0


def test_all_documents(spark):
    d = documents(spark, "/root/testdata/sf0.001")
    check(pack(d, bucket_rows=50).collect(), {r.doc_id: [r.text] for r in d.collect()})


def test_word_memory_equals_the_library(spark):
    t = tokenizer(vocabulary_path())
    for r in documents(spark, "/root/testdata/sf0.001").collect():
        assert np.frombuffer(t.ids(r.text or ""), dtype=t.kind).tolist() == ids(t.full, r.text)[:-1]
    for odd in ("İstanbul ÀÉß ... a,b!!! x y z \u0085 \x1c 😀é", "don't STOP... (now) $5.00", "﻿é́ ﬁ Ǆ"):
        assert np.frombuffer(t.ids(odd), dtype=t.kind).tolist() == ids(t.full, odd)[:-1]


def test_every_window_keeps_the_shares():
    queues = {"a": deque((i, 50) for i in range(4000)), "b": deque((10_000 + i, 400) for i in range(250)), None: deque((20_000 + i, 10) for i in range(5000))}
    share = {"a": 0.5, "b": 0.3, None: 0.2}
    names = lambda row: "a" if row < 10_000 else "b" if row < 20_000 else None
    size = {row: n for q in queues.values() for row, n in q}
    got = defaultdict(lambda: defaultdict(int))
    for row, at in serve(queues, share, dict.fromkeys(share, 0.0), 0, 4096):
        got[at // 4096][names(row)] += size[row]
    for window in range(1, 40):
        for s, part in share.items():
            assert abs(got[window][s] / 4096 - part) < 0.15


def test_given_weights_and_carried_deficits(docs):
    rows = [(i, "word " * (20 + i % 7), "ab"[i % 2]) for i in range(900)]
    out = pack(docs(rows), weights={"a": 0.75, "b": 0.25}, bucket_rows=100).collect()
    check(out, {i: [t] for i, t, _ in rows})
    first = [r for r in out if r.sequence_id == 1]
    assert abs(sum(r.length for r in first if r.source == "a") / 4096 - 0.75) < 0.1


def test_null_ids(docs):
    out = pack(docs([(None, "a b", "s"), (None, None, None), (5, "c", "s")])).collect()
    assert sorted((r.doc_id is None, r.doc_tokens > 1) for r in out) == [(False, True), (True, False), (True, True)]
