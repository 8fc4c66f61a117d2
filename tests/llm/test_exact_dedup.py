import re

import pytest
from pyspark.sql import functions as F

from marlstone.llm.exact_dedup import exact_dedup


WAYS = [{}, {"broadcast_ids": 0}]


def brute(rows):
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    return {(i, min(g)[1], len(g)) for n, g in groups.items() for _, i in g}


@pytest.mark.parametrize("way", WAYS)
def test_edges(docs, edge_rows, way):
    out = exact_dedup(docs(edge_rows), **way).collect()
    assert len(out) == len(edge_rows)
    assert {(r.doc_id, r.keep_id, r.group_size) for r in out} == brute(edge_rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in out)


@pytest.mark.parametrize("way", WAYS)
def test_hot_groups_are_salted_and_stay_whole(docs, way):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i}", "s") for i in range(4000)]
    out = exact_dedup(docs(rows), hot_share=0.0001, salts=8, **way).where("group_size > 1")
    assert out.agg(F.min("keep_id"), F.max("keep_id"), F.count("*"), F.min("group_size")).first()[:] == (0, 0, 1334, 1334)


@pytest.mark.parametrize("way", WAYS)
def test_colliding_digests_do_not_merge(docs, way):
    rows = [(1, "a", "s"), (2, "b", "s"), (3, "a ", "s")]
    out = {r.doc_id: r.keep_id for r in exact_dedup(docs(rows), digest=lambda c: F.lit(b"x"), **way).collect()}
    assert out == {1: 3, 2: 2, 3: 3}


@pytest.mark.parametrize("way", WAYS)
def test_hot_collisions_are_compared_by_content(docs, way):
    rows = [(i, f"text {i % 2 + i % 3}" if i % 5 else f"own {i}", "s") for i in range(900)]
    out = exact_dedup(docs(rows), digest=lambda c: F.substring(c, 1, 4).cast("binary"), hot_share=0.0001, salts=8, **way).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in out} == brute(rows)


def test_null_ids_and_empty_table(docs):
    out = {(r.doc_id, r.keep_id) for r in exact_dedup(docs([(None, "a", "s"), (-5, "a", "s"), (None, "b", "s")])).collect()}
    assert out == {(None, -5), (-5, -5), (None, None)}
    assert exact_dedup(docs([])).count() == 0
