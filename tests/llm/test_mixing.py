import hashlib
import re

import pytest

from marlstone.llm.mixing import mix, source_targets


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Resharing by rounds, as the rule is written."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, live = share * sum(sizes.values()), {}, list(names)
    while live:
        total = sum(w[s] for s in live)
        over = [s for s in live if left * w[s] / total > cap * sizes[s]]
        if not over:
            out |= {s: left * w[s] / total for s in live}
            break
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            live.remove(s)
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 10, "c": 5, None: 7}, {"a": 1, "b": 1000}, {"z": 5}, {"a": 0, "b": 3, "c": 9, "d": 100}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    assert {r.source: pytest.approx(r.target) for r in source_targets(rows).collect()} == targets(sizes)


def test_edges(docs, edge_rows):
    out = mix(docs(edge_rows)).collect()
    assert len(out) == len(edge_rows)
    assert {(r.doc_id, r.size) for r in out} == {(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, _ in edge_rows}
    assert all(r.taken <= 2 * r.size for r in out)
    assert mix(docs([])).count() == 0


def test_targets_are_met_and_reruns_agree(docs):
    rows = [(i, "word " * (1 + i % 50), f"s{i % 5 if i % 3 else 0}") for i in range(3000)]
    first = mix(docs(rows)).collect()
    taken, target = {}, {}
    for r in first:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 60 for s in target)
    assert sorted(mix(docs(rows[::-1])).collect()) == sorted(first)
    small, large = ({r.doc_id for r in mix(docs(rows), share=x).collect() if r.copies} for x in (0.3, 0.6))
    assert small <= large


def thresholds_by_hand(rows, share=1.5):
    """Copies of each document, source by source: whole copies, then those whose hash lies below the budget's, the boundary one if that comes nearer."""
    sizes = {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = targets(sizes)
    out = {}
    for s in sizes:
        own = sorted((int(hashlib.md5(str(i).encode()).hexdigest()[:16], 16), i, len((t or "").split())) for i, t, x in rows if x == s)
        whole = int(want[s] // max(sizes[s], 1))
        left, done = want[s] - whole * sizes[s], False
        for _, i, n in own:
            more = not done and (n <= left or left * 2 >= n)
            if n > left:
                done = True
            left -= n
            out[i] = whole + more
    return out


def test_against_brute_force(docs):
    rows = [(i, "word " * (1 + i * 7 % 40), f"s{i % 4 if i % 3 else 0}") for i in range(400)]
    assert {r.doc_id: r.copies for r in mix(docs(rows)).collect()} == thresholds_by_hand(rows)


def test_null_ids(docs):
    out = mix(docs([(None, "a b", "s"), (None, "c", None), (5, "d e f", "s")])).collect()
    assert sorted((r.doc_id is None, r.size) for r in out) == [(False, 3), (True, 1), (True, 2)]
