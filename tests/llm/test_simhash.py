import random

import pytest
import xxhash

from marlstone.llm.simhash import BKTree, bit_sets, fingerprint_of, hamming_links, near_dedup, shard_links, shingles, simhash_dedup


def slow(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components(values, radius=3):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= radius:
                root[find(a)] = find(b)
    return {frozenset(v for v in values if find(v) == find(r)) for r in values}


def values(n, seed):
    r = random.Random(seed)
    out = set()
    while len(out) < n:
        v = r.getrandbits(64)
        for _ in range(r.randint(1, 6)):
            out.add(v - 2**63)
            v ^= sum(1 << b for b in r.sample(range(64), r.randint(1, 4)))
    return sorted(out)


def test_fingerprints(edge_rows):
    for _, t, _ in edge_rows:
        assert fingerprint_of(t) & (2**64 - 1) == slow(t)


def test_tree_finds_all():
    vs = [v & (2**64 - 1) for v in values(400, 1)]
    tree = BKTree()
    for v in vs:
        tree.add(v)
    for q in vs[::9]:
        assert {vs[i] for i in tree.within(q, 3)} == {v for v in vs if (v ^ q).bit_count() <= 3}


@pytest.mark.parametrize("cap", [2, 8, 1024])
def test_shards_lose_no_link(spark, cap):
    vs = values(300, 2)
    df = spark.createDataFrame([(v,) for v in vs], "v long")
    found = [(r.a, r.b) for r in hamming_links(df, "v", shard_rows=cap).collect()]
    root = {v: v for v in vs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        root[find(a)] = find(b)
    assert {frozenset(v for v in vs if find(v) == find(r)) for r in vs} == components(vs)
    assert len(shard_links(vs)) == len(vs) - len(components(vs))


def test_edges(docs, edge_rows):
    out = simhash_dedup(docs(edge_rows)).collect()
    assert len(out) == len(edge_rows)
    prints = {}
    for i, t, _ in edge_rows:
        prints.setdefault(slow(t), []).append(i)
    groups = components([p - 2**63 for p in prints])
    least = {p: min(i for q in g for i in prints[q + 2**63]) for g in groups for p in (x + 2**63 for x in g)}
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in out} == {(i, f"{slow(t):016x}", least[slow(t)]) for i, t, _ in edge_rows}
    assert simhash_dedup(docs([])).count() == 0


def jaccard(a, b):
    x, y = (shingles(t) for t in (a, b))
    return len(x & y) / len(x | y)


def test_near_dedup_verifies_and_finds(spark, docs):
    """Copies with more and more words changed: what is linked is 0.8 alike, and of the pairs that are alike over nine in ten are found."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    texts, pairs = {}, []
    for g in range(150):
        base = [word() for _ in range(r.randint(60, 300))]
        copy = list(base)
        for _ in range(max(1, int(len(base) * r.choice([0.01, 0.02, 0.03, 0.06, 0.1])))):
            copy[r.randrange(len(copy))] = word()
        texts[2 * g], texts[2 * g + 1] = " ".join(base), " ".join(copy)
        pairs.append((2 * g, 2 * g + 1))
    out = {x.doc_id: x.component_id for x in near_dedup(docs([(i, t, "s") for i, t in texts.items()])).collect()}
    alike = [p for p in pairs if jaccard(texts[p[0]], texts[p[1]]) >= 0.8]
    assert len(alike) > 50 and sum(out[a] == out[b] for a, b in alike) >= 0.9 * len(alike)
    assert all(out[a] != out[b] for a, b in pairs if jaccard(texts[a], texts[b]) < 0.8) and set(out) == set(texts)


def test_near_dedup_of_a_crowd(docs):
    """Hundreds of copies with one word changed are one group, whatever shard they fall into."""
    r = random.Random(6)
    base = [f"word{i}" for i in range(200)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :]), "s") for i in range(1, 400) for k in [r.randrange(200)]]
    out = near_dedup(docs([*rows, (900, "something else entirely here", "s")])).collect()
    assert {x.component_id for x in out if x.doc_id < 900} == {1} and {x.component_id for x in out if x.doc_id == 900} == {900}


def test_near_dedup_edges(docs, edge_rows):
    rows = [r for r in dict.fromkeys(edge_rows)] + [(None, "lone", "s")]
    out = {x.doc_id: x.component_id for x in near_dedup(docs(rows)).collect()}
    assert out == {1: 1, 2: 1, 8: 1, 3: 3, 4: 3, 5: 3, 6: 6, 7: 6, 9: 9, None: None}
    assert near_dedup(docs([])).count() == 0


def test_bit_sets_reach_their_recall():
    r = random.Random(7)
    masks = bit_sets(100_000)
    found = 0
    for _ in range(2000):
        apart = sum(1 << b for b in r.sample(range(64), 10))
        found += any(not m & apart for m in masks)
    assert found >= 0.93 * 2000


def test_null_ids(docs):
    out = simhash_dedup(docs([(None, "a b c d", "s"), (4, "a b c d", "s"), (None, "other words here now", "s")])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in out) == [(0, 0), (0, 4), (4, 4)]
