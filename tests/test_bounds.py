"""What keeps steps in proportion to their input: results stay those of plain Python, and no step makes pairs that can't count."""

import math
import random
import re

import numpy as np
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from marlstone.functions.porter import stem
from marlstone.functions.text import normalize_path
from marlstone.operators import blocks, fulltext, graph, index, lexical, memory, vault, vectors, verify
from marlstone.plans import catalogue
from tests.test_rules import beam_by_hand


def test_a_beam_looks_at_no_more_of_a_hub_than_it_can_accept(spark):
    r = random.Random(8)
    names = [f"n{i:03d}" for i in range(120)]
    edges = list({("hub", n, "calls") for n in names} | {(n, "hub", "imports") for n in names[40:]} | {(r.choice(names), r.choice(names), r.choice(["calls", "contains"])) for _ in range(60)})
    edges = [e for e in edges if e[0] != e[1]]
    e = spark.createDataFrame([(*x, i) for i, x in enumerate(edges + edges[:50])], "src string, dst string, relationship string, seq int")
    lists = graph.nearest(graph.incident(e).withColumn("to_file", F.lit(False)), 9).where("node = 'hub'").first().lists
    assert sorted((x.relationship, x.incoming, len(x.others)) for x in lists) == [("calls", False, 9), ("imports", True, 9)]
    asked = {"a": {"n003": 1.0}, "b": {"hub": 0.5, "n000": 0.9, "n001": 0.9}}
    seeds = spark.createDataFrame([(q, n, s) for q, own in asked.items() for n, s in own.items()], "query_id string, entity_id string, score double")
    nodes = [(n, "function", "x.py") for n in ["hub", *names]]
    for few in (200_000, 0):
        graph.BROADCAST_NODES, kept = few, graph.BROADCAST_NODES
        got = {q: set() for q in asked}
        for row in graph.expand_beam(e, seeds, 6, 3, 14).collect():
            got[row.query_id].add(row.entity_id)
        graph.BROADCAST_NODES = kept
        assert got == {q: beam_by_hand(edges, own, 6, 3, 14, nodes) for q, own in asked.items()}


def test_reconcile_makes_no_rows_of_pairs(spark):
    """Two kinds over several blocks, equal matches, rows that share a title word with a body alone; no join or exchange of pairs in the plan."""
    r = random.Random(4)
    text = lambda n: " ".join(r.choice("abcdefghij") for _ in range(n))
    kind = "id string, kind string, title string, body string, links array<string>"
    one = [(f"a{i:02d}", r.choice(["fact", "error"]), text(3), text(6), [r.choice("xy")] if i % 5 == 0 else []) for i in range(40)]
    two = [(f"c{i}", r.choice(["fact", "error", "decision"]), text(r.randrange(4)), text(r.randrange(1, 7)), [r.choice("xyz")] if i % 7 == 0 else None) for i in range(30)]
    memory.BLOCK_ROWS, memory.GROUP_BLOCKS, kept = 7, 2, (memory.BLOCK_ROWS, memory.GROUP_BLOCKS)
    out = memory.reconcile(spark.createDataFrame(two, kind), spark.createDataFrame(one, kind))
    plan = out._jdf.queryExecution().executedPlan().toString()
    got = {x.cand_id: (x.action, x.match) for x in out.collect()}
    memory.BLOCK_ROWS, memory.GROUP_BLOCKS = kept
    assert "Generate" not in plan and plan.count("Join") == 1
    like = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if set(a) | set(b) else 0.0
    for i, k, t, b, links in two:
        s, match, x, y, link = max(((like(t.split(), t2.split()) + like(b.split(), b2.split()) + (0.35 if set(links or []) & set(l2) else 0.0), j, like(t.split(), t2.split()), like(b.split(), b2.split()), bool(set(links or []) & set(l2))) for j, k2, t2, b2, l2 in one if k2 == k), default=(0, None, 0, 0, False))
        action = "add" if s == 0 else "skip" if y >= 0.55 or (x >= 0.7 and y >= 0.3) else "supersede" if x >= 0.35 or link else "add"
        assert got[i] == (action, match if action != "add" else None)


def test_citations_are_borne_out_as_pair_by_pair(spark):
    r = random.Random(9)
    paths = ["a.py", "x/a.py", "y/x/a.py", "b.py", "x/b.py", "./x/b.py"]
    names = ["run", "C.run", "Load", "load", "D.E.load", "ru", "", None]
    have = {(f"{r.choice(['f', 'func', 'm:x'])}:{r.choice(paths)}:{r.choice(['C.run', 'run', 'loader', 'z', 'x:run'])}" if r.random() < 0.8 else "bare", r.choice(names), r.choice(paths)) for _ in range(40)}
    records = spark.createDataFrame([*have, ("q:x/a.py:loading", "other", "x/a.py")], "id string, name string, file_path string")
    cited = [(p, s) for p in ("a.py", "x/a.py", "z/x/a.py", "b.py", "x/b.py", "c.py") for s in ("", "run", "C.run", "load", "lo", "E.load", "gone", "run.")]
    own = records.select("id", F.trim("name").alias("name"), normalize_path(F.col("file_path")).alias("_have")).distinct()
    rows = own.collect()
    key = lambda n: n.strip().split(".")[-1].lower()

    def bears(p, s, x):
        if not (p == x._have or p.endswith("/" + x._have) or x._have.endswith("/" + p)):
            return False
        by_name = x.name is not None and (x.name == s or x.name.endswith("." + s) or key(x.name) == key(s))
        return s == "" or by_name or x.id.endswith(":" + s) or f":{p}:{s}" in x.id

    got = {tuple(x) for x in verify.borne_out(spark.createDataFrame(cited, "path string, symbol string"), own).collect()}
    assert got == {(p, s) for p, s in cited if any(bears(p, s, x) for x in rows)} and 0 < len(got) < len(cited)


def test_vault_pages_are_ranked_by_their_whole_text(spark):
    pages = [("notes/a.md", "one", "src", ["en"], "filler " * 300 + "needle"), ("knowledge/wiki/b.md", "needle", "src", ["en"], "x"), ("notes/c.md", "two", "needle", ["en"], ""), ("notes/d.md", "three", "src", ["en"], None)]
    df = spark.createDataFrame(pages, "path string, title string, description string, tags array<string>, body string")
    queries = spark.createDataFrame([("q", "needle none"), ("r", "..."), ("s", "src two")], "query_id string, query string")
    got = {(r.query_id, r["rank"]): (r.path, r.score) for r in vault.rank_pages(df, queries, 2).collect()}
    assert got == {("q", 0): ("knowledge/wiki/b.md", 1.52), ("q", 1): ("notes/c.md", 0.755), ("s", 0): ("notes/c.md", 1.505), ("s", 1): ("knowledge/wiki/b.md", 0.77)}
    assert {(r.path, r.score) for r in vault.rank_pages(df, queries.where("query_id = 'q'"), 9).collect()} == {("knowledge/wiki/b.md", 1.52), ("notes/c.md", 0.755), ("notes/a.md", 0.255)}


def test_searches_score_rows_where_they_are(spark, tmp_path):
    """Scores over several small blocks, with stop words, ties and rounded halves, equal those of plain joins; a search's plan moves no postings."""
    r = random.Random(3)
    text = lambda n: " ".join(r.choice(["the", "the", "a", "fox", "Red", "x_y", *(f"w{i}" for i in range(30))]) for _ in range(n))
    chunks = spark.createDataFrame([*((i, text(r.randrange(25))) for i in range(120)), (500, None), (501, "the fox"), (502, "the fox")], "chunk_id long, content string").repartition(3)
    queries = spark.createDataFrame([*((i, text(r.randrange(1, 12))) for i in range(40)), (90, " ".join(f"w{i}" for i in range(32)))], "query_id long, query string")
    blocks.BLOCK_ROWS, blocks.GROUP_QUERIES, kept = 11, 13, (blocks.BLOCK_ROWS, blocks.GROUP_QUERIES)
    index.write_index(chunks, str(tmp_path / "i"))
    stored = index.open_index(spark, str(tmp_path / "i"))
    got = {tuple(x) for x in index.search(stored, queries, 6).select("query_id", "chunk_id", "score", "rank").collect()}
    over = {tuple(x) for x in lexical.overlap_channel(chunks, queries, k=6).select("query_id", "chunk_id", "score", "rank").collect()}
    blocks.BLOCK_ROWS, blocks.GROUP_QUERIES = kept
    assert got == {tuple(x) for x in lexical.bm25_search(chunks, queries, 6).select("query_id", "chunk_id", "score", "rank").collect()}
    words = lambda t: re.findall("[a-z0-9_]+", (t or "").lower())
    want, rows = set(), [(x.chunk_id, set(words(x.content))) for x in chunks.collect()]
    for q in queries.collect():
        own = set(words(q.query))
        scored = sorted((-math.floor(min(0.9, 0.25 + 0.65 * len(own & w) / len(own)) * 1e6 + 0.5) / 1e6, c) for c, w in rows if own & w)
        want |= {(q.query_id, c, -s, n) for n, (s, c) in enumerate(scored[:6])}
    assert over == want
    assert set(stored.chunks.columns) == {"chunk_id", "dl", "terms", "tfs"} and stored.chunks.count() == chunks.count()


def test_every_turn_is_a_memory(spark, tmp_path):
    rows = [(10, 0, "user", "alpha beta gamma. More"), (10, 1, "assistant", "delta words that answer"), (11, 0, "system", "delta alone"), (11, 2, "user", "delta delta delta")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(r.query_id, r.id) for r in catalogue.queries()["memory_search"](spark, str(tmp_path)).collect()}
    assert got == {("10/0", "10/0"), ("10/1", "10/1"), ("10/1", "11/0")}


def test_approximate_search_makes_no_rows_of_pairs(spark):
    """Narrow buckets leave many rows out; what is left is what shares a bucket, and the plan has no join."""
    r = np.random.default_rng(5)
    m = r.normal(size=(60, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "chunk_id long, embedding array<double>")
    out = vectors.approximate_search(df, df.where("chunk_id < 7").withColumnRenamed("chunk_id", "query_id"), 5, bucket=0.05, tables=2)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=0.05, numHashTables=2, seed=5).fit(df.select(array_to_vector("embedding").alias("v")))
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    h = [[x[0] for x in row.h] for row in model.transform(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(unit)], "i int, e array<double>").select("i", array_to_vector("e").alias("v"))).orderBy("i").collect()]
    want = set()
    for q in range(7):
        near = sorted((-round(float(unit[q] @ unit[i]), 6), i) for i in range(60) if any(a == b for a, b in zip(h[q], h[i], strict=True)))
        want |= {(q, i, -s, n) for n, (s, i) in enumerate(near[:5])}
    assert {(x.query_id, x.chunk_id, x.score, x["rank"]) for x in out.collect()} == want
    assert vectors.approximate_search(df.limit(0), df.withColumnRenamed("chunk_id", "query_id"), 5).count() == 0


def test_shortest_paths_back_from_many_goals(spark):
    r = random.Random(2)
    edges = list({(f"n{r.randrange(30)}", f"n{r.randrange(30)}") for _ in range(55)})
    pairs = [(f"n{a}", f"n{b}") for a in range(30) for b in (0, 1, 2, 40)]
    e = spark.createDataFrame([(a, b, "calls", 0) for a, b in edges + edges[:9]], "src string, dst string, relationship string, seq int")
    p = spark.createDataFrame(pairs + pairs[:5], "start string, goal string")
    want = {}
    for a, b in pairs:
        front, seen, hops = {a: a}, {a}, 0
        while front and b not in front:
            hops, new = hops + 1, {}
            for at, path in front.items():
                for x, y in edges:
                    if x == at and y not in seen:
                        new[y] = min(new.get(y, f"{path}>{y}"), f"{path}>{y}")
            front, seen = new, seen | set(new)
        if b in front:
            want[a, b] = (hops, front[b])
    for most in (graph.SMALL_ROWS, 0):
        graph.SMALL_ROWS, kept = most, graph.SMALL_ROWS
        got = [tuple(x) for x in graph.shortest_path(e, p).collect()]
        graph.SMALL_ROWS = kept
        assert len(got) == len(want) and {(a, b): (h, s) for a, b, h, s in got} == want
    assert {tuple(x)[:3] for x in graph.shortest_path(e, p, 2).collect()} == {(a, b, h) for (a, b), (h, _) in want.items() if h <= 2}


def test_full_text_scores_what_holds_all_words(spark):
    r = random.Random(6)
    pool = ["the", "runs", "running", "red", *(f"w{i}" for i in range(8))]
    docs = [(f"d{i}", " ".join(r.choice(pool) for _ in range(r.randrange(1, 12)))) for i in range(60)] + [("none", None)]
    asked = [(f"q{i}", " ".join(r.choice(pool) for _ in range(r.randrange(1, 4)))) for i in range(30)] + [("empty", ""), ("lost", "the unknown")]
    d, q = spark.createDataFrame(docs, "doc_id string, body string"), spark.createDataFrame(asked, "query_id string, query string")
    for stemmed in (False, True):
        words = lambda t: [stem(w) if stemmed else w for w in (t or "").split()]
        bags = {i: words(t) for i, t in docs}
        mean, n = sum(map(len, bags.values())) / len(bags), len(bags)
        want = set()
        for i, t in asked:
            own = set(words(t))
            idf = {w: max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6) for w in own for df in [sum(w in b for b in bags.values())]}
            scored = [(-round(sum(idf[w] * b.count(w) * 2.2 / (b.count(w) + 1.2 * (0.25 + 0.75 * len(b) / mean)) for w in own), 6), k) for k, b in bags.items() if own and own <= set(b)]
            want |= {(i, k, -s, at) for at, (s, k) in enumerate(sorted(scored)[:4])}
        blocks.BLOCK_ROWS, kept = 9, blocks.BLOCK_ROWS
        out = fulltext.search(d, q, 4, stemmed)
        blocks.BLOCK_ROWS = kept
        assert {(x.query_id, x.doc_id, x.score, x["rank"]) for x in out.collect()} == want
        assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_task_of_a_dense_search_leaves_k_rows_a_query(spark):
    r = np.random.default_rng(7)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r.integers(-2, 3, size=(50, 3)).astype(float))], "chunk_id long, embedding array<double>").coalesce(1)
    asked = df.where("chunk_id < 5").withColumnRenamed("chunk_id", "query_id")
    whole = {tuple(x) for x in vectors.dense_search(df, asked, 4).collect()}
    vectors.SLICE_ROWS, kept = 8, vectors.SLICE_ROWS
    assert {tuple(x) for x in vectors.dense_search(df, asked, 4).collect()} == whole and len(whole) == 20
    vectors.SLICE_ROWS = kept
