"""Small fixtures with results worked out by hand or by plain Python."""

import math

import pytest

from marlstone.functions.porter import stem
from marlstone.functions.redact import redact_text
from marlstone.operators.fusion import blend_rerank, gate_rerank, per_file_cap, rrf
from marlstone.operators.graph import bfs, last_wins, shortest_path
from marlstone.operators.lexical import bm25_search
from marlstone.operators.metrics import citation_rate, ndcg_at_k, recall_at_k
from marlstone.operators.packing import dedupe_rows
from marlstone.operators.vectors import dense_search
from marlstone.sources.repository import chunk_entities, discover_files, line_windows, parse_repository


def test_bm25_against_plain_python(spark):
    texts = {"a": "red fox red", "b": "blue fox", "c": "green cow and red hen", "d": "blue sky", "e": "one more text", "f": ""}
    words = {k: t.split() for k, t in texts.items()}
    n, mean = len(texts), sum(map(len, words.values())) / len(texts)
    idf = {w: math.log(n - df + 0.5) - math.log(df + 0.5) for w in {x for v in words.values() for x in v} for df in [sum(w in v for v in words.values())]}
    floor = 0.25 * sum(idf.values()) / len(idf)
    want = {}
    for k, v in words.items():
        s = sum((floor if idf[t] < 0 else idf[t]) * v.count(t) * 2.5 / (v.count(t) + 1.5 * (0.25 + 0.75 * len(v) / mean)) for t in ("red", "fox") if t in v)
        if s > 0:
            want[k] = s
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id string, content string")
    hits = {r.chunk_id: r.score for r in bm25_search(chunks, spark.createDataFrame([("q", "red fox")], "query_id string, query string")).collect()}
    assert hits == {k: pytest.approx(1 / (1 + math.exp(-raw / 5)), abs=1e-6) for k, raw in want.items()}


def test_rrf(spark):
    hits = spark.createDataFrame([("q", "dense", "a", 0), ("q", "dense", "b", 1), ("q", "sparse", "b", 0), ("q", "wiki", "c", 0)], "query_id string, source string, chunk_id string, rank int")
    got = {r.chunk_id: (r.score, r.sources) for r in rrf(hits).collect()}
    assert got == {"a": (pytest.approx(0.3 / 61), "dense"), "b": (pytest.approx(0.3 / 62 + 0.25 / 61), "dense,sparse")}


def test_per_file_cap(spark):
    rows = [("q", f"{p}{i}", p, r) for r, (p, i) in enumerate([("a", 1), ("a", 2), ("b", 1), ("a", 3), ("a", 4), ("b", 2)])]
    out = per_file_cap(spark.createDataFrame(rows, "query_id string, chunk_id string, file_path string, rank int")).orderBy("rank").collect()
    assert [r.chunk_id for r in out] == ["a1", "a2", "b1", "a3", "b2"]


def test_reranks(spark):
    def order(df):
        return [r.chunk_id for r in df.orderBy(df.reranked.desc(), "chunk_id").collect()]

    rows = spark.createDataFrame([("q", "low", 0.9, 0.1), ("q", "high", 0.5, 0.9), ("q", "mid", 0.1, 0.2)], "query_id string, chunk_id string, score double, model_score double")
    assert order(blend_rerank(rows, alpha=1.0)) == ["high", "mid", "low"] and order(blend_rerank(rows, alpha=0.0)) == ["low", "high", "mid"]
    near = spark.createDataFrame([("q", "a", 0.9, 4.9), ("q", "b", 0.8, 5.0), ("q", "c", 0.1, 1.0)], rows.schema)
    assert order(gate_rerank(near, 1.0)) == ["a", "b", "c"]
    far = spark.createDataFrame([("q", "a", 0.9, 1.0), ("q", "b", 0.8, 5.0), ("q", "c", 0.1, 0.0)], rows.schema)
    assert order(gate_rerank(far, 1.0)) == ["b", "a", "c"]


def test_metrics(spark):
    hits = spark.createDataFrame([("q", "a", 0), ("q", "x", 1), ("q", "a", 2), ("q", "b", 3)], "query_id string, item string, rank int")
    gold = spark.createDataFrame([("q", "a"), ("q", "b")], "query_id string, item string")
    assert recall_at_k(hits, gold, 3).first().recall == 0.5
    assert recall_at_k(hits, gold, 4).first().recall == 1.0
    one = spark.createDataFrame([("q", "x")], gold.schema)
    assert ndcg_at_k(hits, one, 3).first().ndcg == pytest.approx(1 / math.log2(3))
    need = spark.createDataFrame([("q", "src/a.py"), ("q", "src/b.py")], "query_id string, path string")
    have = spark.createDataFrame([("q", "./src\\a.py")], need.schema)
    assert citation_rate(need, have).first().citation_rate == 0.5


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b", "calls", 0), ("a", "b", "imports", 1), ("b", "c", "calls", 2), ("c", "d", "calls", 3), ("x", "y", "calls", 4)], "src string, dst string, relationship string, seq long")
    once = last_wins(edges)
    assert once.count() == 4 and once.where("src = 'a'").first().relationship == "imports"
    seeds = spark.createDataFrame([("a",)], "entity_id string")
    assert {(r.node, r.hops) for r in bfs(once, seeds, 2).collect()} == {("b", 1), ("c", 2)}
    pairs = spark.createDataFrame([("a", "d"), ("a", "x")], "start string, goal string")
    assert [tuple(r) for r in shortest_path(once, pairs, depth=4).collect()] == [("a", "d", 3, "a>b>c>d")]


def test_dense(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 0.0])], "chunk_id long, embedding array<float>")
    out = dense_search(vectors, spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, embedding array<float>"), k=2).collect()
    assert [(r.chunk_id, round(r.score, 5)) for r in sorted(out, key=lambda r: -r.score)] == [(1, 1.0), (2, 0.6)]


def test_redaction():
    token = "ghp_" + "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5P6q7R8"
    text, spans = redact_text(f"use {token} now")
    assert token not in text and text.startswith("use [REDACTED:") and len(spans) == 1
    assert redact_text("def token(x): return x + 1") == ("def token(x): return x + 1", [])
    assert redact_text(None)[0] is None and redact_text("")[0] == ""


def test_stems():
    assert [stem(w) for w in ("caresses", "ponies", "relational", "hopping", "agreed", "sky")] == ["caress", "poni", "relat", "hop", "agre", "sky"]


def test_range_dedupe_keeps_the_first_of_nested_ranges():
    rows = [{"chunk_id": c, "file_path": "f", "entity_id": "e", "start_line": a, "end_line": b, "content": "x", "score": 1.0, "rank": i} for i, (c, a, b) in enumerate([("m", 1, 10), ("n", 1, 10), ("o", 50, 60)])]
    assert [r["chunk_id"] for r in dedupe_rows(rows)] == ["m", "o"]


def test_repository(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "pkg" / "mod.py").write_text('class A:\n    """Doc."""\n    def f(self, x):\n        return x\n\ndef g():\n    return A()\n')
    (tmp_path / "pkg" / "bad.py").write_text("def broken(:\n")
    (tmp_path / "notes.md").write_text("# Title\n\ntext\n")
    (tmp_path / ".git" / "x.py").write_text("def hidden(): pass\n")
    files = discover_files(spark, str(tmp_path), "demo")
    assert sorted(r.path for r in files.collect()) == ["notes.md", "pkg/bad.py", "pkg/mod.py"]
    entities = parse_repository(files)
    ids = {r.entity_id for r in entities.collect()}
    assert {"class:pkg/mod.py:A", "method:pkg/mod.py:A.f", "func:pkg/mod.py:g"} <= ids and not any("hidden" in i for i in ids)
    assert chunk_entities(entities, "demo").count() > 0
    assert parse_repository(files.limit(0)).count() == 0


def test_line_windows_cover_all_lines():
    lines = ["x" * 100] * 100
    spans = line_windows(lines)
    assert spans[0][0] == 0 and max(b for _, b in spans) == len(lines) and all(a < b for a, b in spans)
