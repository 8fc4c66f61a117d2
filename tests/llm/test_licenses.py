import random
import re
import textwrap

from marlstone.llm.common import documents
from marlstone.llm.licenses import PHRASES, TEMPLATES, THRESHOLD, TemplateJoin, blocks, license_scan, token_frequency, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(text):
    w = WORD.findall(lower(text))
    places = sorted((i, label) for p, label in PHRASES.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p)
    base = {label for _, label in places}
    own = set(base)
    for block in blocks(text or ""):
        held = set(WORD.findall(lower(block)))
        for label, t in TEMPLATES:
            tokens = set(WORD.findall(lower(t)))
            if len(tokens & held) >= THRESHOLD * len(tokens) - 1e-9:
                own.add(label)
    return len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(base)), ",".join(sorted(own))


def same(out, rows):
    assert len(out) == len(rows)
    want = {i: brute(t) for i, t in rows}
    for r in out:
        assert tuple(r)[1:7] == want[r.doc_id]
        assert 0 <= r.score <= 1 and (r.score >= THRESHOLD) == bool(r.labels)


def test_all_documents(spark):
    d = documents(spark, "/root/testdata/sf0.01")
    same(license_scan(d).collect(), [(r.doc_id, r.text) for r in d.collect()])


def test_edges(docs, edge_rows):
    odd = [(20, "The MIT\nLicense. MIT-LICENSE, apache license; general public\tlicense mit license", "a"), (21, "licensed under\nCC BY-NC 4.0\n\n\nnothing", "a"), (22, "MIT LİCENSE mit 9license", "b")]
    rows = [*edge_rows, *odd]
    same(license_scan(docs(rows)).collect(), [(i, t) for i, t, _ in rows])
    assert license_scan(docs([])).count() == 0


def test_filters_lose_no_match():
    r = random.Random(8)
    vocabulary = [f"t{i}" for i in range(60)]
    templates = [(str(k), " ".join(r.sample(vocabulary, r.randint(1, 20)))) for k in range(25)]
    frequency = {w.encode(): r.randint(0, 50) for w in vocabulary}
    for threshold in (0.3, 0.6, 0.8, 1.0):
        join = TemplateJoin(templates, frequency, threshold)
        for _ in range(300):
            block = set(words(" ".join(r.sample(vocabulary, r.randint(0, 40)))))
            want = {k for k, (_, t) in enumerate(templates) if len(set(words(t)) & block) >= threshold * len(set(words(t))) - 1e-9}
            assert set(join.matches(block)) == want


def test_templates_are_found_without_any_phrase(docs):
    rows = [(1, "Licensed under CC BY-NC 4.0", "s"), (2, "nothing here", "s"), (None, "Licensed under CC BY-NC 4.0", "s")]
    out = {(r.doc_id, r.labels, r.base_labels) for r in license_scan(docs(rows), phrases={}).collect()}
    assert out == {(1, "cc-by-nc", ""), (2, "", ""), (None, "cc-by-nc", "")}


def test_wrapped_license_texts(docs):
    """Every template, wrapped at 60 characters as a paragraph, in the middle of a text."""
    rows = [(i, "Some words before.\n\n" + textwrap.fill(t, 60) + "\n\nand after", "s") for i, (_, t) in enumerate(TEMPLATES)]
    out = {r.doc_id: r.labels.split(",") for r in license_scan(docs(rows)).collect()}
    assert all(label in out[i] for i, (label, _) in enumerate(TEMPLATES))


def test_frequency_counts_blocks(docs):
    rows = [(1, "license mit\nlicense\n\nlicense", "s"), (2, None, "s")]
    assert token_frequency(docs(rows), [("x", "license mit")]) == {b"license": 4, b"mit": 2}
