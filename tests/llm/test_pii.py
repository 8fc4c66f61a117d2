import hashlib
import random
import re

from pyspark.sql import functions as F

from marlstone.llm.common import documents
from marlstone.llm.pii import FEATURES, GENERATORS, boost, features_of, find_pii, fitted, found_spans, margin_of, redact, swept, training_spans

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for rank, (kind, p) in enumerate({"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def same(out, rows):
    assert len(out) == len(rows)
    want = {i: brute(t) for i, t in rows}
    texts = dict(rows)
    for r in out:
        base = want[r.doc_id]
        listed = ",".join(f"{k}:{s}:{e}" for s, _, k, e in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for _, _, k, _ in base) for x in ("email", "ip", "card", "phone")), (r.doc_id, listed)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        spans = [(int(s), int(e), k) for k, s, e in (x.split(":") for x in r.spans.split(",") if x)]
        assert set(spans) >= {(s, e, k) for s, _, k, e in base} and [x[0] for x in spans] == sorted(x[0] for x in spans)
        assert all(0 <= s < e <= len(texts[r.doc_id] or "") for s, e, _ in spans)


def test_all_documents(spark):
    d = documents(spark, "/root/testdata/sf0.01")
    same(find_pii(d).collect(), [(r.doc_id, r.text) for r in d.collect()])


def test_edges(docs, edge_rows):
    odd = [
        "a@b.c. x@y..z @b.c a@@b.c é@d.ee 😀 me+you@ex-am.ple.org,", "1.2.3.4 256.1.1.1 001.02.0003.255 1.2.3.4.5.6.7.8 9999999999999999999999.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 00000000000000 12345678901234567890",
        "+49 (30) 123-4567-89 +1 +12 3 +123456789012345678 ++4930123456", "1" * 9000 + " 4111111111111111", "+1" + "." * 5000 + "2", "x" * 40_000 + "@a.b", "😀" * 300 + " a@b.co",
    ]
    rows = [*edge_rows, *[(100 + i, t, "s") for i, t in enumerate(odd)]]
    same(find_pii(docs(rows)).collect(), [(i, t) for i, t, _ in rows])
    assert find_pii(docs([])).count() == 0


def test_random_texts(docs):
    r = random.Random(2)
    rows = [(i, "".join(r.choice("a1@.+- ()59") for _ in range(r.randint(0, 120))), "s") for i in range(1500)]
    same(find_pii(docs(rows)).collect(), [(i, t) for i, t, _ in rows])


def test_trees_learn_pairs_and_calibration_holds():
    cells = {(a, b): (1.0, 9.0) if a != b else (9.0, 1.0) for a in (False, True) for b in (False, True)}
    model = boost(cells)
    assert all((margin_of(model, x) > 0) == (x[0] != x[1]) for x in cells)
    assert boost({}) == (0.0, [])
    model, threshold = fitted()
    rows = [(margin_of(model, features_of(b, m)) >= threshold, y) for b, m, y in training_spans(3000, 99)]
    taken = [y for t, y in rows if t]
    assert sum(taken) / len(taken) >= 0.93 and sum(taken) / sum(y for _, y in rows) >= 0.8


def test_own_spans(docs):
    rows = [(1, 'api_key = "9f8e7d6c5b4a39281706f5e4d3c2b1a0" and ssn: 123-45-6789', "s"), (2, "an incomprehensibilities word and order 12345678", "s")]
    out = {r.doc_id: r.spans for r in find_pii(docs(rows)).collect()}
    assert "secret:11:43" in out[1] and "national:" in out[1] and out[2] == ""
    assert {r.doc_id: r.text for r in redact(docs(rows)).collect()}[1] == 'api_key = "[secret]" and ssn: [national]'


def test_python_and_spark_features_agree(spark):
    rows = training_spans(500, 5)
    df = spark.createDataFrame([(b[-32:], m) for b, m, _ in rows], "before string, m string")
    got = df.select([F.regexp(F.col(where), F.lit(p)) for where, p in FEATURES.values()]).collect()
    assert [tuple(r) for r in got] == [features_of(b, m) for b, m, _ in rows]


def test_mail_in_square_brackets_alone(docs):
    rows = [(1, "jane [at] example [dot] com", "s"), (2, "jane (at) example (dot) com", "s"), (3, "jane [at] example.com", "s"), (4, "jane at example dot com", "s")]
    out = {r.doc_id: r.spans for r in find_pii(docs(rows)).collect()}
    assert out == {1: "mail:0:27", 2: "mail:0:27", 3: "mail:0:21", 4: ""}


def test_recall_and_precision_on_documents(spark):
    """What is private in these documents beside the base kinds, as a reader marks it: quoted tokens, and long numbers that stand alone."""
    private = re.compile(r"(?<=token = \")[0-9a-f]{40}(?=\")|(?<![0-9A-Za-z.+-])[0-9]{14,19}(?![0-9A-Za-z]|[ .-][0-9])")
    caught = wanted = added = right = 0
    d = documents(spark, "/root/testdata/sf0.1")
    texts = {r.doc_id: r.text or "" for r in d.select("doc_id", "text").collect()}
    for r in find_pii(d).collect():
        text = texts[r.doc_id]
        gold = {m.span() for m in private.finditer(text)}
        found = {(int(s), int(e)): k for k, s, e in (x.split(":") for x in r.spans.split(",") if x)}
        own = {s for s, k in found.items() if k not in ("email", "ip", "card", "phone")}
        wanted, caught = wanted + len(gold), caught + len(gold & set(found))
        added, right = added + len(own), right + len(own & gold)
    assert wanted > 100 and caught >= 0.9 * wanted, (caught, wanted)
    assert right >= 0.9 * added, (right, added)


def test_context_does_not_depend_on_other_matches(spark):
    """The same span has the same 32 characters before it, whether or not they hold matches of its own kind."""
    text = "ab 12345678 cd 87654321 account 11112222 x 99998888"
    got = spark.createDataFrame([(text,)], "t string").select(F.inline(found_spans(F.col("t"), GENERATORS["account"], None, True))).collect()
    assert [(r.start, r.stop, r.m, r.before) for r in got] == [(m.start(), m.end(), m[0], text[max(0, m.start() - 32) : m.start()]) for m in re.finditer("[0-9]{8}", text)]


def test_chains_are_taken_greedily(spark):
    """A-B-C overlap in a chain with rising margins: C is taken, B falls, and A, which nothing taken covers, stays."""
    row = "named_struct('start', {}, 'rank', {}, 'stop', {}, 'kind', '{}', 'fixed', {}, 'margin', {})"
    rows = [(0, 5, 10, "a", "false", "1D"), (8, 6, 20, "b", "false", "2D"), (18, 7, 30, "c", "false", "3D"), (40, 0, 50, "x", "true", "0D"), (45, 1, 60, "y", "true", "0D"), (58, 5, 70, "d", "false", "9D")]
    got = spark.sql("SELECT array(" + ",".join(row.format(*r) for r in rows) + ") AS s").select(F.inline(swept(F.col("s")))).collect()
    assert [r.kind for r in got] == ["a", "c", "x", "y"]


def test_many_candidates_in_one_text(docs):
    """Sixteen thousand candidates in one text, each kept or dropped as it would be alone."""
    text = "x 12345678901234567 " * 16_000
    rows = [(1, text, "s"), (2, "x 12345678901234567 ", "s"), (None, "a@b.co", "s")]
    out = {r.doc_id: r for r in find_pii(docs(rows)).collect()}
    assert out[1].n_spans == 16_000 * out[2].n_spans and out[2].n_spans == 1 and out[None].n_email == 1
