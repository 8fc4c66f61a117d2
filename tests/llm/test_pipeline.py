import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from marlstone.llm.common import documents, materialize
from marlstone.llm.simhash import NEAR_RADIUS, fingerprint_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before the first and after every stage."""
    kept = [documents(spark, SF)]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(materialize(stage(spark, kept[-1], SF), name))
    return [x.collect() for x in kept]


def test_stage_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    assert all(s[0].__fields__ == stages[0][0].__fields__ for s in stages[:-1])


def test_toxicity_rejects_few(spark, stages):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = {r.doc_id for r in stages[0]} - {r.doc_id for r in stages[1]}
    known = [i for i in gone if i in truth]
    assert sum(1 for i in known if not truth[i]) <= 0.02 * len(truth) and len(gone) < 0.3 * len(stages[0])


def test_exact_dedup_against_brute_force(stages):
    groups = defaultdict(list)
    for r in stages[1]:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")].append((-len(r.text or ""), r.doc_id))
    assert {r.doc_id for r in stages[2]} == {min(g)[1] for g in groups.values()}


def near_components(texts, least=0.8, apart=64):
    """Components of the pairs whose five-word shingles have a Jaccard similarity of ``least``, by comparing all pairs; of those alone, if asked,
    whose fingerprints are at most ``apart`` bits apart."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    prints = {i: fingerprint_of(t, 5) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        for j in texts:
            near = j < i and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-9
            if near and ((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() <= apart:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in texts}


def test_near_dedup_against_brute_force(stages):
    """Only near copies go, and all go whose fingerprints are within the stage's radius (two pairs of these documents are 11 and 17 bits apart)."""
    texts = {r.doc_id: r.text for r in stages[2]}
    kept = {r.doc_id for r in stages[3]}
    assert kept >= set(near_components(texts).values())
    assert kept == set(near_components(texts, apart=NEAR_RADIUS).values())


def test_run_packs_what_the_stages_keep(spark, stages):
    """``run`` returns the pieces of the stages' result, each id of each kept document once a copy."""
    piece = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
    whole = lambda rows: Counter((r.doc_id, r.doc_tokens) for r in rows if r.start == 0)
    out = corpus_pipeline.run(spark, SF).collect()
    assert whole(out) == whole(stages[5]) == Counter({(i, n): k for (i, n), k in whole(stages[5]).items()})
    assert sum(r.length for r in out) == sum(r.length for r in stages[5]) and all(piece(r)[2] > 0 for r in out)
    assert whole(out).total() == len(stages[4])


def test_mixing_meets_targets(stages):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    times = Counter(r.doc_id for r in stages[4])
    assert max(times.values()) <= 2 and set(times) <= {r.doc_id for r in stages[3]}
    whole, taken = (sum(words(r.text) for r in s) for s in (stages[3], stages[4]))
    assert abs(taken - 1.5 * whole) <= 0.1 * whole


def test_packing_has_every_piece(stages):
    times = Counter(r.doc_id for r in stages[4])
    got = defaultdict(int)
    size = {}
    for r in stages[5]:
        got[r.doc_id] += r.length
        size[r.doc_id] = r.doc_tokens
    assert {i: got[i] // size[i] for i in got} == dict(times)


def test_edges(spark, docs, edge_rows, tmp_path):
    """Nulls, repeated rows, clashing columns and empty tables pass all stages; repeated ids are told apart by row."""
    truth = "doc_id long, quality int, toxic int"
    spark.createDataFrame([], truth).write.parquet(f"{tmp_path}/labels.parquet")
    for rows in ([*edge_rows, (None, "lone text", "c")], []):
        now = docs(rows)
        for name, stage in corpus_pipeline.STAGES:
            now = materialize(stage(spark, now, str(tmp_path)), name)
        assert bool(now.count()) == bool(rows)


def test_no_labels_reject_nothing(spark, docs, tmp_path):
    """Labels of no class or of one teach no term, so the toxicity stage keeps every row."""
    now = docs([(i, f"text number {i}", "a") for i in range(9)] + [(None, None, None)])
    for name, rows in (("none", []), ("one", [(i, 1, 1) for i in range(9)])):
        spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        assert corpus_pipeline.toxicity_stage(spark, now, f"{tmp_path}/{name}").count() == 10
