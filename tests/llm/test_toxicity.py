import random

import numpy as np

from marlstone.llm.common import documents, labels
from marlstone.llm.toxicity import FactorizationMachine, fit, term_ids, toxicity

SF = "/root/testdata/sf0.1"  # smaller tables hold six held-out toxic rows


def exclusive(n, seed):
    r, rows, y = random.Random(seed), [], []
    for _ in range(n):
        a, b = r.random() < 0.5, r.random() < 0.5
        rows.append(term_ids(" ".join([*(["alpha"] * a), *(["beta"] * b), *(f"w{r.randrange(400)}" for _ in range(25))])))
        y.append(float(a != b))
    return rows, np.array(y)


def accuracy(model, rows, y):
    return np.mean([(model.score(x) >= 0.5) == bool(t) for x, t in zip(rows, y, strict=True)])


def test_factors_learn_a_pair_that_no_sum_of_weights_can():
    """Label 1 if one of two terms stands, but not both: out of reach of additive weights, and no term alone tells anything."""
    rows, y = exclusive(2500, 3)
    other = exclusive(500, 4)
    assert accuracy(fit(rows, y), *other) >= 0.95
    assert accuracy(fit(rows, y, factors=0), *other) < 0.65


def test_margin_is_the_sum_over_terms_and_pairs():
    r = np.random.default_rng(1)
    m = FactorizationMachine(0.3, r.normal(size=64), r.normal(size=(64, 4)))
    for n in (0, 1, 2, 9):
        ids = r.choice(64, n, replace=False)
        pairs = sum(float(m.v[i] @ m.v[j]) for k, i in enumerate(ids) for j in ids[k + 1 :])
        assert abs(m.margin(ids) - (0.3 + m.w[ids].sum() + pairs)) < 1e-9


def test_held_out_accuracy(spark):
    out = toxicity(documents(spark, SF), labels(spark, SF)).join(labels(spark, SF), "doc_id").where("held_out and toxic is not null").collect()
    hits = sum(r.predicted == r.toxic for r in out) / len(out)
    caught = [r.predicted for r in out if r.toxic]
    assert len(out) > 500 and hits >= 0.97, hits
    assert np.mean(caught) >= 0.85


def test_edges(spark, docs, edge_rows):
    truth = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 9)] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    out = toxicity(docs([*edge_rows, (None, "x", None)]), truth).collect()
    assert len(out) == len(edge_rows) + 1 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    same = {r.doc_id: r.score for r in out}
    assert same[3] == same[4] == same[5]
    for none in (truth.limit(0), truth.where("toxic = 0")):
        assert len({r.score for r in toxicity(docs(edge_rows), none).collect()}) == 1
    assert toxicity(docs([]), truth).count() == 0
