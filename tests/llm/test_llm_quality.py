"""Quality classifier: model parts, held-out accuracy, awkward rows."""

import zlib

import numpy as np
from cases import awkward, empty, labels
from conftest import SF_MID

from tiergate.llm import quality_classifier as Q


def test_shallow_tree_finds_steps():
    g = np.array([-5.0, -5, 5, 5, 5, 1, 1, 1])
    out = Q._shallow_tree(g, np.full(8, 2.0), 0.0, 1.0)
    assert np.allclose(out, g / 2)


def test_model_learns_main_effects_and_an_interaction():
    r = np.random.default_rng(0)
    x = r.normal(size=(6000, 4))
    y = ((x[:, 0] > 0.5) ^ ((x[:, 1] > 0) & (x[:, 2] > 0))).astype(float)
    model = Q.fit_gam(x[:4000], y[:4000])
    plain = Q.fit_gam(x[:4000], y[:4000], n_pairs=0)
    right = lambda m: ((m.score(x[4000:]) >= 0.5) == y[4000:]).mean()
    assert {(1, 2)} <= {(a, b) for a, b, _ in model.pairs}
    assert right(model) > 0.9 and right(model) > right(plain) + 0.02


def test_scores_are_sums_of_table_entries():
    r = np.random.default_rng(1)
    x = r.normal(size=(500, 3))
    m = Q.fit_gam(x, (x[:, 0] > 0).astype(float), rounds=10, pair_rounds=5)
    for row in x[:20]:
        z = m.intercept + sum(t[int((m.cuts[f] <= row[f]).sum())] for f, t in enumerate(m.tables))
        z += sum(t[int((m.coarse[a] <= row[a]).sum()), int((m.coarse[b] <= row[b]).sum())] for a, b, t in m.pairs)
        assert np.isclose(m.score(row[None])[0], 1 / (1 + np.exp(-z)))


def test_no_or_one_sided_labels():
    assert Q.fit_gam(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert (Q.fit_gam(np.ones((5, 3)), np.ones(5)).score(np.zeros((2, 3))) > 0.9).all()


def test_held_out_accuracy(spark):
    docs, marks = (spark.read.parquet(f"{SF_MID}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in Q.classify(docs, marks).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    held = [(got[r.doc_id].predicted, r.quality) for r in marks.collect() if got[r.doc_id].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    # the same model whatever the partitions, and the held-out labels play no part
    again = Q.classify(docs.repartition(7), marks.filter(~Q.held_out(marks["doc_id"])).repartition(5))
    assert all(abs(r.score - got[r.doc_id].score) < 1e-12 for r in again.collect())


def test_one_training_row_for_each_id(spark):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, f"text {i}") for i in range(40)] + [(ids[0], f"zeta {n}") for n in range(500)] + [(ids[1], None), (ids[2], "a first")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    marks = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    got = {r.doc_id: (r.text, r.y) for r in Q.training_rows(docs, marks).collect()}
    assert got == {i: ("a first" if i == ids[2] else f"text {i}", i % 2) for i in ids}
    assert Q.training_rows(docs, marks).count() == len(ids) and Q.training_rows(docs, marks, max_train_rows=len(ids) // 2).count() == len(ids) // 2


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = Q.classify(docs, labels(spark))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
    blank = {r.score for r in got.collect() if r.doc_id in (4, 5)}
    assert len(blank) == 1
    none = Q.classify(docs, labels(spark).limit(0)).collect()
    assert {r.score for r in none} == {0.5} and {r.predicted for r in none} == {1}
    assert Q.classify(empty(spark), labels(spark)).count() == 0
    kept = Q.keep_good(docs, labels(spark).limit(0))
    assert kept.columns == docs.columns and kept.count() == docs.count()
