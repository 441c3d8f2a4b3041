"""Scorer training and scoring (M2, M3, M6): probabilities in [0, 1], a repeat gives the same scores, one setting is
chosen, and the training log holds one row per strategy."""

import re

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tiergate import config as C
from tiergate.fixtures import stored_run
from tiergate.plans import epochs as EP
from tiergate.plans import scorer as SC


def test_scores_are_probabilities_and_repeatable(spark):
    rows = SC.training_rows(*stored_run(spark, SF_SMALL)[:2])
    model, report = SC.fit_best(rows, [(0.01, 10), (0.1, 10)])
    assert len(report) == 2 and all(r[2] > 0 for r in report)
    a = SC.score_rows(model, rows)
    stats = a.agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    assert 0.0 <= stats.lo <= stats.hi <= 1.0 and stats.n == rows.count()
    model2, _ = SC.fit_best(rows, [(0.01, 10), (0.1, 10)])
    b = SC.score_rows(model2, rows)
    key = ["model", "prompt_id"]
    diff = a.join(b.withColumnRenamed("score", "s2"), key).where(F.abs(F.col("score") - F.col("s2")) > 1e-9).count()
    assert diff == 0


def test_training_log_appends(spark, tmp_path):
    log = str(tmp_path / "strategies")
    rows = SC.training_rows(*stored_run(spark, SF_SMALL)[:2], chains=("flan",))
    grid = C.STRATEGY_GRID[:1] + C.STRATEGY_GRID[4:5] + C.STRATEGY_GRID[6:7]
    table, registry = EP.train_grid(rows, grid, "boolq", log)
    first = table.collect()
    assert {(r.strategy, r.layout, r.training_text, r.scorers) for r in first} == {
        ("strategy-1", "per-model", "stripped", 3), ("strategy-5", "per-model", "original", 3), ("single-scorer-strategy-2", "pooled", "stripped", 1),
    }
    assert len(registry) == 7 and len({r.n_train + r.n_val for r in first}) == 1 and all(r.val_loss > 0 for r in first)
    assert EP.train_grid(rows, grid[:1], "boolq", log)[0].count() == len(first) + 1


def plain_fit(rows, scorer, n_features):
    """Full-batch gradient descent of one scorer in plain numpy: losses of every epoch, and weights of the kept one."""
    x, y, held = np.zeros((len(rows), n_features + 1)), np.array([r["label"] for r in rows], float), np.array([r["split"] == "validation" for r in rows])
    for i, r in enumerate(rows):
        text = r["response"] if scorer.kind.startswith("original") else r["scorer_text"]
        words = re.sub("[^a-z0-9]+", " ", (text or "").lower()).split()
        for token in words + ([f"{a} {b}" for a, b in zip(words, words[1:])] if scorer.kind.endswith("pairs") else []):
            x[i, EP._bucket(token, n_features)] += 1
    norm = np.sqrt((x**2).sum(1, keepdims=True))
    x = np.divide(x, norm, out=x, where=norm > 0)
    x[:, -1] = 1
    w, history = np.zeros(n_features + 1), []
    for _ in range(scorer.epochs):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - scorer.step * x[~held].T @ (p - y)[~held] / (~held).sum()
        q = 1 / (1 + np.exp(-x @ w))
        loss = -(y * np.log(q) + (1 - y) * np.log(1 - q))
        history.append((loss[~held].mean(), loss[held].mean() if held.any() else None, w))
    kept = min(range(len(history)), key=lambda e: history[e][1]) if held.any() else len(history) - 1
    return history, kept, x


def test_epochs_are_a_plain_fit(spark):
    """Losses, kept epoch and scores of several scorers in one pass, against one fit after the other."""
    rows = SC.training_rows(*stored_run(spark, SF_SMALL)[:2], chains=("flan",))
    model = C.CHAINS["flan"][0].model
    scorers = [EP.Scorer("a", model, 0.5, 6), EP.Scorer("a", None, 3.0, 4), EP.Scorer("b", None, 2.0, 5, "original/pairs")]
    data = EP.examples(rows, ["stripped/words", "original/pairs"], 64)
    curve, registry = EP.train(data, scorers, 64)
    scores = {(r.strategy, r.model, r.prompt_id): r.score for r in EP.registry_scores(data, EP.registry_table(spark, registry)).collect()}
    plain = [r.asDict() for r in rows.collect()]
    assert len(scores) == 2 * len(plain)
    for scorer, entry in zip(scorers, registry):
        own = [r for r in plain if scorer.model in (None, r["model"])]
        history, kept, x = plain_fit(own, scorer, 64)
        got = [c for c in curve if (c[0], c[1]) == (scorer.strategy, scorer.model)]
        assert [c[2] for c in got] == list(range(1, scorer.epochs + 1)) and [c[2] for c in got if c[7]] == [kept + 1] == [entry[3]]
        assert np.allclose([c[5] for c in got], [h[0] for h in history]) and np.allclose([c[6] for c in got], [h[1] for h in history])
        for r, z in zip(own, x @ history[kept][2]):
            if scorer.strategy == "b" or scorer.model or r["model"] != model:  # a scorer of the model's own goes first
                assert abs(scores[scorer.strategy, r["model"], r["prompt_id"]] - 1 / (1 + np.exp(-z))) < 1e-9


def test_registry_falls_back_to_the_pooled_scorer(spark):
    rows = spark.createDataFrame([("m1", 1, 1, "good good", "x", 1.0, "train"), ("m2", 1, 1, "bad", "x", 0.0, "train"), ("m2", 1, 2, None, None, None, "train")], "model string, tier int, prompt_id long, scorer_text string, response string, label double, split string")
    data = EP.examples(rows, ["stripped/words"], 8)
    weights = lambda b: [b, [0.0] * 8]
    registry = EP.registry_table(spark, [("s", "m1", "stripped/words", 1, *weights(2.0)), ("s", None, "stripped/words", 1, *weights(-2.0)), ("t", "m1", "stripped/words", 1, *weights(0.0)), ("u", None, "original/words", 1, *weights(0.0))])
    got = {(r.strategy, r.model, r.prompt_id): round(r.score, 6) for r in EP.registry_scores(data, registry).collect()}
    assert got == {("s", "m1", 1): 0.880797, ("s", "m2", 1): 0.119203, ("s", "m2", 2): 0.119203, ("t", "m1", 1): 0.5}  # no example of u's features
    assert {r.strategy for r in EP.registry_scores(data, registry, ["t"]).collect()} == {"t"}
    curve, fitted = EP.train(data, [EP.Scorer("v", "nobody", 1.0, 2), EP.Scorer("w", None, 1.0, 3)], 8)
    assert fitted[0][4] == 0.0 and [c[3:5] for c in curve] == [(0, 0)] * 2 + [(2, 0)] * 3 and [c[2] for c in curve if c[7]] == [2, 3]


def test_patience_stops_early(spark):
    rows = SC.training_rows(*stored_run(spark, SF_SMALL)[:2], chains=("flan",))
    data = EP.examples(rows, ["stripped/words"], 64)
    scorers = [EP.Scorer("wild", None, 60.0, 40)]
    full, _ = EP.train(data, scorers, 64)
    short, _ = EP.train(data, scorers, 64, patience=3)
    assert len(short) < len(full) == 40
    assert [c[5:7] for c in short] == [c[5:7] for c in full[: len(short)]] or np.allclose([c[6] for c in short], [c[6] for c in full[: len(short)]])


def test_split_rates(spark):
    for dataset, pct in (("boolq", 20), ("mnli", 60)):
        rows = SC.training_rows(*stored_run(spark, SF_SMALL, dataset)[:2], dataset=dataset)
        share = rows.agg(F.avg((F.col("split") == "validation").cast("double"))).first()[0]
        assert abs(share - pct / 100) < 0.15


def test_prompts_shared_by_answers_learn_as_single_rows(spark, monkeypatch):
    """the words of a prompt are counted once for all its answers; same losses and scores as an example per answer."""
    texts = [None, "", "Is it so?\nAnswer: ", "ends in a word", "K\u212a", "a b a - ", "the the the "]
    prompts = spark.createDataFrame([(i if i < 12 else None, i % 2, texts[i % 7]) for i in [*range(14), 3]], "prompt_id long, gold_class int, prompt_text string")
    said = ["true", "false a", None, "", "x9 word"]
    rows = []
    for i in [*range(13), 2]:
        for j, t in enumerate((*C.CHAINS["flan"], *C.CHAINS["phi"])):
            text = said[(i + j) % 5]
            rows.append((i if i < 12 else None, t.tier, t.model, text if text is None or "flan" in t.model else (texts[i % 7] or "") + text))
    answers = spark.createDataFrame([*rows, (1, 1, "another", "true")], "prompt_id long, tier int, model string, response string")
    kinds = ["original/words", "stripped/pairs", "stripped/words"]
    scorers = [EP.Scorer(k, m, 2.0, 3, k) for k in kinds for m in (None, "flan-t5-xl")]
    monkeypatch.setattr(EP, "CHUNK_ROWS", 5)
    for dataset in ("boolq", "mnli"):
        flat = EP.examples(SC.training_rows(prompts, answers, dataset, validation_pct=40), kinds, 32)
        shared = EP.shared_examples(SC.training_prompts(prompts, answers, dataset, validation_pct=40), kinds, 32)
        assert shared.count() < flat.count() / 5
        (curve, registry), (curve2, _) = EP.train(flat, scorers, 32), EP.train(shared, scorers, 32)
        for c, d in zip(curve, curve2, strict=True):
            assert c[:5] == d[:5] and np.allclose(c[5:7], d[5:7], rtol=0, atol=1e-12)
        table = EP.registry_table(spark, registry)
        key = lambda r: (r.strategy, r.model, r.prompt_id, r.tier, round(r.score, 9))
        one, other = (sorted(map(key, EP.registry_scores(x, table).collect())) for x in (flat, shared))
        assert one == other and len(one) == flat.count()


def test_passes_read_bounded_slices(spark, monkeypatch):
    """what a pass holds follows CHUNK_ROWS, not the size of Arrow's batches."""
    import pyarrow as pa

    one = pa.array([1, 2], pa.int32()).to_numpy().tobytes()
    answer = {"model": "m", "tier": 1, "label": 1.0, "known": True, "idx": b"", "n": b""}
    batch = pa.RecordBatch.from_pylist([{"prompt_id": i, "split": "train", "kind": "k", "idx": one, "n": one, "answers": [answer] * (i % 3)} for i in range(50)])
    monkeypatch.setattr(EP, "CHUNK_ROWS", 7)
    parts = list(EP._parts(iter([batch]), 8))
    assert max(len(p.batch) for p in parts) == 7 and sum(len(p.row) for p in parts) == sum(i % 3 for i in range(50))
    assert max(len(rows) for p in parts for _, rows, _ in EP._scored(p, lambda kind, model: (0,), np.zeros((8, 1)), np.zeros(1))) <= 7


def test_passes_read_bounded_bytes(spark, monkeypatch):
    """what a pass holds follows PART_BYTES, not the number of features or answers of 1,000 prompts; gradients stay the same."""
    import pyarrow as pa

    rng = np.random.default_rng(3)

    def some(n):
        return np.sort(rng.choice(64, n, replace=False)).astype("<i4").tobytes(), rng.integers(1, 4, n).astype("<i4").tobytes()

    rows = []
    for i in range(60):
        answers = []
        for j in range((0, 1, 3, 40)[i % 4]):
            idx, n = some(j % 9)
            answers.append({"model": "m", "tier": 1, "label": float(j % 2), "known": True, "idx": idx if j % 5 else None, "n": n if j % 5 else None})
        idx, n = some(i % 30)
        rows.append({"prompt_id": i, "split": "train", "kind": "k", "idx": idx, "n": n, "answers": answers if i % 7 else None})
    kind = pa.struct([("model", pa.string()), ("tier", pa.int32()), ("label", pa.float64()), ("known", pa.bool_()), ("idx", pa.binary()), ("n", pa.binary())])
    batch = pa.RecordBatch.from_pylist(rows, schema=pa.schema([("prompt_id", pa.int64()), ("split", pa.string()), ("kind", pa.string()), ("idx", pa.binary()), ("n", pa.binary()), ("answers", pa.list_(kind))]))
    weights = rng.normal(size=(64, 1))

    def held(part):
        return sum(4 * (len(x.feature) + len(x.count)) for x in (part.shared, part.own)) + EP.ANSWER_BYTES * len(part.row)

    def gradient(parts):
        total, p = np.zeros(64), []
        for part in parts:
            for columns, at, found in EP._scored(part, lambda kind, model: (0,), weights, np.zeros(1), lambda columns, at, p: p - 0.5):
                if columns is None:
                    total[at[0]] += found[:, 0]
                else:
                    p += found[:, 0].tolist()
        return total, p

    whole = gradient(EP._parts(iter([batch]), 64))
    monkeypatch.setattr(EP, "PART_BYTES", 2_000)
    for source, first in ((batch, 0), (batch.slice(5), 5)):
        parts = list(EP._parts(iter([source]), 64))
        assert [i for p in parts for i in p.batch.column(0).to_pylist()] == list(range(first, 60))
        assert all(held(p) <= 2_000 or len(p.batch) == 1 for p in parts) and len(parts) > 10
    got = gradient(EP._parts(iter([batch]), 64))
    assert np.allclose(got[0], whole[0], rtol=0, atol=1e-12) and np.allclose(got[1], whole[1], rtol=0, atol=1e-12) and len(got[1]) > 300


def test_text_labels_over_the_broadcast_limit(spark, monkeypatch):
    """Training labels of a text task come from one pass over the pairs, with a table of vectors of any size."""
    from tiergate.operators import embed_match as E
    from tiergate.plans import text_eval as TE

    vectors = spark.createDataFrame([(i, [float(i % 7 - 3), 1.0, float(i % 4)]) for i in range(90)], "vec_id long, embedding array<float>")
    pairs = spark.createDataFrame([(i, "m", f"a{i} b c{i % 3}", f"c{i % 2} b a{i}") for i in range(30)] + [(30, "m", "a1", ""), (31, "m", None, "b")], "pair_id long, model string, pred string, ref string")
    want = sorted(map(tuple, TE.scorer_labels_text(pairs, vectors).collect()))
    monkeypatch.setattr(E, "BROADCAST_LIMIT_BYTES", 0)
    labels = TE.scorer_labels_text(pairs, vectors)
    assert "Exchange" not in labels._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, labels.collect())) == want
