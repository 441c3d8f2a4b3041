"""Neural scorer plug-in: scores of a plain loop, one model per worker process, batches bounded by bytes."""

import os
import uuid

import numpy as np
from conftest import SF_SMALL
from pyspark.sql import functions as F

from tiergate import config as C
from tiergate.fixtures import stored_run
from tiergate.plans import cascade
from tiergate.plans import predictor as PR


def network(texts):
    """Two layers over counts of characters."""
    w = np.random.default_rng(0)
    a, b = w.standard_normal((16, 8)), w.standard_normal(8)
    x = np.array([[sum(ord(c) % 16 == k for c in t) for k in range(16)] for t in texts], float).reshape(-1, 16)
    return 1 / (1 + np.exp(-np.tanh(x / (1 + x.sum(1, keepdims=True)) @ a) @ b))


def test_byte_bounded_batches():
    texts = np.array(["a" * 5, "é" * 3, "", "b" * 50, "c", "d"], object)
    got = [texts[s].tolist() for s in PR.byte_bounded(texts, 11)]
    assert got == [["a" * 5, "é" * 3, ""], ["b" * 50], ["c", "d"]]
    assert list(PR.byte_bounded(texts[:0], 5)) == []


def test_scores_equal_a_plain_loop(spark, tmp_path):
    log, sizes = str(tmp_path / "built"), str(tmp_path / "sizes")
    os.makedirs(log), os.makedirs(sizes)

    def make():
        open(f"{log}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def model(texts):
            open(f"{sizes}/{sum(len(t.encode()) for t in texts)}-{len(texts)}-{uuid.uuid4().hex}", "w").close()
            w = np.random.default_rng(0)
            a, b = w.standard_normal((16, 8)), w.standard_normal(8)
            x = np.array([[sum(ord(c) % 16 == k for c in t) for k in range(16)] for t in texts], float).reshape(-1, 16)
            return 1 / (1 + np.exp(-np.tanh(x / (1 + x.sum(1, keepdims=True)) @ a) @ b))

        return model

    prompts, answers, _ = stored_run(spark, SF_SMALL)
    labelled = cascade.labelled_answers(prompts, answers, "boolq", cascade.chain_models("flan"))
    scores = PR.predictor_scores(make, labelled, "strategy-1", batch_rows=32, max_bytes=4000).collect()
    plain = {(r.prompt_id, r.tier): network([r.prompt_text + r.answer])[0] for r in labelled.collect()}
    assert len(scores) == len(plain) and all(abs(r.score - plain[r.prompt_id, r.tier]) < 1e-12 for r in scores)
    pids = [name.split("-")[0] for name in os.listdir(log)]
    assert len(pids) == len(set(pids))  # built once in each worker process
    seen = [tuple(map(int, name.split("-")[:2])) for name in os.listdir(sizes)]
    assert all(n <= 32 and (size <= 4000 or n == 1) for size, n in seen)


def test_null_texts_and_the_gate(spark):
    def make():
        return lambda texts: np.full(len(texts), 0.9)

    rows = spark.createDataFrame([("x",), (None,)], "t string")
    assert sorted((r.s for r in rows.select(PR.score_udf(make)(F.col("t")).alias("s")).collect()), key=str) == [0.9, None]
    prompts, answers, _ = stored_run(spark, SF_SMALL)
    final = cascade.sequential_final(prompts, "strategy-1", 0.5, cascade.from_answers(answers), PR.predictor_score_fn(make), chain=C.CHAINS["flan"])
    assert {r.tier for r in final.collect()} == {1}
