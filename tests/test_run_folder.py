"""Run folders: byte ranges of any size give the rows of the whole document; positions, streams, broken documents."""

import io
import json
import random
import re
from collections import Counter

import pytest

from tiergate.sources import run_folder as R


def parse(raw: bytes, size: int, monkey=None):
    """Elements of a document read in ranges of ``size`` bytes, in order, with the rule for ranges without quotes."""
    f = io.BytesIO(raw)
    opening, parts = R.first_section(f), []
    for a in range(0, len(raw), size):
        start, end = max(a, opening), min(a + size, len(raw))
        place, quoted = R.place_at(f, start, end, opening) if start < end else (None, False)
        parts.append((quoted, list(R.elements(f, start, end, place)) if place is not None else []))
    last = max((i for i, (quoted, _) in enumerate(parts) if quoted), default=-1)
    rows = [x for i, (_, own) in enumerate(parts) for x in own if x[1] == "text" or i >= last]
    assert [x[0] for x in rows] == sorted({x[0] for x in rows})
    return [[v for _, k, v in rows if k == "text"], [v for _, k, v in rows if k == "time"]]


TRICKY = ["", ",", ", ", " , ", '"', '\\', '\\"', '"]', '", "', "], [[1, 2], [3", "[1.5, 2.5], [3, 4]", "null", "null, null", "n", "\n\t\r", "é漢😀", "\ud83d", "]", "[[", "1719946222.1, ", "\\\\", " ", "a" * 70]


@pytest.mark.parametrize("chunk", [3, 16, 1 << 20])
def test_every_range_size_reads_the_same(monkeypatch, chunk):
    monkeypatch.setattr(R, "CHUNK", chunk)
    r = random.Random(chunk)
    for trial in range(40 if chunk > 3 else 12):
        words = TRICKY if trial % 3 else [", ", ",", None]
        texts = [r.choice(words) if trial % 4 else r.choice(words + [None]) for _ in range(r.randint(0, 12))]
        if trial % 5 == 0:
            texts.append("[1719946222.1, 1719946223.3], " * r.randint(1, 20))
        times = [[round(r.uniform(0, 2e9), 2), r.choice([1, 2.5, 1e-7])] for _ in range(r.randint(0, 9))]
        if trial % 7 == 0:
            texts = [None] * r.randint(1, 30)
        for raw in (json.dumps([texts, times]).encode(), json.dumps([texts, times], indent=1, ensure_ascii=trial % 2 == 0).encode("utf-8", "surrogatepass"), json.dumps([texts, times], separators=(",", ":")).encode()):
            if b"\xed\xa0" in raw:  # a lone surrogate is no UTF-8
                continue
            want = json.loads(raw)
            for size in {1, 3, 8, 13, 40, 100, len(raw)}:
                assert parse(raw, size) == want, (raw, size)


def test_documents_that_are_none(tmp_path):
    for raw in (b"", b"{}", b'{"a": [[1]]}', b'["a"]'):
        with pytest.raises(ValueError):
            R.first_section(io.BytesIO(raw))
    with pytest.raises(ValueError):
        parse(b'[["a", "b', 100)
    with pytest.raises(ValueError):
        parse(b'[["a" "b"], []]' * 3, 4)


def folders(base, runs):
    for name, doc in runs.items():
        (base / name).mkdir(parents=True)
        (base / name / "output.json").write_bytes(json.dumps(doc).encode())


RUNS = {
    "boolq_flan-t5-base": [["True", "no", 'say "x"', None, ""], [[1.0, 2.0], [2.5, 3.0], [3.5, 4.0]]],
    "boolq_Phi-3-mini": [[f"answer {i} " * (i % 50) for i in range(800)], [[float(i), i + 0.5] for i in range(400)]],
    "mnli_flan-t5-base": [[], []],
    "cnn_dm_flan-t5-xl": [["summary"], [[1.0, 2.0]]],
    "mnli_short_times": [["a", "b", "c"], [[1.0, 2.0]]],
}


def test_batch_reader_gives_positions(spark, tmp_path):
    folders(tmp_path, RUNS)
    (tmp_path / "boolq_notes").mkdir()
    want = set()
    for name, (texts, times) in RUNS.items():
        data = "cnn_dm" if name.startswith("cnn_dm") else name.split("_")[0]
        run = name[len(data) + 1 :]
        for i, t in enumerate(texts):
            a, b = times[i // 2] if i // 2 < len(times) else (None, None)
            want.add((data, run, i + 1, i // 2, t, a, b))
    for size in (20_000, R.RANGE_BYTES):
        rows = R.read_run_folders(spark, str(tmp_path), 2, ["boolq", "mnli", "cnn_dm", "cnn"], size).collect()
        assert len(rows) == len(want) and {tuple(r) for r in rows} == want
    only = R.read_run_folders(spark, str(tmp_path), 2, datasets=["mnli"]).collect()
    assert {r.run for r in only} == {"short_times"}
    assert R.scan_run_folders(spark, str(tmp_path), range_bytes=5000).rdd.getNumPartitions() > 10  # one document, many tasks
    assert R.read_run_folders(spark, str(tmp_path / "boolq_notes"), 2).count() == 0


def test_broken_document_names_itself(spark, tmp_path):
    folders(tmp_path, {"boolq_a": RUNS["boolq_flan-t5-base"]})
    (tmp_path / "boolq_b").mkdir()
    (tmp_path / "boolq_b" / "output.json").write_text('[["a", "b')
    with pytest.raises(Exception, match="boolq_b/output.json"):
        R.read_run_folders(spark, str(tmp_path), 2).collect()
    left = R.read_run_folders(spark, str(tmp_path), 2, skip_broken=True)
    assert {r.run for r in left.collect()} == {"a"} and left.count() == 5
    told = R.scan_run_folders(spark, str(tmp_path), skip_broken=True).where("kind = 'broken'").collect()
    assert [(r.run, r.response) for r in told] == [("b", "end of file inside a text")]


def test_writer_and_reader_round_trip(spark, tmp_path):
    answers = [("d", run, i + 1, t) for run in ("r1", "r_2") for i, t in enumerate(TRICKY[:16] + [None])]
    times = [("d", run, i, i * 1.5, i * 1.5 + 1) for run in ("r1", "r_2") for i in range(5)]
    a = spark.createDataFrame(answers, "dataset string, run string, position long, response string").repartition(3)
    t = spark.createDataFrame(times, "dataset string, run string, batch_id long, start_ts double, end_ts double").repartition(2)
    for _ in range(2):  # a second write replaces the documents
        R.write_run_folders(a, t, str(tmp_path))
    assert sorted(p.name for p in tmp_path.rglob("*") if p.is_file()) == ["output.json"] * 2
    doc = json.loads((tmp_path / "d_r1" / "output.json").read_text())
    assert doc == [TRICKY[:16] + [None], [[i * 1.5, i * 1.5 + 1] for i in range(5)]]
    got = {tuple(r) for r in R.read_run_folders(spark, str(tmp_path), 4, ["d"], 50).select("run", "position", "response").collect()}
    assert got == {(run, i, t) for _, run, i, t in answers}


def test_stream_takes_each_document_once(spark, tmp_path):
    source, out, ckpt = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ckpt")
    source.mkdir()
    spark.dataSource.register(R.RunFolderSource)

    def drain():
        stream = spark.readStream.format("run_folder").option("rangeBytes", 20_000).load(str(source))
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
        q.awaitTermination()
        rows = spark.read.schema(R.SCHEMA).parquet(out).where("kind = 'text'")
        return Counter((r.dataset + "_" + r.run) for r in rows.collect())

    folders(source, {k: RUNS[k] for k in ("boolq_flan-t5-base", "mnli_short_times")})
    assert drain() == {"boolq_flan-t5-base": 5, "mnli_short_times": 3}
    folders(source, {"boolq_Phi-3-mini": RUNS["boolq_Phi-3-mini"]})
    assert drain() == {"boolq_flan-t5-base": 5, "mnli_short_times": 3, "boolq_Phi-3-mini": 800}
    assert drain()["boolq_Phi-3-mini"] == 800


def test_evaluation_moves_texts_once(spark, tmp_path):
    """Reading positions shuffles no text, and answers meet plan, prompt length and gold text in one join - also where ids repeat."""
    from tiergate.plans import evaluate as EV

    folders(tmp_path, {"boolq_flan-a": [["yes", "no", None], []], "boolq_Phi-b": [["p1yes", "p22no"], [[1.0, 2.0]]]})
    rows = R.read_answers(spark, str(tmp_path), ["boolq"], 7)
    told = R.read_run_folders(spark, str(tmp_path), 2, ["boolq"], 7).select("dataset", "run", "position", "response")
    assert sorted(map(str, rows.collect())) == sorted(map(str, told.collect())) and rows.count() == 5
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(file|SortMergeJoin", "".join(x for x in plan.splitlines() if "response" in x))
    refs = spark.createDataFrame([("boolq", 1, "p1", "1"), ("boolq", 2, "p22", "0"), ("boolq", 2, "p333", "1"), ("boolq", None, "p4444", "1")], "task string, prompt_id long, prompt_text string, gold_text string")
    met = EV.answers_of_folders(rows, refs, 2)
    want = EV.labelled(met.select("task", "model", "prompt_id", "response").distinct(), refs)
    assert sorted(map(str, EV.labelled_rows(met).distinct().collect())) == sorted(map(str, want.distinct().collect()))
    assert met.count() == 8  # the second and third place have two references each
    # a run without the prompt's text: its length is enough
    assert {(r.model, r.prompt_id, r.pred_class) for r in EV.labelled_rows(met).collect() if r.prompt_id == 1} == {("flan-a", 1, 1), ("Phi-b", 1, 1)}
