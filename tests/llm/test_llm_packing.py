"""Best-fit packing: plan against plain best fit, ids against the tokenizers library, layout of the sequences."""

import json
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from cases import awkward, empty, prose
from conftest import SF_SMALL
from tokenizers import Tokenizer

from tiergate.llm import best_fit_packing as B


def best_fit(histogram, capacity):
    """Plain best fit decreasing: remaining capacities."""
    bins = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            i = min((i for i in range(len(bins)) if bins[i] >= length), key=lambda i: bins[i], default=None)
            if i is None:
                bins.append(capacity - length)
            else:
                bins[i] -= length
    return sorted(bins)


def test_plan_is_best_fit():
    for seed in range(120):
        r = random.Random(seed)
        capacity = r.choice([7, 20, 64])
        histogram = {n: r.randint(1, 30) for n in r.sample(range(1, capacity + 1), r.randint(1, capacity))}
        plan, n_bins = B.plan_bins(histogram, capacity)
        used = [set() for _ in range(n_bins)]
        for length, lo, hi, per_bin, first, offset in plan:
            for rank in range(lo, hi):
                at = offset + length * ((rank - lo) % per_bin)
                own = set(range(at, at + length))
                b = used[first + (rank - lo) // per_bin]
                assert not b & own
                b |= own
        assert all(b == set(range(len(b))) for b in used)
        assert sorted(capacity - len(b) for b in used) == best_fit(histogram, capacity)
        for n, c in histogram.items():
            spans = sorted((lo, hi) for length, lo, hi, *_ in plan if length == n)
            assert spans[0][0] == 0 and spans[-1][1] == c and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_plan_size_does_not_follow_the_counts():
    few, many = ({n: c for n in range(1, 2049)} for c in (3, 3_000_000))
    assert len(B.plan_bins(many)[0]) < 3 * len(B.plan_bins(few)[0]) and len(B.plan_bins(many)[0]) < 10 * 2048


def test_room_tree():
    tree, r, rooms = B.RoomTree(100), random.Random(1), set()
    for _ in range(2000):
        x = r.randint(0, 100)
        (rooms.discard if x in rooms else rooms.add)(x)
        tree.set(x, x in rooms)
        need = r.randint(1, 100)
        assert tree.tightest(need) == min((x for x in rooms if x >= need), default=None)


def test_ids_are_those_of_the_tokenizers_library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", " ", "Hello wörld's\n\n 123  x", "漢字😀 é\x00\x01", " " * 5000, "a" * 5000, "it's we'll THEY'RE 'tis", "\r\n\t mixed  \n\n\n", prose(3, 2000), "!?" * 3000]
    for text in texts:
        assert B.load_encoder()(text) == t.encode(text, add_special_tokens=False).ids


def test_very_long_runs():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for c in (" ", "\t", "\n", "a", "7", "\u3000", " \n"):
        text = "x " + c * (2_000_000 // len(c)) + "y<|endoftext|>" + c * 5
        assert B.load_encoder()(text) == t.encode(text, add_special_tokens=False).ids, repr(c)


NAMED = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>", "x  <|endoftext|>\n\n y", "<|endoftext| > <|ENDOFTEXT|>", "it'<|endoftext|>s " * 500]


def test_added_tokens_in_a_text():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert B.load_encoder()(NAMED[0]) == [64, 220, 50256, 275]
    for text in NAMED:
        assert B.load_encoder()(text) == t.encode(text, add_special_tokens=False).ids


def test_added_tokens_of_a_given_file(tmp_path):
    """Names that begin alike, and tokens that take the spaces beside them."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    for flag in (None, "lstrip", "rstrip", "single_word"):
        more = [{**spec["added_tokens"][0], "id": 50257 + i, "content": c} for i, c in enumerate(("<a>", "<a><b>"))]
        if flag:
            more[0][flag] = True
        path = tmp_path / f"{flag}.json"
        path.write_text(json.dumps({**spec, "added_tokens": spec["added_tokens"] + more}), encoding="utf-8")
        t, encode = Tokenizer.from_file(str(path)), B.load_encoder(str(path))
        for text in [*NAMED, "x  <a>  y", "<a><b> <a> <b>", "w<a>w <a><a><b><|endoftext|>", "no name"]:
            assert encode(text) == t.encode(text, add_special_tokens=False).ids, (flag, text)


def test_named_tokens_in_documents(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.length, r.ids_crc32) for r in B.pack_documents(spark.createDataFrame(list(enumerate(NAMED[:5])), "doc_id long, text string")).collect()}
    want = {i: [*t.encode(text, add_special_tokens=False).ids, 0] for i, text in enumerate(NAMED[:5])}
    assert got == {i: (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in want.items()}


def test_cut_points():
    for n in (1, 9, 10, 11, 20, 25, 100):
        cuts = B.cut_points(n, 10)
        assert sum(length for _, length in cuts) == n and [s for s, _ in cuts] == np.cumsum([0, *(length for _, length in cuts)])[:-1].tolist()
        assert all(length == 10 for _, length in cuts[1:]) and 1 <= cuts[0][1] <= 10


def check(docs, capacity):
    encode = B.load_encoder()
    got = B.pack_documents(docs, capacity).collect()
    want = defaultdict(int)
    for r in docs.select("doc_id", "text").collect():
        ids = [*encode(r.text or ""), 0]
        for piece, (start, length) in enumerate(B.cut_points(len(ids), capacity)):
            want[r.doc_id, piece, start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())] += 1
    found = defaultdict(int)
    bins = defaultdict(list)
    for r in got:
        found[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        bins[r.sequence_id].append((r.offset, r.length))
    assert found == want
    for spans in bins.values():
        spans.sort()
        assert [a for a, _ in spans] == np.cumsum([0, *(n for _, n in spans)])[:-1].tolist() and sum(n for _, n in spans) <= capacity
    histogram = defaultdict(int)
    for (_, _, _, length, _), c in want.items():
        histogram[length] += c
    assert len(bins) == len(best_fit(histogram, capacity))


def test_awkward_rows(spark):
    for capacity in (16, 2048):
        check(awkward(spark), capacity)
    assert B.pack_documents(empty(spark)).count() == 0


def test_table(spark):
    check(spark.read.parquet(f"{SF_SMALL}/documents.parquet"), 2048)


def test_ids_on_request(spark):
    docs = awkward(spark)
    rows = B.pack_documents(docs, 64, keep_ids=True).collect()
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
