"""SimHash near-dedup against brute force."""

import random
import re
from collections import Counter

import numpy as np
import xxhash
from cases import awkward, empty, prose
from conftest import SF_MID

from tiergate.llm import simhash_dedup as S


def slow_simhash(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def close_pairs(fps, radius=3):
    return [(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (int(fps[i]) ^ int(fps[j])).bit_count() <= radius]


def crowded(seed, centers, copies):
    r = np.random.default_rng(seed)
    base = r.integers(0, 2**64, centers, dtype=np.uint64)
    out = [base]
    for _ in range(copies):
        flips = np.zeros(centers, np.uint64)
        for _ in range(int(r.integers(1, 5))):
            flips ^= np.uint64(1) << r.integers(0, 64, centers).astype(np.uint64)
        out.append(base ^ flips)
    return np.unique(np.concatenate(out))


def components_of(rows):
    """Brute force: {row index: smallest id} over rows (doc_id, fingerprint)."""
    fps = sorted({f for _, f in rows})
    of = dict(zip(fps, groups(len(fps), close_pairs(fps))))
    low = {}
    for d, f in rows:
        if d is not None:
            low[of[f]] = min(low.get(of[f], d), d)
    return [low.get(of[f]) for _, f in rows]


def test_fingerprints():
    for t in (None, "", " \n", "One", "one Two", "a b c", "É İ Ab ab\x0bcd", "a b c a b c d " * 40, prose(4, 500)):
        assert S.simhash(t) == slow_simhash(t)
    assert S.simhash("x " * 200_000) == slow_simhash("x x x")


def test_bit_sliced_distance_counts():
    r = np.random.default_rng(3)
    a, b = (r.integers(0, 2**64, 300, dtype=np.uint64) for _ in range(2))
    b[:150] = a[:150] ^ (np.uint64(1) << r.integers(0, 64, 150).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 150).astype(np.uint64))
    pa, pb = S.planes_of(a), S.planes_of(b)
    for radius in (1, 2, 3, 5, 30):
        got = S.within((pa[k] ^ pb[k] for k in range(64)), radius, look=64)
        want = [int(x ^ y).bit_count() <= radius for x, y in zip(a, b)]
        assert got is None and not any(want) or S._lanes(got, 300).tolist() == want


def test_runs_keep_components():
    for seed in range(3):
        fps = crowded(seed, 60, 6)
        want = groups(len(fps), close_pairs(fps))
        assert groups(len(fps), S.forest_of_run(fps)) == want
        r = np.random.default_rng(seed)
        r.shuffle(fps)
        run = np.sort(r.integers(0, 40, len(fps)))
        a, b = S.links_of_runs(run, fps)
        at = {int(x): i for i, x in enumerate(fps)}
        same_run = [(i, j) for i, j in close_pairs(fps) if run[i] == run[j]]
        assert groups(len(fps), [(at[int(x)], at[int(y)]) for x, y in zip(a, b)]) == groups(len(fps), same_run)


def chain(seed=1):
    """h1-n1-n2-h2 whose middle link stands in one bucket only, with 80 unrelated fingerprints of that bucket between
    the ends of the chain and its middle, in order of value."""
    bits = lambda *b: sum(1 << i for i in b)
    r = random.Random(seed)
    others = set()
    while len(others) < 80:
        others.add(bits(60, 61) | r.getrandbits(34) << 26)
    return sorted({bits(30, 31), bits(62), bits(62, 27, 40, 53), bits(27, 40, 53, 35, 36)} | others)


def test_links_between_reached_fingerprints():
    for seed in range(5):
        fps = chain(seed)
        assert groups(len(fps), S.forest_of_run(np.array(fps, np.uint64))) == groups(len(fps), close_pairs(fps))
    for seed in range(8):  # chains with steps of three bits, many side by side
        r = random.Random(seed)
        fps = set()
        for _ in range(40):
            walk = r.getrandbits(64)
            for _ in range(r.randint(1, 12)):
                fps.add(walk)
                walk ^= sum(1 << b for b in r.sample(range(64), 3))
        fps = np.array(r.sample(sorted(fps), len(fps)), np.uint64)
        pairs = S.forest_of_run(fps)
        assert groups(len(fps), pairs) == groups(len(fps), close_pairs(fps)) and len(pairs) < len(fps)


def test_chain_through_one_bucket(spark):
    fps = chain()
    edges = [(r.a, r.b) for r in S.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()]
    at = {f: i for i, f in enumerate(fps)}
    assert groups(len(fps), [(at[a], at[b]) for a, b in edges]) == groups(len(fps), close_pairs(fps))


def test_links_and_components(spark):
    """Buckets over the chunk size are dealt into cells; the components stay those of brute force."""
    r = random.Random(2)
    center = r.getrandbits(64)
    fps = {int(x) for x in crowded(5, 30, 5)}
    walk = center
    for _ in range(400):  # a long chain, and a crowd round its start
        walk ^= 1 << r.randrange(64)
        fps.add(walk)
        fps.add(center ^ 1 << r.randrange(64) ^ 1 << r.randrange(64))
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = groups(len(fps), close_pairs(fps))
    for chunk in (16, 1024):
        edges = [(r.a, r.b) for r in S.links(df, chunk=chunk).collect()]
        at = {f: i for i, f in enumerate(signed)}
        assert groups(len(fps), [(at[a], at[b]) for a, b in edges]) == want
    named = {r.node: r.root for r in S.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    low = {}
    for f, g in zip(signed, want):
        low[g] = min(low.get(g, f), f)
    sizes = Counter(want)
    assert named == {f: low[g] for f, g in zip(signed, want) if sizes[g] > 1}


def test_operator_on_awkward_rows(spark):
    docs = awkward(spark)
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in S.near_duplicates(docs).collect())
    rows = [(r.doc_id, slow_simhash(r.text)) for r in docs.collect()]
    want = Counter((d, f"{f:016x}", c) for (d, f), c in zip(rows, components_of(rows)))
    assert got == want
    kept = S.keep_one_per_group(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    # one row for each component; a component with ids is kept by its smallest
    named = {c for c in components_of(rows) if c is not None}
    assert sorted(i for i in ids if i is not None) == sorted(named)
    assert S.near_duplicates(empty(spark)).count() == 0 and S.keep_one_per_group(empty(spark)).count() == 0


def test_operator_on_a_table(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    got = S.near_duplicates(docs).collect()
    rows = [(r.doc_id, int(r.fingerprint, 16)) for r in got]
    assert [r.component_id for r in got] == components_of(rows)
    sample = {r.doc_id: r.text for r in docs.limit(60).collect()}
    assert all(int(r.fingerprint, 16) == slow_simhash(sample[r.doc_id]) for r in got if r.doc_id in sample)
