"""MinHash, SimHash, embeddings and components against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from chronoloom.llm import components as cc
from chronoloom.llm import minhash, multiindex, simhash

from .conftest import words


class Union:
    def __init__(self):
        self.p = {}

    def find(self, x):
        while self.p.setdefault(x, x) != x:
            x = self.p[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.p[max(a, b)] = min(a, b)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    links = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 130)] + [(200, k) for k in range(201, 230)] + [(7, 7)]
    u = Union()
    for a, b in links:
        u.join(a, b)
    got = {r.node: r.component for r in cc.components(spark.createDataFrame(links, "x long, y long"), "x", "y").collect()}
    assert got == {x: u.find(x) for x in u.p if u.find(x) != x}
    assert cc.components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def sets(text, size):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)])


def brute_near(rows, size, percent=80):
    u = Union()
    shingled = [(i, sets(t, size)) for i, t in rows]
    for a, (i, s) in enumerate(shingled):
        for j, t in shingled[:a]:
            if s and t and i is not None and j is not None and 100 * len(s & t) >= percent * len(s | t):
                u.join(i, j)
    return sorted(((i, len(s), None if i is None else u.find(i) if s else i, i is not None and (not s or u.find(i) == i)) for i, s in shingled), key=repr)


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(docs, texts, empty, size):
    got = minhash.near_duplicates(docs, size=size)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_near(texts, size)
    assert minhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("block", [512, 3])
def test_links_that_stars_miss(spark, block):
    """Chains of edits: a bucket's least id is linked to hardly any other member."""
    r = random.Random(8)
    rows = []
    for g in range(4):
        w = words(r, 60, 10**6).split()
        for _ in range(14):
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = f"x{r.randint(0, 10**6)}"
            rows.append((r.randint(0, 10**6), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, minhash.near_duplicates(df, size=4, block=block).collect()), key=repr)
    assert got == brute_near(rows, 4)


def test_without_near_duplicates(docs):
    out = minhash.without_near_duplicates(docs)
    ids = [r.doc_id for r in out.collect()]
    assert out.columns == docs.columns and 8 not in ids and 9 not in ids and {1, 2, 3, 7, 12} <= set(ids) and ids.count(None) == 2


def test_signature_of_few_shingles():
    one = minhash.shingles("just one", 4)
    sig = minhash.signature(one)
    assert len(one) == 1 and (sig == one[0]).all() and len(set(minhash.band_keys(sig))) == minhash.BANDS
    r = np.random.default_rng(1)
    a = np.unique(r.integers(0, 2**63, 400).astype(np.uint64) * np.uint64(2))
    b = np.unique(np.concatenate([a[40:], r.integers(0, 2**63, 40).astype(np.uint64) * np.uint64(2)]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((minhash.signature(a) == minhash.signature(b)).mean() - true) < 0.15


def test_word_rules():
    assert minhash.shingles("A B c", 4).tolist() == minhash.shingles("a b  c", 4).tolist()
    assert minhash.shingles("É é", 4).tolist() != minhash.shingles("é é", 4).tolist()
    assert len(minhash.shingles(" \n", 4)) == 0 == len(minhash.shingles(None, 4))


# SimHash


def test_fingerprints(docs, texts, empty):
    got = simhash.fingerprints(docs)
    order = sorted(texts, key=lambda x: (x[0] is None, -(x[0] or 0), x[1] or ""))
    want = []
    for (i, t), (_, n) in zip(order, [*order[1:], order[0]]):
        t, n = t or "", n or ""
        h = len(t) // 2
        e = t[: len(t) - h] + n[:h]
        f, g = simhash.fingerprint(t), simhash.fingerprint(e)
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), f.hex(), g.hex(), simhash.likeness(f, g), simhash.likeness(f, simhash.fingerprint(n))))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert simhash.fingerprints(empty).count() == 0 and simhash.simhash(empty).count() == 0


def test_lone_document_follows_itself(spark):
    r = simhash.fingerprints(spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")).first()
    assert r.near_next == 1.0 and r.n_chars == 7


def test_likeness_follows_similarity():
    r = random.Random(0)
    a = words(r, 300).split()
    values = []
    for share in (0, 0.1, 0.3, 0.6, 1):
        b = [w if r.random() >= share else f"z{r.randint(0, 999)}" for w in a]
        values.append(simhash.likeness(simhash.fingerprint(" ".join(a)), simhash.fingerprint(" ".join(b))))
    assert values[0] == 1 and values == sorted(values, reverse=True) and values[-1] < 0.3
    assert simhash.likeness(bytes(16), b"\xff" * 16) == 0


def plain_fingerprint(text):
    """The votes of word pairs one by one, with whole numbers of any size."""
    full = (1 << 64) - 1

    def mix(h):
        h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & full
        h = (h ^ (h >> 27)) * 0x94D049BB133111EB & full
        return h ^ (h >> 31)

    votes, before = [0] * 128, (0, 0)
    words = text.lower().split()
    for w in words:
        own = (xxhash.xxh64_intdigest(w.encode()) & ~15 | min(len(w), 15), min(len(w), 15))
        one = mix((own[0] * 0x9E3779B97F4A7C15 + before[0]) & full)
        two = mix((one + 0x9E3779B97F4A7C15) & full)
        bits = one.to_bytes(8, "little") + two.to_bytes(8, "little")
        for k in range(128):
            up = bits[k // 8] >> (7 - k % 8) & 1
            votes[k] += (own[1] + before[1]) * (1 if up else -1)
        before = own
    return sum(1 << (127 - k) for k in range(128) if votes[k] > 0).to_bytes(16, "big")


@pytest.mark.parametrize("text", ["", "one", "Two words", "é " * 30 + "x" * 40, "the quick brown fox " * 3000])
def test_fingerprint_equals_plain_votes(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("radius, few", [(7, True), (7, False), (3, True)])
def test_near_counts(spark, radius, few, monkeypatch):
    if not few:
        monkeypatch.setattr(simhash, "BROADCAST_ROWS", -1)
    r = random.Random(6)
    base = [r.getrandbits(128) for _ in range(6)]
    codes = [b for x in base for b in [x, x] + [x ^ sum(1 << k for k in r.sample(range(128), r.randint(1, 9))) for _ in range(12)]]
    rows = [(k, f"{c:032x}") for k, c in enumerate(codes)]
    df = spark.createDataFrame(rows, "doc_id long, fingerprint string")
    got = {x.fingerprint: x.n_near for x in simhash.near_counts(df, F.col("doc_id") % 3 == 0, radius).collect()}
    want = {f"{c:032x}": sum((c ^ d).bit_count() <= radius for d in codes) for k, c in enumerate(codes) if k % 3 == 0}
    assert got == want


# embeddings


def brute_links(rows, threshold=0.98):
    def ok(v, label, i):
        return v is not None and label is not None and i is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)

    u, n = Union(), [0] * len(rows)
    for a, (i, v, k) in enumerate(rows):
        for b, (j, w, m) in enumerate(rows[:a]):
            if ok(v, k, i) and ok(w, m, j) and k == m and len(v) == len(w):
                x, y = np.asarray(v, float), np.asarray(w, float)
                if v == w or x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    n[a] += 1
                    n[b] += 1
                    u.join(i, j)
    return sorted(((i, n[a], None if i is None else u.find(i), i is not None and u.find(i) == i) for a, (i, _, _) in enumerate(rows)), key=repr)


def vectors(seed):
    r = np.random.default_rng(seed)
    rows = []
    for _ in range(25):
        base = r.normal(size=8)
        for _ in range(r.integers(1, 6)):
            v = base + r.normal(size=8) * r.choice([0, 0.05, 0.12, 0.3])
            rows.append([round(float(x), 6) for x in v])
    rows += [[0.0] * 8, [1.0] * 7, None, [None] + [1.0] * 7, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [2 * x for x in rows[0]]]
    out = [(k, v, int(r.integers(0, 2))) for k, v in enumerate(rows)]
    return [*out, (None, rows[0], 0), (900, rows[0], None), out[3], (901, rows[-1], 0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_linked_vectors(spark, seed, monkeypatch):
    rows = vectors(seed)
    monkeypatch.setattr(multiindex, "ENTRIES", 2 if seed == 2 else 1024)
    df = spark.createDataFrame([(*x, 1, "c") for x in rows], "vec_id long, embedding array<double>, label int, rep long, many string").repartition(3)
    got = multiindex.linked_vectors(df)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    want = brute_links(rows)
    found = sorted(map(tuple, got.collect()), key=repr)
    assert [x[0] for x in found] == [x[0] for x in want]
    assert found == want


def test_planted_links_at_the_threshold(spark):
    """Pairs barely above and below 0.98, of two lengths: links counted at both ends, recall against brute force."""
    r = np.random.default_rng(5)
    rows = []
    for n, pairs in ((24, 900), (9, 300)):
        base = r.normal(size=(pairs, n))
        base /= np.linalg.norm(base, axis=1, keepdims=True)
        aside = r.normal(size=base.shape)
        aside -= (aside * base).sum(axis=1, keepdims=True) * base
        aside /= np.linalg.norm(aside, axis=1, keepdims=True)
        cosine = r.choice([0.9795, 0.9801, 0.985], size=(pairs, 1))
        for x in (base, 3 * (cosine * base + np.sqrt(1 - cosine**2) * aside)):
            rows += [(len(rows) + k, [float(c) for c in v], k % 3) for k, v in enumerate(x)]
    got = sorted(map(tuple, multiindex.linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()))
    want = dict.fromkeys((i for i, _, _ in rows), 0)
    for n in (24, 9):
        for label in range(3):
            own = [(i, v) for i, v, k in rows if len(v) == n and k == label]
            x = np.asarray([v for _, v in own])
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            want |= {i: int(c) - 1 for (i, _), c in zip(own, (x @ x.T >= 0.98).sum(axis=1))}
    assert sum(want.values()) > 1200
    assert all(g[1] <= want[g[0]] for g in got) and sum(g[1] for g in got) >= 0.995 * sum(want.values())
    assert sum(g[1] for g in got) % 2 == 0
    linked = {g[2] for g in got if g[2] != g[0]} | {g[0] for g in got if g[2] != g[0]}
    assert {g[0] for g in got if g[1]} == linked  # who has a link is in a component, and the other way round


def test_one_sided_visits_count_at_both_ends():
    """A block where the query's cell is not among those that the entry visits."""
    import pyarrow as pa

    rows = [(5, 2, 0, [1.0, 0.0], True, None), (7, 3, 1, [1.0, 0.01], False, [1]), (8, 1, 1, [1.0, 0.02], False, [1, 0]), (9, 1, 1, [0.0, 1.0], False, [0])]
    table = pa.table({c: [r[k] for r in rows] for k, c in enumerate(("rep", "many", "own", "vector", "asks", "visits"))})
    out = multiindex._verify(0.98)(table).to_pylist()
    assert sorted((r["a"], r["b"], r["n"]) for r in out) == [(5, 5, 4), (7, 5, 2), (8, 5, 0)]


def test_lengths_have_indexes_of_their_own(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (3, [1.0, 0.0, 0.0], 0), (4, [1.0, 0.0, 0.01], 0), (5, [2.0], 0), (6, [], 0), (7, [3.0, 0.0], 1)]
    got = sorted(map(tuple, multiindex.linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()))
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (4, 1, 3, False), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True)]


def test_no_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert multiindex.linked_vectors(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r) for r in multiindex.linked_vectors(spark.createDataFrame([(1, None, 2)], schema)).collect()] == [(1, 0, 1, True)]
    assert [tuple(r) for r in multiindex.linked_vectors(spark.createDataFrame([(1, [1.0, 2.0], 2)], schema)).collect()] == [(1, 0, 1, True)]


def test_multi_sequence_order():
    r = np.random.default_rng(3)
    a, b = r.random(7), r.random(5)
    slack = 0.6
    got = list(multiindex.multi_sequence(a, b, slack))
    sums = [a[i] + b[j] for i, j in got]
    assert sums == sorted(sums) and len(set(got)) == len(got)
    assert set(got) == {(i, j) for i in range(7) for j in range(5) if a[i] + b[j] <= a.min() + b.min() + slack + 1e-15}


def test_recall_on_the_test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in df.collect()]
    noise = np.random.default_rng(0)
    more = [(10_000 + i, [float(x) for x in np.asarray(v) + noise.normal(size=len(v)) * 0.02], k) for i, v, k in rows[:200]]
    every = spark.createDataFrame(rows + more, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in multiindex.linked_vectors(every).collect()}
    true = sum(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98 for (i, v, _), (_, w, _) in zip(rows[:200], more))
    assert sum(got[10_000 + i] for i, _, _ in rows[:200]) >= 0.98 * true > 50


def test_search_and_joins_of_many_rows(docs, monkeypatch):
    """What is broadcast while few rows are found gives the same beyond that."""
    search = sorted(map(tuple, simhash.simhash(docs, one_in=2).collect()), key=repr)
    near = sorted(map(tuple, minhash.near_duplicates(docs, size=4).collect()), key=repr)
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(minhash, "BROADCAST_IDS", -1)
    assert sorted(map(tuple, simhash.simhash(docs, one_in=2).collect()), key=repr) == search
    assert sorted(map(tuple, minhash.near_duplicates(docs, size=4).collect()), key=repr) == near
    asked = [r for r in search if r[0] is not None and r[0] % 2 == 0]
    assert all(r[7] >= 1 for r in asked) and all(r[7] is None for r in search if r not in asked)
