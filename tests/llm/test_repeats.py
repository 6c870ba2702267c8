"""Repeated strings against a table of all strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from chronoloom.llm import fragments as fr
from chronoloom.llm import repeats


def brute(texts, width):
    """Covered bytes by the definition."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[k : k + width] for d in data for k in range(len(d) - width + 1))
    out = []
    for d in data:
        mark = bytearray(len(d))
        for k in range(len(d) - width + 1):
            if seen[d[k : k + width]] > 1:
                mark[k : k + width] = b"\x01" * width
        out.append((d, mark))
    return out


def digest(d, mark):
    kept = bytes(c for c, m in zip(d, mark) if not m)
    spans = sum(m and not (k and mark[k - 1]) for k, m in enumerate(mark))
    return len(d), sum(mark), spans, hashlib.sha256(kept).hexdigest()


def test_fragments_hold_every_string_once():
    r = random.Random(1)
    parts = [bytes(r.choices(b"ab ", k=n)) for n in (0, 10, 40, 300, 41, 900)]
    data, ends = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])
    _, first, size, anchor = fr.fragments(data, ends, 40)
    starts = sorted(x for a, n in zip(first.tolist(), size.tolist()) for x in range(a, a + n))
    want = [k for p, e in zip(parts, ends) for k in range(e - len(p), e - 40 + 1)]
    assert starts == sorted(want)
    assert ((anchor >= first + size - 1) & (anchor + fr.GRAM <= first + 40)).all()


def test_anchors_follow_content():
    r = random.Random(2)
    one = bytes(r.choices(b"abcdefgh", k=500))
    a = np.frombuffer(b"x" * 77 + one, np.uint8)
    b = np.frombuffer(one + b"y" * 10, np.uint8)
    ha, fa, _, aa = fr.fragments(a, np.asarray([len(a)]), 100)
    hb, fb, _, ab = fr.fragments(b, np.asarray([len(b)]), 100)
    inner = {(int(h), int(x)) for h, x in zip(hb, ab) if 100 < x < 400}
    assert inner <= {(int(h), int(x) - 77) for h, x in zip(ha, aa)}


def test_construction_in_groups():
    r = random.Random(4)
    width = 40
    groups, anchors, texts = [], [], []
    for g in range(6):
        core = bytes(r.choices(b"ab", k=fr.GRAM))
        for _ in range(r.randint(1, 6)):
            left, right = r.randint(0, width - fr.GRAM), r.randint(0, width - fr.GRAM)
            t = bytes(r.choices(b"a", k=left)) + core + bytes(r.choices(b"ab", k=right))
            if len(t) >= width:
                groups.append(g)
                anchors.append(left)
                texts.append(t)
    got = {(f, k) for f, a, b in zip(*repeats.repeated_starts(np.asarray(groups), np.asarray(anchors), texts, np.zeros(len(texts), bool), width)) for k in range(a, b + 1)}
    keyed = [(f, k, (groups[f], k - anchors[f], texts[f][k : k + width])) for f in range(len(texts)) for k in range(len(texts[f]) - width + 1)]
    count = Counter(x for _, _, x in keyed)
    assert got == {(f, k) for f, k, x in keyed if count[x] > 1}


def test_digests(docs, texts, empty, spark):
    got = repeats.repeat_digests(docs)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = [(i, *digest(*x)) for (i, _), x in zip(texts, brute([t for _, t in texts], 200))]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert repeats.repeat_digests(empty).count() == 0


@pytest.mark.parametrize("seed, group", [(0, 8_192), (1, 8_192), (2, 3), (3, 0), (4, 1)])
def test_random_copies(spark, seed, group, monkeypatch):
    """Also where no group, or hardly one, is small enough to be built uncut."""
    monkeypatch.setattr(repeats, "GROUP", group)
    r = random.Random(seed)
    pool = ["".join(r.choices("abcde é", k=r.randint(1, 400))) for _ in range(12)]
    texts = ["".join(r.choices(pool, k=r.randint(0, 5))) for _ in range(40)] + ["ab" * 300, "ba" * 150, "z" * 1000]
    monkeypatch.setattr(repeats, "COLLECTION", 5)
    monkeypatch.setattr(repeats, "SLICE", 700)  # long texts in several pieces
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = [(i, *digest(*x)) for i, x in enumerate(brute(texts, 200))]
    assert sorted(map(tuple, repeats.repeat_digests(df).collect())) == want


def test_passage_in_many_contexts(spark, monkeypatch):
    """Groups that only pieces of some lengths make small."""
    monkeypatch.setattr(repeats, "GROUP", 4)
    r = random.Random(9)
    passage = "".join(r.choices("abcdefgh ", k=330))
    texts = ["".join(r.choices("xyz", k=r.randint(0, 30))) + passage[r.randint(0, 3) : 330 - r.randint(0, 40)] + "".join(r.choices("uvw", k=r.randint(0, 30))) for _ in range(60)]
    texts += ["line of words, twenty\n" * 50, "line of words, twenty\n" * 9 + "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = [(i, *digest(*x)) for i, x in enumerate(brute(texts, 200))]
    assert sorted(map(tuple, repeats.repeat_digests(df).collect())) == want


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a" * 300, 5, "r", [7]), (2, None, 6, "s", None)], "doc_id long, text string, row1 int, Row2 string, spans array<int>")
    out = repeats.without_repeats(df)
    assert out.schema == df.schema and sorted(map(tuple, out.collect())) == [(1, "", 5, "r", [7]), (2, None, 6, "s", None)]


def test_without_repeats(docs, texts, empty):
    out = repeats.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    rows = {r.doc_id: r for r in out.collect()}
    plain = dict(texts)
    assert rows[1].text is None and rows[7].text == "" and rows[12].text == plain[12] and rows[12].spans == "s" and rows[12].row == 3
    assert len(rows[10].text) < len(plain[10]) and rows[10].text.split()[0] == plain[10].split()[0]
    assert rows[14].text == "" and repeats.without_repeats(empty).count() == 0


def test_spans():
    assert repeats.merged([[5, 9, 0, 3], [3, 4], [8, 12]]) == [(0, 4), (5, 12)]
    assert repeats.merged([[0, 9, 2, 3], [9, 10, 12, 13]]) == [(0, 10), (12, 13)] and repeats.merged([]) == []
    assert repeats.without(b"abcdef", [(0, 1), (3, 5)]) == b"bcf"


def test_few_and_many_rows_agree(docs, monkeypatch):
    want = sorted(map(tuple, repeats.repeat_digests(docs).collect()), key=repr)
    monkeypatch.setattr(repeats, "BROADCAST_ROWS", -1)
    assert sorted(map(tuple, repeats.repeat_digests(docs).collect()), key=repr) == want
