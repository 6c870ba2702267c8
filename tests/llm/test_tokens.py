"""Token counts, SentencePiece and packing against their libraries."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoloom.llm import packing, pieces, tokencount
from chronoloom.llm.common import tokenizer_path

odd = st.text(st.one_of(st.sampled_from(list(" \n\t\r\x1c\x85  ▁aAbé.'!1ßİΣσ中😀<|>")), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(odd, max_size=4))
def test_counts_equal_the_library(texts):
    path = tokenizer_path("word_bpe_49k.json")
    got = tokencount.count_tokens(texts, path, {})
    tok = tokencount._library(path)[0]
    assert got == [len(tok.encode(t, add_special_tokens=False)) for t in texts]


def test_counts_use_the_table_first():
    path = tokenizer_path("word_bpe_49k.json")
    assert tokencount.count_tokens(["zzqx zzqx"], path, {"zzqx": 40}) == [80]


def test_token_counts(docs, texts, empty):
    path = tokenizer_path("word_bpe_49k.json")
    got = tokencount.token_counts(docs, path, table_size=50)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    tok = tokencount._library(path)[0]
    want = sorted(((i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False)), n > 2048) for i, t in texts), key=repr)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert tokencount.token_counts(empty, path).count() == 0


def test_unbroken_texts_with_the_default_table(spark):
    """More tokens in one chunk than 16 bits hold; such chunks stay out of the broadcast table."""
    path = tokenizer_path("word_bpe_49k.json")
    rows = [(1, "a" * 1_000_000), (2, "a" * 1_000_000), (3, "中文字" * 9_000 + " short"), (4, "b" * tokencount.LONGEST)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tok = tokencount._library(path)[0]
    want = {i: len(tok.encode(t, add_special_tokens=False)) for i, t in rows}
    assert max(want.values()) > 65_535
    assert {r.doc_id: r.n_tokens for r in tokencount.token_counts(df, path).collect()} == want
    assert set(tokencount.frequent_chunks(df, "text", 16_384)) == {"short", "b" * tokencount.LONGEST}


@settings(max_examples=300, deadline=None)
@given(st.lists(odd, max_size=4))
def test_pieces_equal_the_library(texts):
    path = tokenizer_path("piece_bpe_32k.model")
    sp, _, _, chunked = pieces._model(path)
    assert chunked
    for t, (ids, decoded) in zip(texts, pieces.encode_decode(texts, path)):
        want = sp.encode(t, add_eos=True)
        assert ids == " ".join(map(str, want)) and decoded == sp.decode(want)


def test_pieces_vocabulary_check():
    assert pieces.check_vocabulary(["▁▁a", "b", "▁"])
    assert not pieces.check_vocabulary(["a▁b"]) and not pieces.check_vocabulary(["a\n"])


def test_sentencepiece_digests(docs, texts, empty):
    path = tokenizer_path("piece_bpe_32k.model")
    sp = pieces._model(path)[0]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in texts:
        ids = sp.encode(t or "", add_eos=True)
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids))))
    got = pieces.sentencepiece_digests(docs, path)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert pieces.sentencepiece_digests(empty, path).count() == 0
    assert {r.doc_id: r.ids for r in pieces.token_ids(docs.where("doc_id = 5"), path).collect()} == {5: sp.encode("one two", add_eos=True)}


@settings(max_examples=200, deadline=None)
@given(st.lists(odd, max_size=4))
def test_packing_ids_equal_the_library(texts):
    path = tokenizer_path("byte_bpe_50k.json")
    tok = packing._library(path)[0]
    for t, ids in zip(texts, packing.encode_documents(texts, path)):
        assert ids.tolist() == [*tok.encode(t, add_special_tokens=False).ids, 0]


def brute(pos, penalty, length):
    best = [0] + [None] * (len(pos) - 1)
    for j in range(1, len(pos)):
        best[j] = min(best[i] + length - (pos[j] - pos[i]) + penalty[j] for i in range(j) if pos[j] - pos[i] <= length)
    return best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 10), st.integers(0, 5)), max_size=40))
def test_queue_finds_the_least_cost(steps):
    pos = [0, *np.cumsum([s for s, _ in steps]).tolist()]
    penalty = [0, *[p for _, p in steps]]
    best, before = packing.choose_cuts(pos, penalty, 10)
    assert best == brute(pos, penalty, 10)
    for j in range(1, len(pos)):
        i = before[j]
        assert best[j] == best[i] + 10 - (pos[j] - pos[i]) + penalty[j]


def check_pieces(rows, texts, length):
    path = tokenizer_path("byte_bpe_50k.json")
    tok = packing._library(path)[0]
    sequences = defaultdict(list)
    for r in rows:
        sequences[r[5]].append((r[6], r[2]))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert 0 < at <= length
    want = sorted(((i, len(tok.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in texts), key=repr)
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r[0]].append(r)
    assert sorted(((i, sum(r[2] for r in rs)) for i, rs in by_doc.items()), key=repr) == sorted({i: sum(n for j, n in want if j == i) for i, _ in want}.items(), key=repr)
    for i, t in texts:
        if [j for j, _ in texts].count(i) > 1:
            continue
        ids = np.asarray([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r[1]):
            assert r[1] == at and r[4] == len(ids) and r[3] == zlib.crc32(ids[at : at + r[2]].tobytes())
            at += r[2]
        assert at == len(ids)
    return sequences


def test_cuts_are_at_ends_of_sentences():
    """Word ends are offered only in stretches without another end, and ids inside words only where words are as long."""
    path = tokenizer_path("byte_bpe_50k.json")
    texts = ["Short one. And another! " * 30, "word " * 200, "ab" * 300 + ". End.", ""]
    ids = list(packing.encode_documents(texts, path))
    stream, stops = np.concatenate(ids), np.cumsum([len(x) for x in ids])
    pos, penalty = packing.cuts_of(stream, stops, path)
    cost = dict(zip(pos.tolist(), penalty.tolist()))
    p = packing.PENALTIES
    assert pos[0] == 0 and pos[-1] == len(stream) and (np.diff(pos) > 0).all() and np.diff(pos).max() <= packing.LONG
    assert all(cost[e] == p["document"] for e in stops.tolist())
    assert {cost[k] for k in cost if 0 < k < stops[0]} == {p["sentence"]}
    assert {cost[k] for k in cost if stops[0] < k < stops[1]} == {p["word"]}
    assert {cost[k] for k in cost if stops[1] < k < stops[2]} == {p["inside"], p["sentence"]}


def test_pack(docs, texts, empty):
    path = tokenizer_path("byte_bpe_50k.json")
    rows = [tuple(r) for r in packing.pack(docs, path).collect()]
    check_pieces(rows, texts, 1024)
    kinds = {"document", "sentence", "word", "inside", "tail"}
    assert all(r[7] in kinds and (r[7] == "document") == (r[1] + r[2] == r[4]) for r in rows)
    assert sorted(map(tuple, packing.pack(docs, path).collect()), key=repr) == sorted(rows, key=repr)  # again the same
    assert packing.pack(empty, path).count() == 0


def test_blocks_carry_on(texts):
    path = tokenizer_path("byte_bpe_50k.json")
    named = [(n, t or "") for n, (_, t) in enumerate(texts)]
    packer = packing.Packer(path, 1024, 0, block=5000)
    rows = []
    for (i, _), ids in zip(named, packing.encode_documents([t for _, t in named], path)):
        rows += packer.add(i, ids)
    rows += packer.finish()
    sequences = check_pieces(rows, named, 1024)
    sizes = [sum(n for _, n in parts) for parts in sequences.values()]
    waste = sum(1024 - s for s in sizes if s & (s - 1))
    assert waste < 0.01 * sum(sizes)
    order = [r[0] for r in rows]
    assert order == sorted(order)
