import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronoloom.llm import queries, toxicity

from .conftest import words
from .test_repeats import brute
from .test_tokens import check_pieces


@pytest.fixture
def tables(spark, docs, tmp_path):
    docs.withColumnRenamed("key", "other").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages_keep_columns(spark, tables):
    df = spark.read.parquet(f"{tables}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, df, tables)
        assert out.columns == df.columns
        path = f"{tables}/{k}"
        out.write.parquet(path)
        df = spark.read.parquet(path)
    assert df.where(F.coalesce(F.char_length("text"), F.lit(0)) != F.col("n_chars")).count() == 0


def test_every_stage_takes_effect(spark, tmp_path):
    r = random.Random(2)
    text = {k: words(r, 80, 10**6) for k in range(400)}
    for k in range(0, 400, 4):  # toxic ones
        w = text[k].split()
        for at in range(3, len(w), 12):
            w[at] = r.choice(["scumbag", "moronic"])
        text[k] = " ".join(w)
    text[1001] = text[1] + " more"  # near copies
    passage = words(r, 60, 10**6)
    text[1002], text[1003] = f"{words(r, 40, 10**6)} {passage} end", f"start {passage} {words(r, 45, 10**6)}"
    text[1005] = f"{words(r, 30, 10**6)} write to bob@example.com or +1 (743) 555-3824"
    spark.createDataFrame([(k, t, len(t)) for k, t in text.items()], "doc_id long, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(300)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, df, str(tmp_path)).write.parquet(str(tmp_path / f"s{k}"))
        df = spark.read.parquet(str(tmp_path / f"s{k}"))
        kept.append({x.doc_id: x.text for x in df.collect()})
    toxic = [k for k in range(0, 400, 4)]
    assert sum(k in kept[0] for k in toxic) < 5 and len(kept[0]) > 295
    assert (1 in kept[1]) and 1001 not in kept[1] and len(kept[1]) == len(kept[0]) - 1
    assert passage[20:-20] in kept[1][1002] and passage[20:-20] not in kept[2][1002] and passage[20:-20] not in kept[2][1003] and kept[2][1002].endswith("end")
    assert kept[3][1005].endswith("write to [EMAIL] or [PHONE]")
    pieces = corpus_pipeline.packing(spark, df, str(tmp_path))
    assert {x.doc_id for x in pieces.collect()} == set(kept[3])


def test_one_row_of_each_group_stays(spark, tmp_path):
    """Repeated rows, rows that share an id, and rows without id: no copy reaches ``repeats``, which would empty them all."""
    r = random.Random(6)
    a, b, c, d, e = (words(r, 80, 10**6) for _ in range(5))
    rows = [(1, a), (1, a), (1, a + " more"), (2, b), (2, c), (3, c), (None, b), (None, d), (None, d), (None, None), (None, ""), (4, None), (5, e)]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, __row long").repartition(3)
    out = corpus_pipeline.near_duplicates(spark, df, str(tmp_path))
    got = sorted(((x.doc_id, x.text) for x in out.collect()), key=repr)
    assert out.columns == df.columns
    first = [t for i, t in got if i == 1]
    assert len(first) == 1 and first[0] in (a, a + " more")
    assert sorted((x for x in got if x[0] != 1), key=repr) == sorted([(2, b), (2, c), (None, d), (None, None), (None, ""), (4, None), (5, e)], key=repr)
    texts = {x.text for x in corpus_pipeline.repeats(spark, out, str(tmp_path)).collect()}
    assert {b, c, d, e} <= texts and texts & {a, a + " more"}
    assert corpus_pipeline.near_duplicates(spark, df.limit(0), str(tmp_path)).count() == 0


def plain_pipeline(docs, weights, bias):
    """All stages but packing by their definitions, on a dict of texts by id."""
    def score(t):
        k, v = toxicity.text_vector(t or "")
        return float(v @ weights[k]) + bias

    docs = {i: t for i, t in docs.items() if score(t) < 0}

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets, root = {i: shingles(t) for i, t in docs.items()}, {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in docs:
        for j in docs:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    docs = {i: t for i, t in docs.items() if find(i) == i}
    marks = brute(list(docs.values()), 200)  # all texts are ASCII, so bytes are characters
    docs = {i: None if t is None else "".join(chr(c) for c, m in zip(*x) if not m) for (i, t), x in zip(docs.items(), marks)}
    kinds = {"EMAIL": r"[a-z.]+@[a-z]+\.com", "PHONE": r"\+1 \([0-9]{3}\) 555-[0-9]{4}", "CARD": r"4111 1111 1111 1111", "IP": r"10\.0\.0\.[0-9]+"}  # those of the fixture
    for name, pattern in kinds.items():
        docs = {i: t and re.sub(pattern, f"[{name}]", t) for i, t in docs.items()}
    return docs


def test_run_equals_the_definitions(spark, tmp_path):
    r = random.Random(12)
    docs = {k: words(r, r.randint(5, 120), 3000) for k in range(260)}
    for k in range(0, 260, 5):
        w = docs[k].split()
        for at in range(2, len(w), 9):
            w[at] = r.choice(["scumbag", "moronic"])
        docs[k] = " ".join(w)
    for k in range(40):  # near copies, some beyond the threshold, in chains
        w = docs[r.choice(list(docs))].split()
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"z{r.randint(0, 99)}"
        docs[300 + k] = " ".join(w)
    passage = words(r, 70, 10**6)
    for k in range(30):
        docs[400 + k] = f"{words(r, r.randint(0, 40), 10**6)} {passage[r.randint(0, 40):]} {words(r, r.randint(0, 20), 10**6)}"
    for k in range(20):
        docs[500 + k] = f"{words(r, 12, 10**6)} ann.lee@site.com {words(r, 9, 10**6)} +1 (743) 555-{3000 + k}, 4111 1111 1111 1111; 10.0.0.{k}"
    docs |= {600: None, 601: "", 602: " ", 603: "one two"}
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3).write.parquet(path)
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(200)], "doc_id long, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    want = plain_pipeline(docs, *toxicity.fit(spark.read.parquet(path), labels))
    assert 200 < len(want) < 310
    check_pieces([tuple(x) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()], list(want.items()), 1024)


def test_run(spark, tables):
    out = corpus_pipeline.run(spark, tables)
    assert out.columns[0] == "doc_id" and out.count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_registered():
    names = list(queries.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)
