import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoloom.operators import keys, merge

RECORDS = "key string, ts_nanos long, txid long, v1 long, v2 string"


def model(rows, deletes, matches):
    """What a reader sees, by the definition."""
    best = {}
    for r in rows:
        if (r[0], r[1]) not in best or best[r[0], r[1]][2] < r[2]:
            best[r[0], r[1]] = r
    return sorted(r for r in best.values() if not any(covered(r, d, matches) for d in deletes))


def covered(r, d, matches):
    tx, a, b, t0, t1, w = d
    return r[2] < tx and r[0] >= (a or "") and (not b or r[0] < b) and (t0 is None or r[1] >= t0) and (t1 is None or r[1] < t1) and matches(r[0], w or "%")


def like(key, pattern):
    import re

    return re.fullmatch(".*".join(map(re.escape, pattern.split("%"))), key, re.S) is not None


key = st.sampled_from(["a", "ab", "abc", "b", "ba", "c_"])
row = st.tuples(key, st.integers(0, 3), st.integers(0, 9))
mark = st.tuples(st.integers(0, 10), st.one_of(st.none(), key), st.one_of(st.none(), key), st.one_of(st.none(), st.integers(0, 3)), st.one_of(st.none(), st.integers(0, 4)), st.sampled_from([None, "%", "a%", "%b%", "c_", "%a"]))


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(row, max_size=25, unique=True), st.lists(mark, max_size=4))
def test_resolve_equals_model(spark, rows, deletes):
    rows = [(k, t, x, n, f"v{n}") for n, (k, t, x) in enumerate(rows)]
    got = merge.resolve(spark.createDataFrame(rows, RECORDS), spark.createDataFrame(deletes, merge.DELETES))
    assert sorted(map(tuple, got.collect())) == model(rows, deletes, like)


@pytest.mark.parametrize("path", ["inline", "broadcast", "zones"])
def test_all_ways_of_deletion_agree(spark, monkeypatch, path):
    r = random.Random(5)
    word = lambda: "".join(r.choices("abc", k=r.randint(1, 3)))
    rows = [(word(), r.randint(0, 20), n, n, "x") for n in range(400)]
    deletes = []
    for _ in range(20):
        a, b = sorted([word(), word()])
        deletes.append((r.randint(0, 400), a, b if r.random() < 0.7 else "", r.choice([None, 3]), r.choice([None, 9]), r.choice(["%", "a%", "%c"])))
    if path != "inline":
        monkeypatch.setattr(merge, "INLINE", 3)
    if path == "zones":
        monkeypatch.setattr(merge, "BROADCAST", 3)
    got = merge.suppress(spark.createDataFrame(rows, RECORDS), spark.createDataFrame(deletes, merge.DELETES))
    assert sorted(map(tuple, got.collect())) == sorted(x for x in rows if not any(covered(x, d, like) for d in deletes))


@pytest.mark.parametrize("pattern", ["%", "a%", "%a%", "%a", "a%a"])
@pytest.mark.parametrize("bits", range(16))
def test_delete_matrix(pattern, bits, matrix):
    a, b = ("ab" if bits & 1 else "", "bc" if bits & 2 else "")
    t0, t1 = (3 if bits & 4 else None, 7 if bits & 8 else None)
    d = (10, a, b, t0, t1, pattern)
    rows, expressed = matrix
    assert expressed(d) == sorted(x for x in rows if not covered(x, d, like))


@pytest.fixture(scope="module")
def matrix(spark):
    rows = [(x + y + z, t, t % 3, t, "v") for x in "abc" for y in "abc" for z in ("", "a") for t in range(10)]
    df = spark.createDataFrame(rows, RECORDS).cache()
    fields = [f.name for f in merge.DELETES]
    yield rows, lambda d: sorted(map(tuple, df.where(~merge._covers(dict(zip(fields, d)), "key", "ts_nanos", "txid")).collect()))
    df.unpersist()


def test_latest_wins_plans(spark):
    df = spark.createDataFrame([("a", 1, 1, 5, "x"), ("a", 1, 2, None, None), ("b", 1, 1, 7, "y")], RECORDS)
    assert sorted(map(tuple, merge.latest_wins(df).collect())) == [("a", 1, 2, None, None), ("b", 1, 1, 7, "y")]
    numbers = merge.latest_wins(df.drop("v2"))
    assert sorted(map(tuple, numbers.collect())) == [("a", 1, 2, None), ("b", 1, 1, 7)]
    plan = numbers._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "Window" not in plan
    assert "Window" in merge.latest_wins(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in merge.resolve(df, None, 1)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few", [True, False])
def test_many_markers_of_all_kinds(spark, monkeypatch, few):
    """Zones of keys and of times, beginnings of patterns as bounds, and columns with the names of helpers."""
    monkeypatch.setattr(merge, "INLINE", 2)
    monkeypatch.setattr(merge, "ZONES", 8)
    if not few:
        monkeypatch.setattr(merge, "BROADCAST", 5)
    r = random.Random(8)
    word = lambda: "".join(r.choices(["a", "b", "_", "\\", "é", "~", "\x7f"], k=r.randint(1, 4)))
    rows = [(word(), r.randint(0, 40), n, n, "x", 7, 8) for n in range(500)]
    pattern = lambda: r.choice(["%", "%", None, f"{word()}%", f"%{word()[:1]}%", word(), f"{word()[:1]}%{word()[:1]}"])
    deletes = []
    for _ in range(60):
        a, b = sorted([word(), word()])
        deletes.append((r.randint(0, 300), r.choice([None, "", a]), r.choice([None, "", b]), r.choice([None, r.randint(0, 40)]), r.choice([None, r.randint(0, 40)]), pattern()))
    deletes = [d for d in deletes if any(d[1:5]) or d[5] not in ("%", None)]
    df = spark.createDataFrame(rows, f"{RECORDS}, zone int, rank int")
    got = merge.suppress(df, spark.createDataFrame(deletes, merge.DELETES))
    assert got.columns == df.columns
    left = sorted(map(tuple, got.collect()))
    assert left == sorted(x for x in rows if not any(covered(x, d, like) for d in deletes)) and 0 < len(left) < 500
    assert merge.latest_wins(df).columns == keys.first_per_key(df, 1).columns == df.columns


def test_keyed_markers_do_not_meet_all_rows(spark, monkeypatch):
    monkeypatch.setattr(merge, "INLINE", 2)
    deletes = [(9, f"k{n:03d}", f"k{n + 1:03d}", None, None, "%") for n in range(0, 100, 3)]
    got = merge.suppress(spark.createDataFrame([("k001", 1, 1, 1, "x"), ("k003", 1, 1, 1, "x")], RECORDS), spark.createDataFrame(deletes, merge.DELETES))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan
    assert [r.key for r in got.collect()] == ["k001"]


def test_streamed_keys(spark):
    rows = [(f"k{n % 7}", n, n * 2) for n in range(5000)] + [("one", 1, 1)]
    df = spark.createDataFrame(rows, "key string, ts_nanos long, v1 long").repartition(5)

    def early(key, records):
        first = next(records)
        yield key, first["ts_nanos"], sum(1 for _ in records) if key != "k3" else -1  # k3 is left early

    got = sorted(map(tuple, keys.stream_keys(df, early, "key string, first long, more int", 3).collect()))
    want = sorted((f"k{k}", k, -1 if k == 3 else len(range(k, 5000, 7)) - 1) for k in range(7)) + [("one", 1, 0)]
    assert got == want
    seen = [(key, next(group).ts_nanos) for key, group in keys.iterate_keys(df)]
    assert seen == [(k, t) for k, t, _ in want]
    assert keys.stream_keys(df.where("false"), early, "key string, first long, more int").count() == 0


def test_mapped_keys(spark):
    """Keys that end inside a batch, fill one and span several; null is a key too. Numbers that no double holds stay exact."""
    size, big = "spark.sql.execution.arrow.maxRecordsPerBatch", 2**60 + 1
    rows = [("long", 3 * n, n) for n in range(95)] + [(f"k{n % 9}", n, None if n % 2 else big + n) for n in range(50)] + [(None, 2, 7), (None, 1, None), ("one", 1, big)]
    df = spark.createDataFrame(rows, "key string, ts_nanos long, v1 long").repartition(5)

    def whole(records):
        yield records.column("key")[0].as_py(), records.column("ts_nanos").to_pylist(), records.column("v1").to_pylist()

    before = spark.conf.get(size)
    spark.conf.set(size, "10")
    try:
        got = [tuple(r) for r in keys.map_keys(df, whole, "key string, times array<long>, vs array<long>").collect()]
        assert keys.map_keys(df, lambda records: [], "key string").count() == 0 == keys.map_keys(df.where("false"), whole, "key string, times array<long>, vs array<long>").count()
    finally:
        spark.conf.set(size, before)
    want = []
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: r[1])
        want.append((key, [r[1] for r in own], [r[2] for r in own]))
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_keys(spark):
    df = spark.createDataFrame([("b", 2, 1), ("a", 3, 2), ("a", 1, 3), ("b", 9, 4)], "key string, ts_nanos long, v1 long")
    groups = {r.key: [x.ts_nanos for x in r.records] for r in keys.by_key(df).collect()}
    assert groups == {"a": [1, 3], "b": [2, 9]}
    assert sorted((r.key, r.ts_nanos) for r in keys.first_per_key(df, 1).collect()) == [("a", 1), ("b", 2)]
    assert keys.map_reduce(df, F.sum("v1").alias("s")).first().s == 10
    stats = {r.key: (r.n, r.first_ts, r.last_ts, r.total) for r in keys.per_key_stats(df, F.col("v1")).collect()}
    assert stats == {"a": (2, 1, 3, 5), "b": (2, 2, 9, 5)}
    parts = keys.partition_by_key(df, 3).withColumn("p", F.spark_partition_id()).groupBy("key").agg(F.countDistinct("p").alias("n"))
    assert {r.n for r in parts.collect()} == {1}
    piped = keys.pipe(spark.createDataFrame([("x 'y'",), ("z",)], "value string"), "sed s/x/w/ | grep -v z")
    assert [r.value for r in piped.collect()] == ["w 'y'"]
    many = spark.range(0, 30_000, 1, 1).selectExpr("if(id = 7, '', concat(id, ' \u00e9\u2028x')) value")
    assert keys.pipe(many, "cat").collect() == many.collect()
    assert [r.value for r in keys.pipe(many, "head -n 1; printf 'a\\n\\nb'").collect()] == ["0 \u00e9\u2028x", "a", "", "b"]
    with pytest.raises(Exception):
        keys.pipe(spark.createDataFrame([("x",)], "value string"), "exit 3").collect()
    with pytest.raises(ValueError):
        merge.union_transactions([])
