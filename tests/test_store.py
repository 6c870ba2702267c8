import io
import random
import threading
import time
import urllib.request
from http.client import IncompleteRead
from urllib.error import HTTPError

import pytest

from chronoloom.__main__ import main
from chronoloom.functions.formats import typed
from chronoloom.sources import store
from chronoloom.sources.compact import Busy, compact
from chronoloom.sources.http import server
from chronoloom.sources.lines import add_lines, iterate_lines, lines_of, put, read_parallel, text_chunks, write_lines
from chronoloom.sources.store import CommitConflict, Database
from chronoloom.streaming.ingest import ingest, latest_of_stream, line_stream, socket_lines


def add(db, *lines):
    return put(db, "\n".join(lines))


def seen(db, **how):
    return list(iterate_lines(db.snapshot().resolved(), time="nanos", show_format=True, **how))


def test_empty_database(db):
    snap = db.snapshot()
    assert snap.transactions == 0 and snap.resolved().count() == 0 and snap.size_on_disk().count() == 0
    assert compact(db, major=True) is None and put(db, "") is None


def test_last_transaction_wins_whole_record(db):
    assert add(db, "b 1 u 1", "a 1 u 1", "a 2 s x\\ y") == 1  # unsorted is fine
    assert add(db, "a 1 f 2.5", "c 0 U 18446744073709551615") == 2
    assert seen(db) == ["a\t1\tf\t2.50000000000000000", "a\t2\ts\tx\\ y", "b\t1\tu\t1", "c\t0\tU\t18446744073709551615"]
    snap = db.snapshot()
    assert snap.get("b").count() == 1 and snap.get("zz").count() == 0
    assert [r.key for r in snap.get_range("a", "b", include_upper=True).orderBy("key").collect()] == ["a", "a", "b"]
    assert {r.key: len(r.records) for r in snap.get_range_keys("a", "c").collect()} == {"a": 2, "b": 1}
    assert {r.key for r in snap.get_filter_keys("%").collect()} == {"a", "b", "c"}
    assert snap.transactions == 2 and len(snap.transaction_paths()) == 2 and snap.empty_transactions() == []
    assert snap.size_on_disk().agg({"records": "sum"}).first()[0] == 5


def test_filters_reach_the_scan(db):
    add(db, "a 1 u 1")
    add(db, "b 1 u 1")
    db.delete("x%")
    plan = db.snapshot().read("a%", after_time=0, before_time=5)._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(key,a)" in plan and "GreaterThanOrEqual(ts_nanos,0)" in plan
    assert "array<struct<l:bigint>>" in db.snapshot().without_main().all_records().selectExpr("get(cols, 0).l x")._jdf.queryExecution().executedPlan().toString()


def test_snapshots_do_not_change(db):
    add(db, "a 1 u 1")
    old = db.snapshot()
    add(db, "a 1 u 2")
    db.delete("a")
    add(db, "b 1 u 3")
    compact(db, major=True)
    assert old.resolved().select(typed(0, "u32").alias("v")).first().v == 1
    assert seen(db) == ["b\t1\tu\t3"]
    assert len(db.vacuum(older_than=0)) == 3


@pytest.mark.parametrize("lines", [["a 1 u 1", "a 1 u 2"], ["a 1 u x"], ["a 1 u 1 2"], ["a 9223372036854775808 u 1"]])
def test_bad_transactions_leave_nothing(db, lines):
    with pytest.raises(Exception):
        add(db, *lines)
    assert db.snapshot().transactions == 0 and db.files.names("data") == [] and db.files.names("_staging") == []


def test_transaction_rolls_back(db, spark):
    good = spark.createDataFrame([("a", 1, 2.5)], "key string, ts_nanos long, x double")
    with pytest.raises(RuntimeError), db.transaction() as tx:
        tx.add_typed(good)
        raise RuntimeError
    assert db.snapshot().transactions == 0
    with db.transaction() as tx:
        tx.add_typed(good)
    assert seen(db) == ["a\t1\tF\t2.50000000000000000"]
    wrong = good.selectExpr("key", "ts_nanos", "'FF' fmt", "array(named_struct('l', null, 'u', null, 'f', null, 'd', x, 's', null, 'b', null)) cols")
    with pytest.raises(Exception, match="does not match its format"):
        db.add(wrong)


def test_strict_order(db, spark):
    def lines(*x):
        return spark.createDataFrame(list(enumerate(x)), "n long, value string").repartition(3)

    for bad in (["b 1 1", "a 1 1"], ["a 1 1", "a 1 2"], ["a 2 1", "a 1 1"]):
        with pytest.raises(ValueError):
            add_lines(db, lines(*bad), "u", ordered_by="n")
    assert add_lines(db, lines("a 1 1", "a 2 1", "b 1 1"), "u", ordered_by="n") == 1


def test_delete_and_compact(db):
    counts = []
    add(db, "aa 1 u 1")
    compact(db, major=True)
    add(db, "bb 1 u 1", "cc 1 u 1")
    counts.append(len(seen(db)))
    db.delete(after_key="cc")
    counts.append(len(seen(db)))
    add(db, "dd 1 u 1", "ee 1 u 1")
    counts.append(len(seen(db)))
    before = seen(db)
    compact(db)
    counts.append(len(seen(db)))
    assert counts == [3, 2, 4, 4] and seen(db) == before
    snap = db.snapshot()
    assert snap.transactions == 2 and len(snap.delete_markers()) == 1  # it may cover main
    compact(db, major=True)
    assert seen(db) == before and db.snapshot().transactions == 1 and not db.snapshot().delete_markers()


def test_major_compaction_of_everything_deleted(db):
    add(db, "a 1 u 1")
    db.delete("%")
    compact(db, major=True)
    assert seen(db) == [] and not db.snapshot().delete_markers()


def test_delete_exact_time_and_arguments(db):
    add(db, "a 1000000000 u 1", "a 1000000001 u 2")
    db.delete("a", time="1970-01-01T00:00:01")
    assert seen(db) == ["a\t1000000001\tu\t2"]
    with pytest.raises(ValueError):
        db.delete()
    with pytest.raises(ValueError):
        db.delete(time=1, after_time=0)
    for bad in ({}, {"pattern": "a", "after_key": "b"}):
        with pytest.raises(ValueError):
            db.snapshot().read(**bad)


def test_compaction_through_a_filter(db):
    add(db, "bad-x 1 u 1", "old-a 1 s two\\ words", "zz 1 f 1.5")
    compact(db, major=True, command="grep -v ^bad- | sed s/^old-/new-/")
    assert seen(db) == ["new-a\t1\ts\ttwo\\ words", "zz\t1\tf\t1.50000000000000000"]
    compact(db, major=True, transform=lambda df: df.where("key = 'zz'"))
    assert len(seen(db)) == 1
    before = seen(db)
    with pytest.raises(Exception):
        compact(db, major=True, command="exit 3")
    assert seen(db) == before


def test_a_filter_runs_once_in_each_range(db, tmp_path):
    add(db, *[f"k{k:03d} 1 u {k}" for k in range(200)])
    log = tmp_path / "runs"
    compact(db, major=True, command=f"echo run >> {log}; cat")
    assert len(seen(db)) == 200 and len(log.read_text().split()) <= 4  # as many as ranges of keys at most
    with pytest.raises(ValueError, match="nothing through"):
        compact(db, major=True, command="cat >&2")
    assert len(seen(db)) == 200 and db.files.names("_staging") == []


def test_one_compaction_at_a_time(db):
    add(db, "a 1 u 1")
    assert db.files.lock("_log/compact.lock", "x", 100)
    with pytest.raises(Busy):
        compact(db, major=True)


def test_stale_lock_is_taken_over(db):
    files = db.files
    assert files.lock("_log/x.lock", "one", 100) and not files.lock("_log/x.lock", "two", 100)
    files.unlock("_log/x.lock", "two")  # not its own
    assert files.read("_log/x.lock") == "one"
    assert files.lock("_log/x.lock", "three", 0) and files.read("_log/x.lock") == "three"
    files.unlock("_log/x.lock", "three")
    assert not files.exists("_log/x.lock")
    add(db, "a 1 u 1")
    files.lock("_log/compact.lock", "dead", 0)
    assert compact(db, major=True, stale_lock=0) is not None and not files.exists("_log/compact.lock")


@pytest.mark.parametrize("claims", [["000000"], ["000000", "000001"]])
def test_a_dead_writer_blocks_nobody(db, monkeypatch, claims):
    """A writer that has died between its claim and the version's file."""
    add(db, "a 1 u 1")
    version = db.snapshot().version
    for k in claims:
        db.files.write(f"_log/{version + 1:016d}.json.claim-{k}", [b"dead"])
    with pytest.raises(CommitConflict):
        db.commit(lambda m: m, patience=0.3)
    monkeypatch.setattr(store, "CLAIM_SECONDS", 0.5)
    db.delete("b")
    assert db.snapshot().version == version + 1
    assert not [n for n in db.files.names("_log") if "claim" in n or n.endswith(".tmp")]


def test_a_failed_commit_leaves_no_claim(db, monkeypatch):
    add(db, "a 1 u 1")
    write = db.files.write

    def broken(name, chunks):
        if name.endswith(".tmp"):
            raise OSError("disk full")
        write(name, chunks)

    monkeypatch.setattr(db.files, "write", broken)
    with pytest.raises(OSError):
        db.delete("a")
    monkeypatch.undo()
    db.delete("a")
    assert seen(db) == []


def test_minor_compaction_of_very_many(db):
    for k in range(5):
        add(db, f"k{k} 1 u {k}")
    assert db.snapshot().without_main(3).transactions == 3
    compact(db)
    assert db.snapshot().transactions == 1 and len(seen(db)) == 5


def test_row_groups_and_sizes_of_ranges(db, spark):
    assert db.snapshot().row_groups().count() == 0
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    add(db, *[f"k{k:03d} {t} u {t}" for k in range(60) for t in range(20)])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    snap = db.snapshot()
    groups = snap.row_groups().collect()
    assert sum(r.records for r in groups) == 1200 and min(r.first_key for r in groups) == "k000" and max(r.last_key for r in groups) == "k059"
    assert all(r.txid == 1 and 0 < r.bytes and r.first_key <= r.last_key for r in groups)
    inner = [r for r in groups if r.last_key >= "k050" and r.first_key < "k055"]
    got = snap.size_on_disk("k050", "k055").collect()
    assert sum(r.bytes for r in got) == sum(r.bytes for r in inner) <= sum(r.bytes for r in groups)
    assert snap.size_on_disk("x").count() == 0 and snap.size_on_disk(upper="a").count() == 0


def test_only_line_feeds_end_lines(db, spark, tmp_path):
    odd = "x\u2028y\x85z\x1cw"
    put(db, f"k 1 s {odd}\nk 2 s b\n".encode())
    assert [r.s for r in db.snapshot().resolved().orderBy("ts_nanos").select(typed(0, "str").alias("s")).collect()] == [odd, "b"]
    (tmp_path / "lines.txt").write_bytes("a\rb\u2028c\nd".encode())
    assert [r.value for r in lines_of(spark, str(tmp_path / "lines.txt")).collect()] == ["a\rb\u2028c", "d"]
    assert not [n for n in db.files.names("_staging")]


def test_a_body_goes_over_in_large_pieces(db, spark, monkeypatch):
    """Each call of the JVM takes its time, so a body of many small chunks needs few."""
    written = []

    class Out:
        def write(self, piece):
            written.append(bytes(piece))

        def close(self):
            pass

    class Fs:
        def create(self, *_):
            return Out()

    monkeypatch.setattr(db.files, "_fs", Fs())
    chunks = [b"key 1 u 1\n"] * 300_000 + [b"", b"x" * 3_000_000]
    db.files.write("body", iter(chunks))
    assert b"".join(written) == b"".join(chunks) and len(written) <= 7 and max(map(len, written)) <= 2 * store.PIECE
    lines = spark.createDataFrame([(f"line {k}",) for k in range(25_000)], "value string")
    got = list(text_chunks(lines))
    assert len(got) < 100 and sorted(b"".join(got).decode().splitlines()) == sorted(f"line {k}" for k in range(25_000))
    assert list(text_chunks(lines.limit(0))) == []


def test_socket_lines(spark, db, tmp_path):
    import socket

    with socket.create_server(("127.0.0.1", 0)) as listener:
        def serve():
            peer, _ = listener.accept()
            with peer:
                peer.sendall(b"a 1 u 7\nb 2 u 8\n")
                stop.wait(60)

        stop = threading.Event()
        threading.Thread(target=serve, daemon=True).start()
        q = ingest(db, socket_lines(spark, "127.0.0.1", listener.getsockname()[1]), "socket", str(tmp_path / "ck"))
        try:
            for _ in range(120):
                if len(seen(db)) == 2:
                    break
                time.sleep(0.5)
        finally:
            stop.set()
            q.stop()
    assert seen(db) == ["a\t1\tu\t7", "b\t2\tu\t8"]


def test_writers_do_not_lose_commits(db, spark):
    errors = []

    def work(n):
        try:
            add(db, f"k{n} 1 u {n}")
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=work, args=(n,)) for n in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and len(seen(db)) == 4
    with pytest.raises(CommitConflict):
        db.files.create(f"_log/{db.snapshot().version:016d}.json", "{}")


def test_minor_compaction_keeps_later_commits(db):
    add(db, "a 1 u 1")
    add(db, "a 1 u 2")
    db.delete("a")
    add(db, "a 1 u 3")
    compact(db)
    assert seen(db) == ["a\t1\tu\t3"]


def test_parallel_read_and_files(db, tmp_path, spark):
    add(db, *[f"k{k:03d} {t} u {t}" for k in range(30) for t in range(5)])
    out = read_parallel(db.snapshot(), "cut -f1 | uniq -c", partitions=4, pattern="k%")
    assert sorted(x.value.split()[0] for x in out.collect()) == ["5"] * 30
    write_lines(db.snapshot().resolved(), str(tmp_path / "out"), time="nanos", show_format=True)
    other = Database(spark, str(tmp_path / "other"))
    add_lines(other, lines_of(spark, str(tmp_path / "out")))
    assert seen(other) == seen(db)


def test_stream(db, spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.txt").write_text("a 1 u 1\nb 1 u 1\n")

    def run():
        q = ingest(db, line_stream(spark, str(folder), 1), "s", str(tmp_path / "ck"), availableNow=True)
        q.awaitTermination()

    run()
    (folder / "2.txt").write_text("a 1 u 2\n")
    run()
    assert seen(db) == ["a\t1\tu\t2", "b\t1\tu\t1"]
    version = db.snapshot().version
    assert db.add(db.snapshot().resolved(), batch=("s", 0)) is None and db.snapshot().version == version  # a batch that runs again
    assert latest_of_stream(spark.createDataFrame([("a", 1, 1), ("a", 1, 2)], "key string, ts_nanos long, txid long")).first().txid == 2


def test_http(spark, tmp_path, monkeypatch):
    s = server(spark, str(tmp_path / "db"))
    threading.Thread(target=s.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{s.server_address[1]}/"

    def call(path="", method="GET", body=None):
        return urllib.request.urlopen(urllib.request.Request(url + path, body, method=method))

    try:
        assert call(method="PUT", body=b"fib 2000000000 u 13\nfib 1000000000 u 8").status == 201
        assert call("fib").read() == b"fib\t1000000000\t8\nfib\t2000000000\t13\n"
        assert call("fi%25?human").read().startswith(b"fib\t1970-01-01T00:00:01.000000000\t8")
        for how in ({"method": "POST", "body": b""}, {"method": "PUT", "body": b"a 1 u x"}):
            with pytest.raises(HTTPError):
                call(**how)

        def parts():
            yield b"chunked 1 "
            yield b"u 4\nchunked 2 u 5"

        assert call(method="PUT", body=parts()).status == 201
        assert call("chunked").read() == b"chunked\t1\t4\nchunked\t2\t5\n"
        lines = iterate_lines

        def failing(*args, **how):
            yield next(lines(*args, **how))
            raise OSError("lost")

        monkeypatch.setattr("chronoloom.sources.http.iterate_lines", failing)
        with pytest.raises(IncompleteRead):
            call("fib").read()
    finally:
        s.shutdown()


def test_command_line(spark, tmp_path):
    def run(*args, lines=None):
        out = io.StringIO()
        main(["-d", str(tmp_path / "db"), *args], spark, lines, out)
        return out.getvalue()

    run("add", "-f", "uu", "--timestamp-format", "%FT%T", lines=["a 2020-01-01T00:00:00 1 2\n", "b 2020-01-02T00:00:00 3 4\n"])
    assert run("read", "a", "--timestamp-seconds", "-C", "2") == "a\t1577836800\t2\n"
    assert run("read", "--after-key", "a", "--before-time", "2020-01-02", "--print-format") == "a\t2020-01-01 00:00:00\tuu\t1 2\n"
    run("delete", "b")
    run("compact", "--major")
    assert run("read", "%", "--parallel", "wc -l").split() == ["1"]
    assert run("read", "%", "--parallel", "cat", "--timestamp-nanos", "--print-format", "-C", "1") == "a\t1577836800000000000\tuu\t1\n"


def test_rows_and_single_transactions(db):
    db.transaction().add_rows("uFs", [("a", 1, 5, 2.5, "x"), ("b", 2, 6, 0.5, "y")]).commit()
    db.delete("b")
    snap = db.snapshot()
    assert snap.transaction(1).count() == 2 and snap.transaction(2)["wildcard"] == "b"
    with pytest.raises(KeyError):
        snap.transaction(9)
    assert seen(db) == ["a\t1\tuFs\t5 2.50000000000000000 x"]
    with pytest.raises(Exception, match="out of range"):
        db.transaction().add_rows("u", [("a", 1, -1)]).commit()


@pytest.mark.parametrize("seed", range(3))
def test_compaction_changes_nothing(db, seed):
    """Random transactions, deletions and compactions against a dict."""
    r = random.Random(seed)
    model = {}
    for _ in range(7):
        step = r.random()
        if step < 0.55:
            rows = {(r.choice("abcd") + r.choice("xy"), r.randint(0, 5)): r.randint(0, 99) for _ in range(r.randint(1, 8))}
            db.transaction().add_rows("u", [(k, t, v) for (k, t), v in rows.items()]).commit()
            model.update(rows)
        elif step < 0.8:
            key, low, high = r.choice(["%", "a%", "%y"]), r.choice([None, 2]), r.choice([None, 4])
            db.delete(key, after_time=low, before_time=high)
            hit = lambda k: key == "%" or (k.startswith("a") if key == "a%" else k.endswith("y"))  # noqa: B023, E731
            model = {(k, t): v for (k, t), v in model.items() if not (hit(k) and (low is None or t >= low) and (high is None or t < high))}
        else:
            compact(db, major=r.random() < 0.5)
        got = {(x.key, x.ts_nanos): x.v for x in db.snapshot().resolved().select("key", "ts_nanos", typed(0, "u64").cast("int").alias("v")).collect()}
        assert got == model


def test_parallel_read_is_one_shuffle_and_one_pass(db):
    rows = [f"k{k:03d} {t} u {t}" for k in range(40) for t in range(5)]
    add(db, *rows)
    add(db, *[f"k{k:03d} {t} u 9" for k in range(0, 40, 3) for t in range(2, 7)])
    db.delete("k%7", after_time=3)
    add(db, "k007 4 Fs 0.5 a\\ b")
    out = read_parallel(db.snapshot(), "cat", rendered={"time": "nanos", "show_format": True}, pattern="k%", after_time=1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("MapInArrow") == 1
    assert sorted(r.value for r in out.collect()) == list(iterate_lines(db.snapshot().read("k%", after_time=1), time="nanos", show_format=True))
    whole = read_parallel(db.snapshot(), "cut -f1,2 | sort -c -t '\t' -k1,1 -k2,2n && echo in order; cat", partitions=3, rendered={"time": "nanos"}, after_key="k")
    assert {r.value for r in whole.collect()} == {"in order"}


def test_commit_passes_over_its_rows_twice(db, spark):
    """Once to find the ranges of keys, once to write; repeated times and rows are found on the way."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = spark.range(3000).selectExpr("concat('k', id % 7) as key", "id as ts_nanos", "id as v1")
    tracker, group = spark.sparkContext.statusTracker(), "commit-passes"
    spark.sparkContext.setJobGroup(group, group)
    try:
        assert db.transaction().add_typed(rows.mapInArrow(counted, rows.schema)).commit() == 1
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = [s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    assert read.value == 6000 and len(set(stages)) <= 4  # no shuffle of the written rows besides
    assert db.snapshot().all_records().select("txid").distinct().collect() == [(1,)]
    for twice in (rows.union(rows.limit(1)), rows.where("ts_nanos = 5").union(rows.where("ts_nanos = 5"))):
        with pytest.raises(ValueError, match="two records at key"):
            db.transaction().add_typed(twice).commit()
    assert db.transaction().add_typed(rows.where("false")).commit() is None and db.files.names("_staging") == []
