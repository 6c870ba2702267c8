"""Queries over the test tables, and the same in SQL.

The SQL repeats the adapters of ``sources.adapters`` as common table expressions.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import warnings
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.formats import RECORD, pack_columns, typed
from ..functions.predicates import formatted, key_range, parse_time, pick_columns, pick_format, seconds, time_range, wildcard
from ..functions.text import escape_column, parse_lines, render_lines
from ..operators.keys import by_key, first_per_key, map_keys, map_reduce, partition_by_key, per_key_stats, stream_keys, whole_keys
from ..operators.merge import DELETES, latest_wins, resolve, suppress, union_transactions
from ..sources import adapters
from ..sources.compact import compact
from ..sources.lines import put, read_parallel, text_chunks
from ..sources.store import Database, check_order

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}

EV = """ev AS (SELECT event_type || '/' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS key, epoch_ns(ts) AS ts_nanos,
  event_id % 4 AS txid, value AS v1, props AS v2 FROM events)"""
DAY = """day AS (SELECT event_type || '/' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS key,
  epoch_ns(date_trunc('day', ts)::TIMESTAMP) AS ts_nanos, event_id AS txid, value AS v1 FROM events)"""
ORD = """ord AS (SELECT 'cust/' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS key, epoch_ns(o_orderdate) AS ts_nanos,
  o_orderkey AS txid, o_totalprice AS v1, o_orderstatus AS v2 FROM orders)"""
LI = """li AS (SELECT 'part/' || lpad(CAST(l_partkey AS VARCHAR), 8, '0') AS key, epoch_ns(l_shipdate) AS ts_nanos,
  l_quantity AS v1, l_extendedprice AS v2 FROM lineitem)"""
LATEST = "SELECT * FROM {0} QUALIFY row_number() OVER (PARTITION BY key, ts_nanos ORDER BY txid DESC) = 1"
#: Times that cut the tables' range.
T1, T2 = parse_time("1995-01-01"), parse_time("1997-06-01T12:00:00")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        REGISTRY[f.__name__] = (f, sql)
        return f

    return put


def markers(spark: SparkSession, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), DELETES)


# scans and selections


@query(f"WITH {EV} SELECT key, ts_nanos, txid, v1, v2 FROM ev")
def scan_all(spark, sf):
    return adapters.events(spark, sf)


@query(f"WITH {EV} SELECT key, ts_nanos, txid, v1, v2 FROM ev WHERE key = 'click/000042'")
def key_exact(spark, sf):
    return adapters.events(spark, sf).where(F.col("key") == "click/000042")


@query(f"WITH {ORD} SELECT * FROM ord WHERE key >= 'cust/00000100' AND key < 'cust/00000200'")
def key_range_half_open(spark, sf):
    return adapters.orders(spark, sf).where(key_range("cust/00000100", "cust/00000200"))


@query(f"WITH {ORD} SELECT * FROM ord WHERE key >= 'cust/00000100' AND key <= 'cust/00000200'")
def key_range_incl(spark, sf):
    return adapters.orders(spark, sf).where(key_range("cust/00000100", "cust/00000200", include_upper=True))


@query(f"WITH {ORD} SELECT * FROM ord WHERE key < 'cust/00000050'")
def key_before(spark, sf):
    return adapters.orders(spark, sf).where(key_range(upper="cust/00000050"))


@query(f"WITH {ORD} SELECT * FROM ord WHERE key > 'cust/00001000'")
def key_after(spark, sf):
    return adapters.orders(spark, sf).where(key_range("cust/00001000", include_lower=False))


def _wild(name: str, pattern: str, like: str) -> None:
    def run(spark, sf):
        return adapters.events(spark, sf).where(wildcard(pattern))

    run.__name__ = name
    query(f"WITH {EV} SELECT * FROM ev WHERE key LIKE '{like}' ESCAPE '#'")(run)


_wild("wild_prefix", "click/0000%", "click/0000%")
_wild("wild_infix", "%ase/00%", "%ase/00%")
_wild("wild_suffix", "%7", "%7")
_wild("wild_inner", "s%7%1", "s%7%1")
_wild("wild_literal_underscore", "click_000%", "click#_000%")


@query(f"WITH {ORD} SELECT * FROM ord WHERE ts_nanos >= {T1} AND ts_nanos < {T2}")
def time_range_half_open(spark, sf):
    return adapters.orders(spark, sf).where(time_range(T1, T2))


@query(f"WITH {ORD} SELECT * FROM ord WHERE key LIKE 'cust/0000%' AND ts_nanos >= {T1}")
def filter_and_time(spark, sf):
    return adapters.orders(spark, sf).where(wildcard("cust/0000%") & time_range(after=T1))


@query(f"WITH {LI} SELECT key, ts_nanos, 'F' AS fmt, v2 FROM li")
def select_columns(spark, sf):
    """The second of two stored columns, chosen as text."""
    stored = adapters.lineitems(spark, sf).select("key", "ts_nanos", F.lit("FF").alias("fmt"), pack_columns("FF", F.col("v1"), F.col("v2")).alias("cols"))
    chosen = stored.select("key", "ts_nanos", pick_format("2").alias("fmt"), pick_columns("2").alias("cols"))
    return chosen.select("key", "ts_nanos", "fmt", typed(0, "f64").alias("v2"))


@query(f"WITH {ORD} SELECT 'reversed' AS name, 'refused' AS outcome UNION ALL SELECT 'equal, open', 'refused' UNION ALL SELECT name, CAST((SELECT count(*) FROM ord WHERE key >= a AND (key < b OR (closed AND key = b))) AS VARCHAR) AS outcome "
       "FROM (VALUES ('equal, closed', 'cust/00000200', 'cust/00000200', true), ('beyond', 'd', 'e', false)) t(name, a, b, closed)")
def range_sanity(spark, sf):
    """A single key, bounds beyond all keys, and bounds between which nothing can be, which are an error."""
    o = adapters.orders(spark, sf)
    cases = [("equal, closed", key_range("cust/00000200", "cust/00000200", include_upper=True)), ("beyond", key_range("d", "e"))]
    counts = o.agg(*[F.count_if(c).cast("string").alias(name) for name, c in cases]).unpivot([], [f"`{name}`" for name, _ in cases], "name", "outcome")
    wrong = [("reversed", lambda: key_range("cust/00000300", "cust/00000200")), ("equal, open", lambda: key_range("cust/00000200", "cust/00000200"))]
    return counts.unionByName(spark.createDataFrame([(name, _outcome(f)) for name, f in wrong], "name string, outcome string"))


@query(f"WITH {ORD}, c AS (SELECT * FROM (VALUES ('1995-01-01', TIMESTAMP '1995-01-01'), ('1996-02-29T00:00:00', TIMESTAMP '1996-02-29'), ('1997-06-01 12:00:00', TIMESTAMP '1997-06-01 12:00:00')) t(literal, stamp)) "
       "SELECT literal, epoch_ns(stamp) AS nanos, (SELECT count(*) FROM ord WHERE ts_nanos >= epoch_ns(stamp)) AS n FROM c")
def time_literals(spark, sf):
    """Orders since times that are written in each of the accepted ways."""
    texts = ["1995-01-01", "1996-02-29T00:00:00", "1997-06-01 12:00:00"]
    counts = adapters.orders(spark, sf).agg(*[F.count_if(time_range(after=parse_time(t))).alias(t) for t in texts]).unpivot([], [f"`{t}`" for t in texts], "literal", "n")
    nanos = F.create_map(*[F.lit(x) for t in texts for x in (t, parse_time(t))])
    return counts.select("literal", nanos[F.col("literal")].alias("nanos"), "n")


@query(f"WITH {ORD} SELECT key, ts_nanos // 1000000000 AS ts_seconds, v1 FROM ord")
def ts_seconds(spark, sf):
    return adapters.orders(spark, sf).select("key", seconds().alias("ts_seconds"), "v1")


@query(f"WITH {EV} SELECT key, strftime(make_timestamp(ts_nanos // 1000), '%Y-%m-%dT%H:%M:%S') AS at, v1 FROM ev")
def ts_format(spark, sf):
    return adapters.events(spark, sf).select("key", formatted("yyyy-MM-dd'T'HH:mm:ss").alias("at"), "v1")


def mixed_records(spark: SparkSession, sf: str) -> DataFrame:
    """Events as stored records of two formats: a 32-bit value alone, or a 64-bit one with a string."""
    ev = adapters.events(spark, sf)
    small = F.col("txid") % 2 == 0
    return ev.select("key", "ts_nanos", F.when(small, F.lit("f")).otherwise(F.lit("Fs")).alias("fmt"), F.when(small, pack_columns("f", F.col("v1"))).otherwise(pack_columns("Fs", F.col("v1"), F.col("v2"))).alias("cols"), "txid")


@query(f"WITH {EV} SELECT key, ts_nanos, CASE WHEN txid % 2 = 0 THEN CAST(CAST(v1 AS FLOAT) AS DOUBLE) ELSE v1 END AS value FROM ev")
def typed_widen(spark, sf):
    return mixed_records(spark, sf).select("key", "ts_nanos", typed(0, "f64").alias("value"))


@query(f"WITH {EV} SELECT key, ts_nanos, CASE WHEN txid % 2 = 0 THEN '' ELSE 's' END AS fmt, CASE WHEN txid % 2 = 0 THEN 0 ELSE 1 END AS n FROM ev")
def choose_stored_columns(spark, sf):
    return mixed_records(spark, sf).select("key", "ts_nanos", pick_format("2-5").alias("fmt"), F.size(pick_columns("2-5")).alias("n"))


# merge and deletion


@query(f"WITH {ORD} {LATEST.format('ord')}")
def latest_wins_orders(spark, sf):
    return latest_wins(adapters.orders(spark, sf))


@query(f"WITH {DAY} {LATEST.format('day')}")
def latest_wins_numeric(spark, sf):
    return latest_wins(adapters.daily_events(spark, sf))


def _deleted(name: str, sql: str, *rows: tuple) -> None:
    def run(spark, sf):
        return resolve(adapters.orders(spark, sf), markers(spark, *rows))

    run.__name__ = name
    query(f"WITH {ORD}, kept AS (SELECT * FROM ord WHERE NOT ({sql})) {LATEST.format('kept')}")(run)


_deleted("delete_key_range", "txid < 1000000000 AND key >= 'cust/00000100' AND key < 'cust/00000700'", (1_000_000_000, "cust/00000100", "cust/00000700", None, None, "%"))
_deleted("delete_time_range", f"ts_nanos >= {T1} AND ts_nanos < {T2}", (1_000_000_000, "", "", T1, T2, "%"))
_deleted("delete_wildcard", "key LIKE 'cust/%7'", (1_000_000_000, "", "", None, None, "cust/%7"))
_deleted("delete_tx_order", "txid < 5000 AND key >= 'cust/00000100'", (5000, "cust/00000100", "", None, None, "%"))
_deleted("delete_several", f"(txid < 4000 AND key < 'cust/00000900' AND ts_nanos >= {T1}) OR (txid < 9000 AND key LIKE '%3%')", (4000, "", "cust/00000900", T1, None, "%"), (9000, None, None, None, None, "%3%"))
_deleted("delete_exact_time", f"ts_nanos >= {T1} AND ts_nanos < {T1 + 1}", (1_000_000_000, "", "", T1, T1 + 1, "%"))


@query(
    f"WITH {ORD}, d AS (SELECT c_custkey * 7 AS txid, 'cust/' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS a, 'cust/' || lpad(CAST(c_custkey + 2 AS VARCHAR), 8, '0') AS b FROM customer WHERE c_custkey % 9 = 0) "
    "SELECT * FROM ord o WHERE NOT EXISTS (SELECT 1 FROM d WHERE o.txid < d.txid AND o.key >= d.a AND o.key < d.b)"
)
def delete_many_markers(spark, sf):
    """More markers than predicates should hold: every ninth customer deletes a range."""
    key = lambda c: F.concat(F.lit("cust/"), F.lpad(c.cast("string"), 8, "0"))
    own = F.col("c_custkey")
    d = adapters.table(spark, sf, "customer").where(own % 9 == 0).select((own * 7).alias("txid"), key(own).alias("first_key"), key(own + 2).alias("last_key"), F.lit(None).cast("long").alias("first_ts"), F.lit(None).cast("long").alias("last_ts"), F.lit("%").alias("wildcard"))
    return suppress(adapters.orders(spark, sf), d)


@query(f"WITH {EV} SELECT key, ts_nanos, txid, v1, v2 FROM ev")
def union_txs(spark, sf):
    ev = adapters.events(spark, sf)
    return union_transactions([ev.where(F.col("txid") == k).drop("txid") for k in range(4)]).select("key", "ts_nanos", "txid", "v1", "v2")


@query(f"WITH {ORD}, up AS (SELECT key, ts_nanos, 0 AS txid, v1, v2 FROM ord UNION ALL SELECT key, ts_nanos, 1, v1 * 2, 'X' FROM ord WHERE txid % 3 = 0) SELECT key, ts_nanos, max(txid) AS txid, count(*) AS n FROM up GROUP BY key, ts_nanos")
def upsert_read(spark, sf):
    """A later transaction overwrites some records; which transaction serves each key and time."""
    o = adapters.orders(spark, sf)
    first = o.drop("txid")
    later = o.where("txid % 3 = 0").select("key", "ts_nanos", (F.col("v1") * 2).alias("v1"), F.lit("X").alias("v2"))
    both = union_transactions([first, later])
    counts = both.groupBy("key", "ts_nanos").agg(F.count(F.lit(1)).alias("n"))
    served = latest_wins(both.select("key", "ts_nanos", "txid"))
    return served.join(counts, ["key", "ts_nanos"]).select("key", "ts_nanos", "txid", "n")


# aggregates, groups, order


@query(f"WITH {LI} SELECT count(*) AS n FROM li")
def count_records(spark, sf):
    return map_reduce(adapters.lineitems(spark, sf), F.count(F.lit(1)).alias("n"))


@query(f"WITH {LI} SELECT CAST(sum(CAST(v1 AS BIGINT)) AS BIGINT) AS total, min(ts_nanos) AS first_ts, max(ts_nanos) AS last_ts FROM li")
def map_reduce_sum(spark, sf):
    return map_reduce(adapters.lineitems(spark, sf), F.sum(F.col("v1").cast("long")).alias("total"), F.min("ts_nanos").alias("first_ts"), F.max("ts_nanos").alias("last_ts"))


@query(f"WITH {LI} SELECT count(DISTINCT key) AS n FROM li")
def count_keys(spark, sf):
    return adapters.lineitems(spark, sf).agg(F.countDistinct("key").alias("n"))


@query(f"WITH {LI} SELECT key, count(*) AS n, min(ts_nanos) AS first_ts, max(ts_nanos) AS last_ts, min(v1) AS least, max(v1) AS greatest, CAST(sum(CAST(v1 AS BIGINT)) AS BIGINT) AS total FROM li GROUP BY key")
def per_key_statistics(spark, sf):
    return per_key_stats(adapters.lineitems(spark, sf).withColumn("v", F.col("v1").cast("long")), F.col("v")).withColumn("least", F.col("least").cast("double")).withColumn("greatest", F.col("greatest").cast("double"))


_GROUPS = "SELECT key, count(*) AS n, string_agg(CAST(ts_nanos AS VARCHAR), ',' ORDER BY ts_nanos) AS times FROM w GROUP BY key"


def _groups(df: DataFrame) -> DataFrame:
    times = F.transform("records", lambda r: r["ts_nanos"].cast("string"))
    return by_key(df.select("key", "ts_nanos", "v1")).select("key", F.size("records").cast("long").alias("n"), F.array_join(times, ",").alias("times"))


@query(f"WITH {ORD}, w AS (SELECT * FROM ({LATEST.format('ord')}) WHERE key >= 'cust/00000100' AND key < 'cust/00000300') {_GROUPS}")
def group_range_keys(spark, sf):
    return _groups(latest_wins(adapters.orders(spark, sf)).where(key_range("cust/00000100", "cust/00000300")))


@query(f"WITH {ORD}, w AS (SELECT * FROM ({LATEST.format('ord')}) WHERE key LIKE '%5') {_GROUPS}")
def group_filter_keys(spark, sf):
    return _groups(latest_wins(adapters.orders(spark, sf)).where(wildcard("%5")))


@query(f"WITH {ORD}, w AS ({LATEST.format('ord')}) SELECT key, ts_nanos, v1 FROM w QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts_nanos) <= 2")
def first_of_each_key(spark, sf):
    return first_per_key(latest_wins(adapters.orders(spark, sf)), 2).select("key", "ts_nanos", "v1")


@query(f"WITH {ORD}, w AS ({LATEST.format('ord')}), x AS (SELECT key, ts_nanos - lag(ts_nanos) OVER (PARTITION BY key ORDER BY ts_nanos) AS gap FROM w) SELECT key, max(gap) AS gap FROM x GROUP BY key HAVING count(gap) > 0")
def map_over_keys(spark, sf):
    """A Python function of each key's records: the longest gap between two of them."""

    def gaps(records):
        d = np.diff(records.column("ts_nanos").drop_null().to_numpy())
        return [(records.column("key")[0].as_py(), int(d.max()))] if len(d) else []

    return map_keys(latest_wins(adapters.orders(spark, sf)).select("key", "ts_nanos"), gaps, "key string, gap long")


@query(f"WITH {ORD}, w AS ({LATEST.format('ord')}), x AS (SELECT key, ts_nanos - lag(ts_nanos) OVER (PARTITION BY key ORDER BY ts_nanos) AS gap FROM w) SELECT key, max(gap) AS gap, count(gap) AS n FROM x GROUP BY key")
def stream_over_keys(spark, sf):
    """The same by a function that gets each key's records one by one."""

    def gaps(key, records):
        last, most, n = next(records)["ts_nanos"], None, 0
        for r in records:
            most, last, n = max(most or 0, r["ts_nanos"] - last), r["ts_nanos"], n + 1
        yield key, most, n

    return stream_keys(latest_wins(adapters.orders(spark, sf)).select("key", "ts_nanos"), gaps, "key string, gap long, n long")


@query(f"WITH {ORD}, w AS ({LATEST.format('ord')}) SELECT key, min(ts_nanos) AS first_ts FROM w GROUP BY key")
def stream_leaves_keys_early(spark, sf):
    """Only the first record of each key is read; the rest of the key is passed over."""
    return stream_keys(latest_wins(adapters.orders(spark, sf)).select("key", "ts_nanos"), lambda key, records: [(key, next(records)["ts_nanos"])], "key string, first_ts long")


@query(f"WITH {ORD}, w AS ({LATEST.format('ord')}) SELECT key, ts_nanos, v1, v2 FROM w ORDER BY key, ts_nanos")
def ordered_dump(spark, sf):
    return latest_wins(adapters.orders(spark, sf)).select("key", "ts_nanos", "v1", "v2").orderBy("key", "ts_nanos")


@query(f"WITH {ORD}, w AS ({LATEST.format('ord')}) SELECT key, ts_nanos, v1 FROM w ORDER BY key, ts_nanos LIMIT 100")
def first_n(spark, sf):
    return latest_wins(adapters.orders(spark, sf)).select("key", "ts_nanos", "v1").orderBy("key", "ts_nanos").limit(100)


@query(f"WITH {LI} SELECT key, count(*) AS n, 1 AS partitions FROM li GROUP BY key")
def keys_stay_whole(spark, sf):
    """In how many partitions each key lies after partitioning by key."""
    parts = partition_by_key(adapters.lineitems(spark, sf)).withColumn("p", F.spark_partition_id())
    return parts.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p").cast("int").alias("partitions"))


# text


_ESCAPED = "replace(text, '\\', '\\\\')"
for _code, _name in ((7, "a"), (8, "b"), (9, "t"), (10, "n"), (11, "v"), (12, "f"), (13, "r"), (32, " ")):
    _ESCAPED = f"replace({_ESCAPED}, chr({_code}), '\\{_name}')"


@query(f"SELECT conv_id, turn, {_ESCAPED} AS escaped FROM conversations")
def escape_text(spark, sf):
    return adapters.table(spark, sf, "conversations").select("conv_id", "turn", escape_column("text").alias("escaped"))


@query("SELECT event_id, base64(encode(props)) AS encoded, props AS decoded FROM events")
def base64_roundtrip(spark, sf):
    e = adapters.table(spark, sf, "events")
    return e.select("event_id", F.base64(F.encode("props", "UTF-8")).alias("encoded")).withColumn("decoded", F.decode(F.unbase64("encoded"), "UTF-8")).select("event_id", "encoded", "decoded")


@query(f"WITH {EV} SELECT key || chr(9) || CAST(ts_nanos AS VARCHAR) || chr(9) || 'F' || chr(9) || format('{{:.17f}}', v1) AS value FROM ev")
def render_text(spark, sf):
    ev = adapters.events(spark, sf)
    return render_lines(ev.select("key", "ts_nanos", F.lit("F").alias("fmt"), pack_columns("F", F.col("v1")).alias("cols")), time="nanos", show_format=True)


@query(f"WITH {EV} SELECT key, ts_nanos, 'Fs' AS fmt, v1, v2 FROM ev WHERE v2 <> ''")
def text_roundtrip(spark, sf):
    """Records written as lines and parsed again."""
    ev = adapters.events(spark, sf).where("v2 <> ''")
    lines = render_lines(ev.select("key", "ts_nanos", F.lit("Fs").alias("fmt"), pack_columns("Fs", F.col("v1"), F.col("v2")).alias("cols")), time="nanos", show_format=True)
    return parse_lines(lines).select("key", "ts_nanos", "fmt", typed(0, "f64").alias("v1"), typed(1, "str").alias("v2"))


@query(f"WITH {EV} SELECT key || chr(9) || CAST(ts_nanos // 1000000000 AS VARCHAR) || chr(9) || format('{{:.17f}}', v1) AS value FROM ev")
def render_without_format(spark, sf):
    ev = adapters.events(spark, sf)
    return render_lines(ev.select("key", "ts_nanos", F.lit("Fs").alias("fmt"), pack_columns("Fs", F.col("v1"), F.col("v2")).alias("cols")), time="seconds", columns="1")


@query(f"WITH {EV} SELECT key || chr(9) || CAST(ts_nanos AS VARCHAR) || chr(9) || 'B' || chr(9) || base64(encode(v2)) AS value FROM ev")
def render_bytes(spark, sf):
    ev = adapters.events(spark, sf)
    return render_lines(ev.select("key", "ts_nanos", F.lit("B").alias("fmt"), pack_columns("B", F.encode("v2", "UTF-8")).alias("cols")), time="nanos", show_format=True)


@query(f"""WITH {EV}, n AS (SELECT key, ts_nanos, CAST(floor(v1) AS BIGINT) AS n, v1 FROM ev)
SELECT key || chr(9) || CAST(ts_nanos AS VARCHAR) || chr(9) || 'iIuUf' || chr(9) || CAST(-n AS VARCHAR) || ' ' || CAST(n * 4000000000 AS VARCHAR) || ' ' || CAST(abs(n) AS VARCHAR) || ' ' || CAST(abs(n) * CAST(18000000000 AS HUGEINT) AS VARCHAR)
  || ' ' || format('{{:.17f}}', CAST(CAST(v1 AS FLOAT) AS DOUBLE)) AS value FROM n""")
def render_numbers(spark, sf):
    """Numbers of all stored types as text."""
    n = adapters.events(spark, sf).withColumn("n", F.floor("v1").cast("long"))
    big = F.abs(F.col("n")).cast("decimal(20,0)") * F.lit(18_000_000_000).cast("decimal(11,0)")
    cols = pack_columns("iIuUf", -F.col("n"), F.col("n") * 4_000_000_000, F.abs(F.col("n")), big, F.col("v1"))
    return render_lines(n.select("key", "ts_nanos", F.lit("iIuUf").alias("fmt"), cols.alias("cols")), time="nanos", show_format=True)


@query(f"WITH {ORD} SELECT key, ts_nanos, 'Fs' AS fmt, v1, v2 FROM ord")
def text_of_one_format(spark, sf):
    """Lines ``key time values`` with dates as times, all of one format."""
    o = adapters.orders(spark, sf)
    lines = o.select(F.concat_ws(" ", "key", formatted("yyyy-MM-dd'T'HH:mm:ss"), F.col("v1").cast("string"), "v2").alias("value"))
    return parse_lines(lines, "Fs", "%FT%T").select("key", "ts_nanos", "fmt", typed(0, "f64").alias("v1"), typed(1, "str").alias("v2"))


@query(f"WITH {EV} SELECT key, strftime(make_timestamp(ts_nanos // 1000), '%d.%m.%Y %H-%M-%S') || '.' || lpad(CAST(ts_nanos % 1000000000 AS VARCHAR), 9, '0') AS at, ts_nanos - ts_nanos % 1000000000 AS whole FROM ev")
def stamps_by_pattern(spark, sf):
    """Times written by a pattern, with nine digits of a second, and read back by one."""
    ev = adapters.events(spark, sf).select("key", "ts_nanos", F.lit("").alias("fmt"), F.array().cast(RECORD["cols"].dataType).alias("cols"))
    lines = render_lines(ev, time="%d.%m.%Y %H-%M-%S%.f").select(F.split("value", "\t").alias("x")).select(F.get("x", F.lit(0)).alias("key"), F.get("x", F.lit(1)).alias("at"))
    back = parse_lines(lines.select(F.concat_ws(" ", "key", F.replace(F.substring("at", 1, 19), F.lit(" "), F.lit("_")), F.lit("s"), F.replace("at", F.lit(" "), F.lit("\\ "))).alias("value")), None, "%d.%m.%Y_%H-%M-%S")
    return back.select("key", typed(0, "str").alias("at"), F.col("ts_nanos").alias("whole"))


# the store


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's shared one; in this machine's only in local mode, where none is named."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("name a folder that all machines share in spark.checkpoint.dir")
    return f"{shared or os.path.join(tempfile.gettempdir(), 'chronoloom')}/{name}-{uuid.uuid4().hex}"


def _stored(spark: SparkSession, sf: str, name: str) -> Database:
    """Orders in two transactions, the second one with doubled prices for some, then a deletion."""
    db = Database(spark, scratch(spark, name))
    o = latest_wins(whole_keys(adapters.orders(spark, sf))).select("key", "ts_nanos", "v1", "v2", "txid").persist()  # each commit passes over it twice
    try:
        db.transaction().add_typed(o.drop("txid")).commit()
        db.transaction().add_typed(o.where("txid % 3 = 0").select("key", "ts_nanos", (F.col("v1") * 2).alias("v1"), F.lit("X").alias("v2"))).commit()
    finally:
        o.unpersist()
    db.delete("cust/%7", after_time=T1)
    return db


_STORED = f"""WITH {ORD}, w AS ({LATEST.format('ord')})
SELECT key, ts_nanos, CASE WHEN txid % 3 = 0 THEN v1 * 2 ELSE v1 END AS v1, CASE WHEN txid % 3 = 0 THEN 'X' ELSE v2 END AS v2
FROM w WHERE NOT (key LIKE 'cust/%7' AND ts_nanos >= {T1})"""


def _wide(df: DataFrame) -> DataFrame:
    return df.select("key", "ts_nanos", typed(0, "f64").alias("v1"), typed(1, "str").alias("v2"))


@query(_STORED)
def store_read(spark, sf):
    return _wide(_stored(spark, sf, "store-read").snapshot().resolved())


@query(_STORED)
def compact_minor_equiv(spark, sf):
    db = _stored(spark, sf, "compact-minor")
    compact(db)
    return _wide(db.snapshot().resolved())


@query(_STORED)
def compact_major_equiv(spark, sf):
    db = _stored(spark, sf, "compact-major")
    compact(db, major=True)
    return _wide(db.snapshot().resolved())


@query(f"{_STORED} AND key LIKE 'cust/0000%' AND ts_nanos < {T2}")
def store_selection(spark, sf):
    return _wide(_stored(spark, sf, "store-selection").snapshot().read("cust/0000%", before_time=T2))


@query(f"{_STORED} AND key < 'cust/00000500'")
def compact_transform(spark, sf):
    """A major compaction that drops keys on the way."""
    db = _stored(spark, sf, "compact-transform")
    compact(db, major=True, transform=lambda df: df.where("key < 'cust/00000500'"))
    return _wide(db.snapshot().resolved())


@query(f"{_STORED} AND key NOT LIKE '%3'")
def compact_filter(spark, sf):
    """A major compaction through a shell filter that drops keys."""
    db = _stored(spark, sf, "compact-filter")
    compact(db, major=True, command="grep -v '^[^\t]*3\t'")
    return _wide(db.snapshot().resolved())


@query(f"{_STORED} AND key >= 'cust/00000100'")
def parallel_filter(spark, sf):
    """Records through a shell command for each partition, as text, and back."""
    lines = read_parallel(_stored(spark, sf, "parallel").snapshot(), "cat", rendered={"time": "nanos", "show_format": True}, after_key="cust/00000100")
    return _wide(parse_lines(lines))


@query(f"WITH {ORD}, w AS ({LATEST.format('ord')}) SELECT key, count(*) AS n FROM w WHERE NOT (key LIKE 'cust/%7' AND ts_nanos >= {T1}) GROUP BY key")
def parallel_count(spark, sf):
    """``uniq -c`` in each partition: a key is in one partition alone, in order."""
    lines = read_parallel(_stored(spark, sf, "parallel-count").snapshot(), "cut -f1 | uniq -c", pattern="%")
    return lines.select(F.regexp_extract("value", r"(\S+)$", 1).alias("key"), F.regexp_extract("value", r"(\d+) ", 1).cast("long").alias("n"))


@query(f"WITH {EV} SELECT key, ts_nanos, v1, v2 FROM ev WHERE v2 <> ''")
def put_body(spark, sf):
    """Unsorted lines as a request's body, in chunks, one transaction."""
    ev = adapters.events(spark, sf).where("v2 <> ''")
    lines = render_lines(ev.select("key", "ts_nanos", F.lit("Fs").alias("fmt"), pack_columns("Fs", F.col("v1"), F.col("v2")).alias("cols")), time="nanos", show_format=True)
    db = Database(spark, scratch(spark, "put-body"))
    put(db, text_chunks(lines))
    return _wide(db.snapshot().resolved())


@query(f"WITH {ORD}, w AS ({LATEST.format('ord')}) SELECT count(*) AS records, 0 AS inversions FROM w")
def put_is_sorted(spark, sf):
    """Stored files are in the order of key and time, whatever order rows come in."""
    db = Database(spark, scratch(spark, "put-sorted"))
    db.transaction().add_typed(latest_wins(adapters.orders(spark, sf)).select("key", "ts_nanos", "v1").orderBy(F.xxhash64("ts_nanos"))).commit()
    rows = db.snapshot().all_records().select("key", "ts_nanos", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("k"))
    before = F.lag(F.struct("key", "ts_nanos")).over(Window.partitionBy("file").orderBy("k"))
    return rows.withColumn("before", before).agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("before") >= F.struct("key", "ts_nanos")).cast("int").alias("inversions"))


@query(f"WITH {ORD}, w AS ({LATEST.format('ord')}) SELECT 1 AS txid, count(*) AS records, true AS sized FROM w UNION ALL SELECT 2, count(*), true FROM w WHERE txid % 3 = 0")
def size_of_transactions(spark, sf):
    sizes = _stored(spark, sf, "sizes").snapshot().size_on_disk()
    return sizes.groupBy("txid").agg(F.sum("records").alias("records"), (F.min("bytes") > 0).alias("sized"))


@query(f"WITH {ORD}, w AS ({LATEST.format('ord')}), t AS (SELECT key FROM w UNION ALL SELECT key FROM w WHERE txid % 3 = 0) SELECT min(key) AS first_key, max(key) AS last_key, count(*) AS records FROM t")
def row_group_bounds(spark, sf):
    """What the files' footers say of keys and numbers."""
    return _stored(spark, sf, "row-groups").snapshot().row_groups().agg(F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key"), F.sum("records").alias("records"))


@query(f"WITH {ORD}, w AS ({LATEST.format('ord')}) SELECT key, ts_nanos, v1 * 2 AS v1, 'X' AS v2 FROM w WHERE txid % 3 = 0")
def one_transaction(spark, sf):
    """What one transaction holds, without the others and without deletions."""
    return _wide(_stored(spark, sf, "one-transaction").snapshot().transaction(2))


@query(f"WITH {ORD}, w AS ({LATEST.format('ord')}) SELECT key || chr(9) || CAST(ts_nanos AS VARCHAR) || chr(9) || format('{{:.17f}}', v1) || ' ' || v2 AS value FROM w WHERE key LIKE 'cust/%1'")
def dump_transaction(spark, sf):
    """One transaction's records that match a pattern, as lines."""
    rows = _stored(spark, sf, "dump").snapshot().transaction(1).where(wildcard("cust/%1"))
    return render_lines(rows, time="nanos")


@query("SELECT * FROM (VALUES ('data', 1, ''), ('data', 2, ''), ('deletion', 3, 'cust/%7')) t(kind, number, pattern)")
def snapshot_metadata(spark, sf):
    snap = _stored(spark, sf, "metadata").snapshot()
    rows = [("data", int(p.split("tx-")[1][:12]), "") for p in snap.transaction_paths()] + [("deletion", d["txid"], d["wildcard"]) for d in snap.delete_markers()]
    return spark.createDataFrame(rows, "kind string, number int, pattern string")


@query(_STORED)
def reopened_snapshot(spark, sf):
    """A reader that has read the list of files just before a compaction and the removal of the old ones."""
    db = _stored(spark, sf, "reopened")
    old = [db._manifest()]
    compact(db, major=True)
    db.vacuum(0)
    newest = db._manifest
    db._manifest = lambda: old.pop() if old else newest()
    return _wide(db.snapshot().resolved())


@query(f"WITH {ORD}, w AS ({LATEST.format('ord')}) SELECT key, ts_nanos, v1, v2 FROM w WHERE NOT (key LIKE 'cust/%7' AND ts_nanos >= {T1})")
def lost_transaction(spark, sf):
    """A transaction whose files have gone is passed over."""
    db = _stored(spark, sf, "lost")
    db.files.delete(db.snapshot().transaction_paths()[1])
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return _wide(db.snapshot().resolved())


@query(f"WITH {ORD}, w AS ({LATEST.format('ord')}) SELECT key, ts_nanos, v1 * 2 AS v1, 'X' AS v2 FROM w WHERE txid % 3 = 0")
def above_main(spark, sf):
    """Without main data: the first transaction is compacted, the second comes after."""
    db = Database(spark, scratch(spark, "above-main"))
    o = latest_wins(adapters.orders(spark, sf)).select("key", "ts_nanos", "v1", "v2", "txid")
    db.transaction().add_typed(o.drop("txid")).commit()
    compact(db, major=True)
    db.transaction().add_typed(o.where("txid % 3 = 0").select("key", "ts_nanos", (F.col("v1") * 2).alias("v1"), F.lit("X").alias("v2"))).commit()
    return _wide(db.snapshot().without_main().resolved())


def _outcome(f: Callable[[], object]) -> str:
    try:
        return "nothing" if f() is None else "done"
    except Exception:
        return "refused"


@query(f"""WITH {ORD}, w AS ({LATEST.format('ord')}),
o AS (SELECT count(*) > 0 AS bad FROM (SELECT key, ts_nanos, lag(key) OVER (ORDER BY txid) AS k, lag(ts_nanos) OVER (ORDER BY txid) AS t FROM ord) WHERE k > key OR (k = key AND t >= ts_nanos)),
d AS (SELECT count(*) > 0 AS bad FROM (SELECT key, ts_nanos FROM ord GROUP BY key, ts_nanos HAVING count(*) > 1))
SELECT 'in order of number' AS name, CASE WHEN bad THEN 'refused' ELSE 'done' END AS outcome FROM o
UNION ALL SELECT 'repeated times', CASE WHEN bad THEN 'refused' ELSE 'done' END FROM d
UNION ALL SELECT * FROM (VALUES ('in order of key and time', 'done'), ('columns that miss the format', 'refused'), ('no record', 'nothing'), ('pattern and bounds', 'refused'), ('neither pattern nor bounds', 'refused'), ('time and bounds of times', 'refused'), ('nothing to delete', 'refused'), ('a second compaction', 'refused')) t""")
def rules_of_transactions(spark, sf):
    """What the store refuses: disorder, repeated times, values that miss their format, contradictory arguments, a second compaction."""
    db = Database(spark, scratch(spark, "rules"))
    o = adapters.orders(spark, sf)
    latest = latest_wins(o)
    packed = latest.select("key", "ts_nanos", F.lit("FF").alias("fmt"), pack_columns("F", F.col("v1")).alias("cols"))
    sorted_rows = latest.withColumn("place", F.struct("key", "ts_nanos"))
    db.files.lock("_log/compact.lock", "another", 1000)
    cases = {
        "in order of number": lambda: check_order(o, "txid") or True,
        "in order of key and time": lambda: check_order(sorted_rows, "place") or True,
        "repeated times": lambda: db.transaction().add_typed(o.select("key", "ts_nanos", "v1")).commit(),
        "columns that miss the format": lambda: db.transaction().add(packed).commit(),
        "no record": lambda: db.transaction().add_typed(o.where("false").select("key", "ts_nanos", "v1")).commit(),
        "pattern and bounds": lambda: db.snapshot().read("a%", after_key="a"),
        "neither pattern nor bounds": lambda: db.snapshot().read(after_time="1995-01-01"),
        "time and bounds of times": lambda: db.delete(time="1995-01-01", after_time="1995-01-01"),
        "nothing to delete": lambda: db.delete(),
        "a second compaction": lambda: compact(db, major=True),
    }
    return spark.createDataFrame([(name, _outcome(f)) for name, f in cases.items()], "name string, outcome string")


# flagship


@query(f"WITH {ORD}, kept AS (SELECT * FROM ord WHERE NOT (key >= 'cust/00000020' AND key < 'cust/00000040')), w AS ({LATEST.format('kept')}) SELECT key, ts_nanos, v1, v2 FROM w WHERE key LIKE 'cust/0000%' AND ts_nanos >= {T1}")
def flagship(spark, sf):
    """Latest orders of some customers since a time, one range of customers deleted."""
    deletes = markers(spark, (1_000_000_000, "cust/00000020", "cust/00000040", None, None, "%"))
    return resolve(adapters.orders(spark, sf), deletes).where(wildcard("cust/0000%") & time_range(after=T1)).select("key", "ts_nanos", "v1", "v2")


def queries() -> dict[str, Query]:
    return {n: f for n, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, sql) in REGISTRY.items() if sql is not None}
