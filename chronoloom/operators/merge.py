"""Last transaction wins, and deletion by ranges.

Both steps commute, because a marker depends on key, time and a lower transaction
alone: the anti-join goes below the aggregate, where it saves shuffled rows.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import free_name, like_pattern

DELETES = T.StructType([
    T.StructField("txid", T.LongType(), False), T.StructField("first_key", T.StringType()), T.StructField("last_key", T.StringType()),
    T.StructField("first_ts", T.LongType()), T.StructField("last_ts", T.LongType()), T.StructField("wildcard", T.StringType()),
])
#: Markers up to this many become literal predicates, which Parquet can use; up to the second number they are read once, by the driver, and broadcast.
INLINE, BROADCAST = 32, 50_000
#: Ranges that keys or times are cut in, so that a row meets the markers of its own range alone.
ZONES = 2000


def union_transactions(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of all transactions; part k gets ``txid`` k unless it has one."""
    out = None
    for k, df in enumerate(parts):
        df = df if "txid" in df.columns else df.withColumn("txid", F.lit(k).cast("long"))
        out = df if out is None else out.unionByName(df)
    if out is None:
        raise ValueError("no transaction")
    return out


def latest_wins(records: DataFrame, by: Sequence[str] = ("key", "ts_nanos"), order: str | Sequence[Column] = "txid") -> DataFrame:
    """Of rows with equal key and time, the whole row of the highest transaction.

    With one order column and only fixed-width numbers besides, a hash aggregate
    with one maximum per column does it; else a window that keeps the first rank,
    which Spark limits before the shuffle.
    """
    rest = [c for c in records.columns if c not in by]
    numeric = all(isinstance(records.schema[c].dataType, (T.NumericType, T.BooleanType)) and not isinstance(records.schema[c].dataType, T.DecimalType) for c in rest)
    if isinstance(order, str) and numeric and rest and order in rest:
        values = [F.max(order).alias(c) if c == order else F.max_by(c, order).alias(c) for c in rest]
        return records.groupBy(*by).agg(*values).select(records.columns)
    ranking = Window.partitionBy(*by).orderBy(*([F.col(order).desc()] if isinstance(order, str) else order))
    rank = free_name(records, "rank")
    return records.withColumn(rank, F.row_number().over(ranking)).where(F.col(rank) == 1).drop(rank)


def _covers(m: dict, key: str, ts: str, txid: str) -> Column:
    """Whether one marker, as literals, covers a row."""
    out = F.col(txid) < m["txid"]
    if m["first_key"]:
        out = out & (F.col(key) >= m["first_key"])
    if m["last_key"]:
        out = out & (F.col(key) < m["last_key"])
    if m["first_ts"] is not None:
        out = out & (F.col(ts) >= m["first_ts"])
    if m["last_ts"] is not None:
        out = out & (F.col(ts) < m["last_ts"])
    if m["wildcard"] not in (None, "%"):
        out = out & F.col(key).like(like_pattern(m["wildcard"]))
    return out


def _condition(r: str, d: str) -> Column:
    """Whether a row of ``r`` is covered by a marker of ``d``; null and empty bounds are open."""
    wild = F.coalesce(F.col(f"{d}.wildcard"), F.lit("%"))
    pattern = F.replace(F.replace(wild, F.lit("\\"), F.lit("\\\\")), F.lit("_"), F.lit("\\_"))
    return (
        (F.col(f"{r}.txid") < F.col(f"{d}.txid"))
        & (F.col(f"{r}.key") >= F.coalesce(F.col(f"{d}.first_key"), F.lit("")))
        & ((F.coalesce(F.col(f"{d}.last_key"), F.lit("")) == "") | (F.col(f"{r}.key") < F.col(f"{d}.last_key")))
        & (F.col(f"{d}.first_ts").isNull() | (F.col(f"{r}.ts_nanos") >= F.col(f"{d}.first_ts")))
        & (F.col(f"{d}.last_ts").isNull() | (F.col(f"{r}.ts_nanos") < F.col(f"{d}.last_ts")))
        & ((wild == "%") | F.like(F.col(f"{r}.key"), pattern))
    )


def _zone(value: Column, bounds: list) -> Column:
    """Which of the ranges between sorted bounds a value is in, by binary search.

    The bounds are one literal, which the optimizer turns into an array, as a literal each would take seconds to build.
    """
    values = F.from_json(F.lit(json.dumps(bounds)), f"array<{'string' if isinstance(bounds[0], str) else 'bigint'}>")
    steps = F.array(*[F.lit(1 << k) for k in range(len(bounds).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda acc, s: F.when((acc + s <= len(bounds)) & (F.get(values, acc + s - 1) <= value), acc + s).otherwise(acc))


def _suppress_by_zone(records: DataFrame, markers: DataFrame, column: str, low: Column, high: Column, few: bool) -> DataFrame:
    """Anti-join in which a row meets only the markers that touch its range of ``column``; null bounds are open.

    A marker goes to all ranges that it touches. Any bounds give the right rows;
    these are evenly chosen from the markers' own (from a hash sample of them if
    there are many), so ranges hold about as many.
    """
    edges = markers.select(F.explode(F.array(low, high)).alias("b")).where("b is not null")
    if not few:
        edges = edges.distinct()
        total = edges.count()
        if total > ZONES:
            edges = edges.where(F.xxhash64("b") < F.lit(int(ZONES / total * 2**64) - 2**63))
    found = sorted({r.b for r in edges.collect()})  # 2 * BROADCAST, or about ZONES at most
    bounds = found[:: -(-len(found) // ZONES)] if found else []
    if not bounds:
        return records.alias("r").join(F.broadcast(markers).alias("d") if few else markers.alias("d"), _condition("r", "d"), "left_anti")
    first = F.when(low.isNull(), 0).otherwise(_zone(low, bounds))
    last = F.when(high.isNull(), len(bounds)).otherwise(_zone(high, bounds))
    spread = markers.withColumn("zone", F.explode(F.sequence(first, F.greatest(first, last))))
    return records.alias("r").join((F.broadcast(spread) if few else spread).alias("d"), (_zone(F.col(f"r.{column}"), bounds) == F.col("d.zone")) & _condition("r", "d"), "left_anti")


def _bounds(markers: DataFrame) -> DataFrame:
    """Markers with the key bounds ``low`` and ``high`` (null: open) that follow from their keys and the beginning of their pattern."""
    prefix = F.regexp_extract(F.coalesce("wildcard", F.lit("%")), "^[^%]*", 0)
    end = F.ascii(F.right(prefix, F.lit(1)))  # of a last character beyond ASCII no bound is made
    after = F.when((prefix != "") & (F.octet_length(F.right(prefix, F.lit(1))) == 1) & (end < 127), F.concat(F.substring(prefix, F.lit(1), F.char_length(prefix) - 1), F.char(end + 1)))
    given = [F.when(F.coalesce(c, F.lit("")) != "", F.col(c)) for c in ("first_key", "last_key")]
    return markers.withColumn("low", F.greatest(given[0], F.when(prefix != "", prefix))).withColumn("high", F.least(given[1], after))


def suppress(records: DataFrame, deletes: DataFrame) -> DataFrame:
    """Rows that no later marker covers: a theta anti-join.

    A few markers become predicates. More are split: those that bound keys (also
    by the beginning of their pattern) meet the rows of the key ranges that they
    touch, by an equal key; the others those of the time ranges that they touch.
    Up to ``BROADCAST`` markers are read once and sent to all tasks.
    """
    names = [f.name for f in DELETES]
    some = [r.asDict() for r in deletes.select(names).limit(BROADCAST + 1).collect()]
    if not some:
        return records
    if len(some) <= INLINE:
        covered = F.lit(False)
        for m in some:
            covered = covered | _covers(m, "key", "ts_nanos", "txid")
        return records.where(~covered)
    few = len(some) <= BROADCAST
    markers = _bounds(records.sparkSession.createDataFrame([tuple(m[n] for n in names) for m in some], DELETES) if few else deletes.select(names))
    keyed, rest = (markers.where(c) for c in ("low is not null or high is not null", "low is null and high is null"))
    open_ends = rest.limit(INLINE + 1).collect()
    if len(open_ends) <= INLINE:
        out = records
        for m in open_ends:
            out = out.where(~_covers(m.asDict(), "key", "ts_nanos", "txid"))
    else:
        out = _suppress_by_zone(records, rest, "ts_nanos", F.col("first_ts"), F.col("last_ts"), few)
    return out if len(open_ends) == len(some) else _suppress_by_zone(out, keyed, "key", F.col("low"), F.col("high"), few)


def resolve(records: DataFrame, deletes: DataFrame | None = None, transactions: int | None = None) -> DataFrame:
    """What a reader sees: undeleted rows, one a key and time. A single transaction needs no merge, so nothing is shuffled."""
    left = records if deletes is None else suppress(records, deletes)
    return left if transactions == 1 else latest_wins(left)
