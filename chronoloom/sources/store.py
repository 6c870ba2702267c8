"""A database: immutable Parquet transactions and a versioned manifest.

Layout: ``_log/<version>.json`` lists the transactions of a version and the
deletion markers; ``data/tx-<seq>-<uuid>`` holds one transaction's files.
Precedence is ``seq``: 0 is the compacted main data. A version is made by
creating its file where none may exist yet, so of two writers one retries. A
reader holds the list of one version; later commits do not change what it sees,
and ``vacuum`` removes files only after a while. All files go through Hadoop's
file system interface, so any shared store serves.
"""

from __future__ import annotations

import json
import random
import time
import uuid
import warnings
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.formats import RECORD, infer_format, pack_columns, wide_schema
from ..functions.predicates import MOST_NANOS, free_name, key_range, nanos_of, parse_time, time_range, wildcard
from ..operators.keys import by_key
from ..operators.merge import DELETES, latest_wins, suppress

#: Columns of a stored record, in order.
COLUMNS = [f.name for f in RECORD]
#: A writer that has claimed a version and made nothing of it for so many seconds is taken for dead.
CLAIM_SECONDS = 60.0
#: Bytes that are handed to the JVM at once, about.
PIECE = 1 << 20


class CommitConflict(RuntimeError):
    """Another writer made the version first."""


class Files:
    """The few file operations that a database needs."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(root).getFileSystem(self._conf)
        self.root = root.rstrip("/")

    def at(self, name: str):
        return self._path(f"{self.root}/{name}")

    def names(self, folder: str) -> list[str]:
        path = self.at(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def exists(self, name: str) -> bool:
        return self._fs.exists(self.at(name))

    def read(self, name: str) -> str:
        stream = self._fs.open(self.at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, chunks: Iterable[bytes]) -> None:
        """A new file of the chunks, as they come, which go over in pieces: each call of the JVM takes its time."""
        out = self._fs.create(self.at(name), False)
        try:
            piece = bytearray()
            for chunk in chunks:
                for a in range(0, len(chunk), PIECE):
                    piece += chunk[a : a + PIECE]
                    if len(piece) >= PIECE:
                        out.write(piece)
                        piece = bytearray()
            if piece:
                out.write(piece)
        finally:
            out.close()

    def create(self, name: str, text: str) -> None:
        """A file that must not exist yet, whole or not at all.

        Writers of a name take turns by claims, small files that are numbered and
        made where none is. Who makes one may write; if nothing comes of the newest
        claim in time, its writer is taken for dead and the next number is free.
        Claims go when the file is there, so a crash at any step stops nobody.
        """
        target = self.at(name)
        folder, _, own = name.rpartition("/")
        if self._fs.exists(target):
            raise CommitConflict(name)
        claims = self._claims(folder, own)
        if claims and self.age(f"{folder}/{own}.claim-{claims[-1]:06d}") < CLAIM_SECONDS:
            raise CommitConflict(name)
        number = claims[-1] + 1 if claims else 0
        mine, token = f"{folder}/{own}.claim-{number:06d}", uuid.uuid4().hex
        try:
            self.write(mine, [token.encode()])  # fails where another writer has it
        except Exception as e:
            raise CommitConflict(name) from e
        draft = f"{folder}/.{uuid.uuid4().hex}.tmp"
        try:
            self.write(draft, [text.encode()])
            if self._fs.exists(target) or self._claims(folder, own)[-1:] != [number] or self.read(mine) != token or not self._fs.rename(self.at(draft), target):
                raise CommitConflict(name)
            for k in claims:
                self.delete(f"{folder}/{own}.claim-{k:06d}")
        finally:
            self.delete(draft)
            self.delete(mine)

    def _claims(self, folder: str, own: str) -> list[int]:
        start = f"{own}.claim-"
        return [int(n[len(start) :]) for n in self.names(folder) if n.startswith(start)]

    def lock(self, name: str, token: str, stale: float) -> bool:
        """Take a lock file. One that is older than ``stale`` seconds is moved away first, which of several only one can do."""
        if self.exists(name):
            found = self.read(name)
            if self.age(name) < stale:
                return False
            aside = f"{name}.{uuid.uuid4().hex}"
            try:
                moved = self._fs.rename(self.at(name), self.at(aside))
                fresh = moved and self.read(aside) != found  # another one has moved the stale lock and made this one meanwhile
                if fresh:
                    self._fs.rename(self.at(aside), self.at(name))
                elif moved:
                    self.delete(aside)
            except Exception:
                return False
            if fresh or not moved:
                return False
        try:
            self.write(name, [token.encode()])
        except Exception:
            return False
        return True

    def unlock(self, name: str, token: str) -> None:
        """Give back a lock, if it is still one's own."""
        if self.exists(name) and self.read(name) == token:
            self.delete(name)

    def move(self, source: str, target: str) -> None:
        self._fs.mkdirs(self.at(target).getParent())
        if not self._fs.rename(self.at(source), self.at(target)):
            raise OSError(f"cannot move {source} to {target}")

    def delete(self, name: str) -> None:
        self._fs.delete(self.at(name), True)

    def age(self, name: str) -> float:
        return time.time() - self._fs.getFileStatus(self.at(name)).getModificationTime() / 1000

    def row_groups(self, name: str) -> list[tuple]:
        """Number, records, compressed and plain bytes, first and last key of a Parquet file's row groups, from its footer."""
        parquet = self._jvm.org.apache.parquet.hadoop
        reader = parquet.ParquetFileReader.open(parquet.util.HadoopInputFile.fromPath(self.at(name), self._conf))
        try:
            out = []
            for k, block in enumerate(reader.getFooter().getBlocks()):
                key = next(c for c in block.getColumns() if c.getPath().toDotString() == "key").getStatistics()
                bounds = [v.toStringUsingUTF8() for v in (key.genericGetMin(), key.genericGetMax())] if key is not None and key.hasNonNullValue() else ["", "\U0010ffff"]
                out.append((k, block.getRowCount(), block.getCompressedSize(), block.getTotalByteSize(), *bounds))
            return out
        finally:
            reader.close()

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self.at(name)).getLength()


@dataclass(frozen=True)
class Snapshot:
    """One version of a database."""

    spark: SparkSession
    root: str
    version: int
    data: tuple[dict, ...]
    deletes: tuple[dict, ...]

    @property
    def transactions(self) -> int:
        return len(self.data)

    def transaction_paths(self) -> list[str]:
        return [d["path"] for d in self.data]

    def delete_markers(self) -> list[dict]:
        return list(self.deletes)

    def empty_transactions(self) -> list[str]:
        """Transactions whose files have gone to nothing; a reader passes over them with a warning."""
        files = Files(self.spark, self.root)
        there = set(files.names("data"))
        return [d["path"] for d in self.data if d["path"].rpartition("/")[2] not in there or files.size(d["path"]) == 0]

    def without_main(self, most: int | None = None) -> Snapshot:
        """Only transactions above main; with ``most``, the first so many of them."""
        some = tuple(d for d in self.data if d["seq"] > 0)[:most]
        return Snapshot(self.spark, self.root, self.version, some, self.deletes)

    def records_of(self, entries: tuple[dict, ...]) -> DataFrame:
        """Stored rows with ``txid``, which comes from the path, so one scan reads all transactions."""
        if not entries:
            return self.spark.createDataFrame([], RECORD).withColumn("txid", F.lit(0).cast("long"))
        df = self.spark.read.schema(RECORD).parquet(*[f"{self.root}/{d['path']}" for d in entries])
        # of ``.../tx-<number>-<uuid>/<file>``; cut out, as a regular expression would cost more than the rest of the row
        folder = F.substring_index(F.col("_metadata.file_path"), "/", -2)
        return df.withColumn("txid", F.substring(F.substring_index(folder, "-", 2), F.lit(4), F.lit(20)).cast("long"))

    def all_records(self) -> DataFrame:
        return self.records_of(self.data)

    def transaction(self, number: int) -> DataFrame | dict:
        """What one transaction holds: its records, or the marker that it is."""
        for d in self.deletes:
            if d["txid"] == number:
                return dict(d)
        found = tuple(d for d in self.data if d["seq"] == number)
        if not found:
            raise KeyError(number)
        return self.records_of(found)

    def delete_rows(self) -> DataFrame:
        return self.spark.createDataFrame([tuple(d.get(f.name) for f in DELETES) for d in self.deletes], DELETES)

    def resolved(self, dealt: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """One record a key and time, deleted ones gone. Selections that follow reach the scan.

        ``dealt`` puts the stored rows of a key in one partition; the merge then moves none.
        """
        rows = self.all_records()
        if self.deletes:
            rows = suppress(rows, self.delete_rows())
        if dealt is not None:
            rows = dealt(rows)
        return (rows if self.transactions <= 1 else latest_wins(rows)).select(COLUMNS)

    # selections

    def get(self, key: str) -> DataFrame:
        return self.resolved().where(F.col("key") == key)

    def get_range(self, lower: str | None = None, upper: str | None = None, include_lower: bool = True, include_upper: bool = False, dealt: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        return self.resolved(dealt).where(key_range(lower, upper, include_lower, include_upper))

    def get_filter(self, pattern: str, dealt: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        return self.resolved(dealt).where(wildcard(pattern))

    def get_range_keys(self, lower: str | None = None, upper: str | None = None, **more: bool) -> DataFrame:
        return by_key(self.get_range(lower, upper, **more))

    def get_filter_keys(self, pattern: str) -> DataFrame:
        return by_key(self.get_filter(pattern))

    def read(self, pattern: str | None = None, after_key: str | None = None, before_key: str | None = None, after_time: str | int | None = None, before_time: str | int | None = None, dealt: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """By pattern or by key bounds, not both and not neither; with times besides. ``dealt``: see ``resolved``."""
        bounds = after_key is not None or before_key is not None
        if (pattern is not None) == bounds:
            raise ValueError("give either a pattern or bounds of keys")
        a, b = (parse_time(t) if isinstance(t, str) else t for t in (after_time, before_time))
        rows = self.get_filter(pattern, dealt) if pattern is not None else self.get_range(after_key, before_key, dealt=dealt)
        return rows.where(time_range(a, b))

    def size_on_disk(self, lower: str | None = None, upper: str | None = None) -> DataFrame:
        """Files with their sizes and number of rows, by transaction; with bounds of keys, what of each row groups hold that reach into ``lower <= key < upper``.

        From the files' footers alone.
        """
        groups = self.row_groups()
        touched = F.lit(True)
        if lower is not None:
            touched = touched & (F.col("last_key") >= lower)
        if upper is not None:
            touched = touched & (F.col("first_key") < upper)
        return groups.where(touched).groupBy("txid", "file").agg(F.sum("bytes").alias("bytes"), F.sum("records").alias("records"))

    def row_groups(self) -> DataFrame:
        """Each file's row groups: transaction, file, number, records, compressed and plain bytes, first and last key.

        Where a file has no statistics of keys, or only shortened ones, the bounds are wide enough all the same.
        """
        files = Files(self.spark, self.root)
        named = [(d["seq"], f"{d['path']}/{n}") for d in self.data for n in files.names(d["path"]) if n.endswith(".parquet")]
        with ThreadPoolExecutor(16) as pool:
            rows = [(seq, name.rpartition("/")[2], *g) for (seq, name), found in zip(named, pool.map(lambda x: files.row_groups(x[1]), named)) for g in found]
        return self.spark.createDataFrame(rows, "txid long, file string, number int, records long, bytes long, plain_bytes long, first_key string, last_key string")


class Database:
    """A folder of transactions."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, self.root)

    def _versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names("_log") if n.endswith(".json")]

    def _manifest(self) -> tuple[int, dict]:
        versions = self._versions()
        if not versions:
            return 0, {"data": [], "deletes": [], "next": 1, "batches": {}}
        return versions[-1], json.loads(self.files.read(f"_log/{versions[-1]:016d}.json"))

    def snapshot(self, attempts: int = 5) -> Snapshot:
        """The newest version. If its files vanish meanwhile, it is superseded, and the next is read."""
        for left in range(attempts, 0, -1):
            version, m = self._manifest()
            there = set(self.files.names("data"))
            gone = [d["path"] for d in m["data"] if d["path"].rpartition("/")[2] not in there]
            if not gone or version == self._manifest()[0]:
                if gone:
                    warnings.warn(f"transactions without files are passed over: {gone}", stacklevel=2)
                found = tuple(d for d in m["data"] if d["path"] not in gone)
                return Snapshot(self.spark, self.root, version, found, tuple(m["deletes"]))
        raise OSError(f"no stable version of {self.root}")

    def commit(self, change, patience: float | None = None) -> int:
        """Apply ``change`` to the newest manifest and make it the next version; again if another writer was faster.

        Gives up after ``patience`` seconds, by default after twice the time in which a dead writer's claim runs out.
        """
        end, wait = time.time() + (2 * CLAIM_SECONDS + 5 if patience is None else patience), 0.05
        while time.time() < end:
            version, m = self._manifest()
            new = change(json.loads(json.dumps(m)))
            if new is None:
                return version
            try:
                self.files.create(f"_log/{version + 1:016d}.json", json.dumps(new))
                return version + 1
            except CommitConflict:
                time.sleep(wait * (0.5 + random.random()))
                wait = min(1.0, wait * 1.2)
        raise CommitConflict(f"{self.root} is too busy")

    def transaction(self) -> Transaction:
        return Transaction(self)

    def add(self, records: DataFrame, batch: tuple[str, int] | None = None) -> int | None:
        """Commit records as one transaction; see ``Transaction``."""
        tx = self.transaction()
        try:
            tx.add(records)
            return tx.commit(batch=batch)
        except BaseException:
            tx.rollback()
            raise

    def delete(self, pattern: str | None = None, after_key: str | None = None, before_key: str | None = None, after_time: str | int | None = None, before_time: str | int | None = None, time: str | int | None = None) -> int:
        """Delete what older transactions hold in a range of keys and times that match a pattern; at least one must be given."""
        given = (pattern, after_key, before_key, after_time, before_time, time)
        if all(x is None for x in given):
            raise ValueError("say what to delete")
        if time is not None and (after_time is not None or before_time is not None):
            raise ValueError("give either a time or bounds of times")
        at, a, b = (parse_time(t) if isinstance(t, str) else t for t in (time, after_time, before_time))
        if at is not None:
            a, b = at, at + 1
        marker = {"first_key": after_key or "", "last_key": before_key or "", "first_ts": a, "last_ts": b, "wildcard": pattern or "%"}

        def change(m: dict) -> dict:
            m["deletes"].append(marker | {"txid": m["next"]})
            m["next"] += 1
            return m

        return self.commit(change)

    def vacuum(self, older_than: float = 3600) -> list[str]:
        """Remove files that no version but old ones names, if they are older than so many seconds."""
        _, m = self._manifest()
        used = {d["path"] for d in m["data"]}
        gone = [f"{top}/{n}" for top in ("data", "_staging") for n in self.files.names(top)]
        gone = [p for p in gone if p not in used and self.files.age(p) >= older_than]
        for p in gone:
            self.files.delete(p)
        return gone


class Transaction:
    """Records that become visible together.

    Rows of a transaction must differ in key or time. Written files are sorted by
    key and time in ranges of keys, so that selections of keys skip row groups.
    """

    def __init__(self, db: Database):
        self.db = db
        self.staging = f"_staging/{uuid.uuid4().hex}"
        self.parts: list[tuple[DataFrame, list[Column]]] = []  # rows with key and time, and what makes records of them
        self.done = False

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None and not self.done:
            self.commit()
        else:
            self.rollback()

    def add(self, records: DataFrame) -> Transaction:
        """Rows of the stored schema: ``key, ts_nanos, fmt, cols``."""
        self.parts.append((records.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in RECORD]), [F.col(n) for n in COLUMNS]))
        return self

    def add_typed(self, df: DataFrame, key: str = "key", time: str = "ts_nanos") -> Transaction:
        """Typed columns beside key and time; the format follows from their types."""
        values = [f for f in df.schema if f.name not in (key, time)]
        fmt = infer_format(type(df.schema)(values))
        stamp = F.col(time) if df.schema[time].dataType.typeName() == "long" else nanos_of(time)
        named = [f"v{n}" for n in range(1, len(values) + 1)]
        rows = df.select(F.col(key).cast("string").alias("key"), stamp.alias("ts_nanos"), *[F.col(f.name).alias(n) for f, n in zip(values, named)])
        self.parts.append((rows, [F.col("key"), F.col("ts_nanos"), F.lit(fmt).alias("fmt"), pack_columns(fmt, *map(F.col, named)).alias("cols")]))
        return self

    def add_rows(self, fmt: str, rows: Iterable[tuple]) -> Transaction:
        """Python rows ``(key, nanoseconds, value, ...)`` of one format, for small transactions."""
        fields = [T.StructField("key", T.StringType()), T.StructField("ts_nanos", T.LongType()), *wide_schema(fmt)]
        df = self.db.spark.createDataFrame([tuple(r) for r in rows], T.StructType(fields))
        return self.add(df.select("key", "ts_nanos", F.lit(fmt).alias("fmt"), pack_columns(fmt, *[F.col(f.name) for f in fields[2:]]).alias("cols")))

    def rollback(self) -> None:
        if not self.done:
            self.db.files.delete(self.staging)

    def commit(self, batch: tuple[str, int] | None = None) -> int | None:
        """The transaction's number, or None if it has no rows (or the batch is committed already)."""
        if not self.parts or (batch and self._known(self.db._manifest()[1], batch)):
            return None
        kinds = [F.col(f.name).cast(f.dataType).alias(f.name) for f in RECORD]
        df, record = self.parts[0]
        if len(self.parts) > 1:
            df, record = df.select(record).select(kinds), kinds
            for other, columns in self.parts[1:]:
                df = df.unionByName(other.select(columns).select(kinds))
        checked = (
            F.when(F.col("key").isNull() | F.col("fmt").isNull() | F.col("cols").isNull(), F.raise_error(F.lit("a record lacks its key, format or columns")).cast("long"))
            .when(~F.coalesce(F.col("ts_nanos").between(0, MOST_NANOS), F.lit(False)), F.raise_error(F.concat(F.lit("timestamp out of range at key "), F.col("key"))).cast("long"))
            .when(F.size("cols") != F.length("fmt"), F.raise_error(F.concat(F.lit("record does not match its format "), F.col("fmt"), F.lit(" at key "), F.col("key"))).cast("long"))
            .otherwise(F.col("ts_nanos"))
        )
        # values are packed after the shuffle, as packed ones are many times wider; a key lies in one partition, sorted
        # by time, so repeated times are neighbours, and are found while the files are written
        placed = df.repartitionByRange("key").sortWithinPartitions("key", "ts_nanos")
        before = F.lag("ts_nanos").over(Window.partitionBy("key").orderBy("ts_nanos"))
        twice = free_name(df, "twice")
        seen = Observation()
        rows = placed.withColumn(twice, before == F.col("ts_nanos")).observe(seen, F.count(F.lit(1)).alias("n"), F.min(F.when(F.col(twice), F.struct("key", "ts_nanos"))).alias("twice"))
        rows.select(record).select(kinds).withColumn("ts_nanos", checked).write.parquet(f"{self.db.root}/{self.staging}")
        found = seen.get
        if found["twice"]:
            self.rollback()
            raise ValueError(f"two records at key {found['twice'].key!r} and time {found['twice'].ts_nanos} in one transaction")
        if not found["n"]:
            self.rollback()
            self.done = True
            return None
        number: list[int] = []
        where = [self.staging]

        def change(m: dict) -> dict | None:
            if batch and self._known(m, batch):
                return None
            seq = m["next"]
            path = f"data/tx-{seq:012d}-{uuid.uuid4().hex}"
            self.db.files.move(where[0], path)
            where[0] = path
            m["data"].append({"path": path, "seq": seq})
            m["next"] = seq + 1
            if batch:
                m.setdefault("batches", {})[batch[0]] = batch[1]
            number[:] = [seq]
            return m

        self.db.commit(change)
        self.done = True
        return number[0] if number else None

    @staticmethod
    def _known(m: dict, batch: tuple[str, int]) -> bool:
        return m.get("batches", {}).get(batch[0], -1) >= batch[1]


def check_order(rows: DataFrame, position: str) -> None:
    """Raise if rows, in the order of ``position``, fall back in key, or do not rise in time within a key.

    Neighbours are found by a window within ranges of positions, and the ranges'
    ends, a row each, are compared on the driver.
    """
    parts = rows.select(F.col(position).alias("p"), "key", "ts_nanos").repartitionByRange("p").withColumn("part", F.spark_partition_id())
    w = Window.partitionBy("part").orderBy("p")
    lagged = parts.withColumn("k0", F.lag("key").over(w)).withColumn("t0", F.lag("ts_nanos").over(w))
    bad = lagged.where("k0 > key or (k0 = key and t0 >= ts_nanos)").limit(1).collect()
    ends = parts.groupBy("part").agg(F.min(F.struct("p", "key", "ts_nanos")).alias("a"), F.max(F.struct("p", "key", "ts_nanos")).alias("b")).collect()
    ends.sort(key=lambda r: r.a.p)
    for x, y in zip(ends, ends[1:]):
        if (x.b.key.encode(), x.b.ts_nanos) >= (y.a.key.encode(), y.a.ts_nanos):
            bad = [y.a]
    if bad:
        raise ValueError(f"records are not in order at key {bad[0].key!r}, time {bad[0].ts_nanos}")


