"""Compaction: merge transactions, drop what is deleted, transform on the way."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formats import RECORD
from ..functions.text import parse_lines, renderer
from ..operators.keys import partition_by_key, pipe
from ..operators.merge import latest_wins, suppress
from .store import COLUMNS, Database


class Busy(RuntimeError):
    """Another compaction holds the lock."""


def compact(db: Database, major: bool = False, transform: Callable[[DataFrame], DataFrame] | None = None, command: str | None = None, time_format: str | None = None, stale_lock: float = 86_400) -> int | None:
    """Merge a database's transactions; the new version's number, or None if there was nothing to do.

    Major: everything becomes main data (number 0), and the deletion markers that
    it has applied go. Minor: transactions above main become one with the highest
    number among them; markers stay, as main may hold what they cover. Readers
    and writers go on meanwhile; transactions committed meanwhile are kept.

    ``transform`` maps the merged records to others; ``command`` does so as a shell
    filter over lines ``key \\t time \\t format \\t values`` per range of keys.
    """
    lock, token = "_log/compact.lock", uuid.uuid4().hex
    if not db.files.lock(lock, token, stale_lock):
        raise Busy(db.root)
    try:
        return _compact(db, major, transform, command, time_format)
    finally:
        db.files.unlock(lock, token)


def _compact(db: Database, major: bool, transform, command: str | None, time_format: str | None) -> int | None:
    whole = db.snapshot()
    snapshot = whole if major else whole.without_main()
    if not snapshot.data or (not major and snapshot.transactions <= 1 and transform is None and command is None):
        if not (major and whole.deletes):
            return None
    rows = snapshot.all_records()
    if snapshot.deletes:
        rows = suppress(rows, snapshot.delete_rows())
    rows = (latest_wins(rows) if snapshot.transactions > 1 else rows).select(COLUMNS)
    if transform is not None:
        rows = transform(rows)
    seq = 0 if major else max(d["seq"] for d in snapshot.data)
    path, staging = f"data/tx-{seq:012d}-{uuid.uuid4().hex}", f"_staging/{uuid.uuid4().hex}"
    try:
        if command is not None:
            lines = pipe(partition_by_key(rows), command, renderer(time_format or "nanos", show_format=True))
            # the command runs once: finding the ranges of the keys that it gives would run it once more
            parse_lines(lines, None, time_format).write.parquet(f"{db.root}/{staging}")
            passed = db.spark.read.schema(RECORD).parquet(f"{db.root}/{staging}")
            if passed.isEmpty() and not rows.isEmpty():
                raise ValueError("the command lets nothing through; delete the records instead")
            rows = passed
        partition_by_key(rows.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in RECORD])).write.parquet(f"{db.root}/{path}")
    finally:
        db.files.delete(staging)
    merged = {d["path"] for d in snapshot.data}
    applied = {d["txid"] for d in snapshot.deletes}

    def change(m: dict) -> dict:
        m["data"] = sorted([d for d in m["data"] if d["path"] not in merged] + [{"path": path, "seq": seq}], key=lambda d: d["seq"])
        if major:
            m["deletes"] = [d for d in m["deletes"] if d["txid"] not in applied]
        return m

    return db.commit(change)
