"""SimHash fingerprints, and the search for all fingerprints within a Hamming radius.

Terms are pairs of neighbouring words (the first word is paired with the start).
A term votes on every bit of a fingerprint of ``BITS`` bits: up where its hash
has a one, down where it has a zero, with a weight that grows with the length of
its words, so that function words count for little. The bits are the votes' signs.

Two fingerprints within ``radius`` bits agree wholly on at least ``TOGETHER`` of
``radius + TOGETHER`` blocks. ``near_counts`` therefore keeps a table for each choice
of so many blocks, in which these are permuted to the front as the key; a pair is
taken from the table of the first blocks that it agrees on, so it counts once. Keys
of two blocks have 24 to 32 bits, so few fingerprints that are far meet. Equal
fingerprints are merged, with their number, before the tables are made.

One replaced word in a text of 300 to 800 words moves about 4 bits, in one of 150 to
300 words about 5: a radius of 7 has 95 % and 78 % of such copies (3 bits: 46 and 29 %).
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim, cut_lineage, kept, small

BITS = 128
#: Bits that near fingerprints may differ in, and blocks that make a table's key.
RADIUS, TOGETHER = 7, 2
#: Found fingerprints go to every task up to so many (about 100 bytes each), and meet in a sorted join beyond.
BROADCAST_ROWS = 500_000
CACHE_ENTRIES = 400_000
_words: dict[str, int] = kept("simhash")


def _mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of a 64-bit hash (its constants are splitmix64's)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _word(w: str) -> int:
    """A word's hash, its weight in the lowest four bits."""
    if len(_words) > CACHE_ENTRIES:
        _words.clear()
    h = _words[w] = (xxhash.xxh64_intdigest(w.encode()) & ~15) | min(len(w), 15)
    return h


def fingerprint(text: str) -> bytes:
    """The fingerprint as bytes; of a text without words: zeros."""
    words = text.lower().split()
    if not words:
        return bytes(BITS // 8)
    try:
        own = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    except KeyError:
        own = np.fromiter((_words.get(w) or _word(w) for w in words), np.uint64, len(words))
    before = np.empty_like(own)
    before[0] = 0
    before[1:] = own[:-1]
    low = np.uint64(15)
    weight = ((own & low) + (before & low)).astype(np.float32)
    with np.errstate(over="ignore"):
        pair = _mix(own * np.uint64(0x9E3779B97F4A7C15) + before)
        two = np.empty((len(own), 2), np.uint64)
        two[:, 0] = pair
        two[:, 1] = _mix(pair + np.uint64(0x9E3779B97F4A7C15))
    votes = np.zeros(BITS, np.float64)
    for a in range(0, len(own), 8192):  # bounded memory for very long texts
        bits = np.unpackbits(two[a : a + 8192].view(np.uint8), axis=1)
        votes += weight[a : a + 8192] @ bits.astype(np.float32)
    return np.packbits(votes * 2 > weight.sum(dtype=np.float64)).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """The cosine that the differing bits estimate, not below 0; 1 for equal fingerprints."""
    far = (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count()
    return max(0.0, float(np.cos(np.pi * far / BITS)))


def _quantile_bounds(docs: DataFrame, parts: int) -> list[int]:
    """Descending ids that cut the rows in about equal parts; at most parts - 1."""
    if parts < 2:
        return []
    shares = [k / parts for k in range(1, parts)]
    got = docs.agg(F.percentile_approx("doc_id", shares, 10_000).alias("q")).first().q or []
    return sorted(set(got), reverse=True)


def _part(doc_id: Column, bounds: list[int]) -> Column:
    """How many bounds are at or above the id, by binary search."""
    if not bounds:
        return F.lit(0)
    values = F.array(*map(F.lit, bounds))
    steps = F.array(*[F.lit(1 << k) for k in range(len(bounds).bit_length() - 1, -1, -1)])

    def step(acc: Column, s: Column) -> Column:
        return F.when((acc + s <= len(bounds)) & (F.get(values, acc + s - 1) >= doc_id), acc + s).otherwise(acc)

    return F.when(doc_id.isNull(), F.lit(len(bounds))).otherwise(F.aggregate(steps, F.lit(0), step))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows in runs: ``part``, ``copy``, ``doc_id``, ``text``, each part in descending order of id.

    Each part ends with a copy of the first row of the next part (the last part:
    of the first), so that a task sees every row's successor. The text moves once.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = _quantile_bounds(docs.select("doc_id"), parts)
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _part(F.col("doc_id"), bounds).alias("part"))
    heads = {r.part: r.head for r in keyed.groupBy("part").agg(F.max("doc_id").alias("head")).collect()}  # a row a part
    order = sorted(heads)
    before = {p: order[k - 1] for k, p in enumerate(order)}
    top = max(order, default=0) + 1
    head = F.get(F.array(*[F.lit(heads.get(p)).cast("long") for p in range(top)]), F.col("part"))
    prior = F.get(F.array(*[F.lit(before.get(p)).cast("int") for p in range(top)]), F.col("part"))
    also = F.when(F.col("doc_id").eqNullSafe(head), F.array("part", prior)).otherwise(F.array("part"))
    spread = keyed.select("doc_id", "text", F.posexplode(also).alias("copy", "part"))
    return spread.repartitionById(parts, "part").sortWithinPartitions("part", "copy", F.desc_nulls_last("doc_id"), "text")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("simhash")
    held: tuple | None = None  # part, id, text, fingerprint of the row that waits for its successor
    for batch in small(batches):
        out: list[tuple] = []
        for part, copy, doc_id, text in zip(*[c.to_pylist() for c in batch.columns]):
            if held is None and copy:
                continue  # only the first of equal ids is the successor
            own = fingerprint(text)
            if held is not None and held[0] == part:
                _, i, t, f = held
                half = len(t) // 2
                edited = t[: len(t) - half] + text[:half]
                e = fingerprint(edited)
                out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), f.hex(), e.hex(), likeness(f, e), likeness(f, own)))
            held = None if copy else (part, doc_id, text, own)
        if out:
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), *[pa.array(c, pa.string()) for c in columns[2:5]], *[pa.array(c, pa.float64()) for c in columns[5:]]],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document with its fingerprint, that of its edited text, and their likeness.

    Documents follow each other in descending ``doc_id``, equal ids in the order
    of their texts; the last is followed by the first, and a lone one by itself.
    A null text counts as empty; its fingerprint is zero. An empty table gives no row.
    """
    return with_next(docs.select("doc_id", "text")).select("part", "copy", "doc_id", "text").mapInArrow(_rows, SCHEMA)


def _blocks(radius: int) -> list[tuple[int, int]]:
    """First hex digit (from 1) and number of digits of each of ``radius + TOGETHER`` blocks."""
    n, digits = radius + TOGETHER, BITS // 4
    edges = [digits * k // n for k in range(n + 1)]
    return [(a + 1, b - a) for a, b in zip(edges, edges[1:])]


def near_counts(rows: DataFrame, queries: Column, radius: int = RADIUS) -> DataFrame:
    """For the fingerprints of the rows that ``queries`` selects, how many rows lie within ``radius`` bits.

    ``rows`` has ``fingerprint`` as 32 hex digits. Gives ``fingerprint`` and
    ``n_near``, the rows with the very same fingerprint included.
    """
    names = ("hi", "lo")
    halves = [F.conv(F.substring("fingerprint", 1 + 16 * k, 16), 16, -10).cast("long").alias(n) for k, n in enumerate(names)]
    merged = cut_lineage(rows.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.max(queries.cast("int")).alias("asked")).select("fingerprint", "n", "asked", *halves))
    blocks = _blocks(radius)
    choices = list(itertools.combinations(range(len(blocks)), TOGETHER))

    def tables(df: DataFrame) -> DataFrame:
        keys = [F.concat(*[F.substring("fingerprint", *blocks[k]) for k in chosen]) for chosen in choices]
        return df.select("*", F.posexplode(F.array(*keys)).alias("t", "key"))

    asked = merged.where("asked = 1").select("fingerprint", *names)
    few = asked.count() * len(choices) <= BROADCAST_ROWS
    asked = tables(asked)
    far = sum((F.bit_count(F.col(f"a.{n}").bitwiseXOR(F.col(f"b.{n}"))) for n in names), F.lit(0))
    same = [(F.substring("a.fingerprint", *x) == F.substring("b.fingerprint", *x)).cast("int") for x in blocks]
    first = F.lit(False)  # the table's blocks are the first that the two agree on
    for t, chosen in enumerate(choices):
        first = first | ((F.col("a.t") == t) & (sum(same[: chosen[-1] + 1], F.lit(0)) == TOGETHER))
    met = (F.col("a.t") == F.col("b.t")) & (F.col("a.key") == F.col("b.key")) & (far <= radius) & first
    pairs = tables(merged.drop("asked")).alias("b").join((F.broadcast(asked) if few else asked).alias("a"), met)
    return pairs.groupBy("a.fingerprint").agg(F.sum("n").alias("n_near"))


def simhash(docs: DataFrame, radius: int = RADIUS, one_in: int = 50) -> DataFrame:
    """``fingerprints``, and for every ``one_in``-th id ``n_near``: how many rows lie within ``radius`` bits of it."""
    rows = cut_lineage(fingerprints(docs))
    asked = F.coalesce(F.col("doc_id") % one_in == 0, F.lit(False))
    near = cut_lineage(near_counts(rows, asked, radius).withColumn("asked", F.lit(True)))
    few = near.count() <= BROADCAST_ROWS
    found = rows.withColumn("asked", asked).join(F.broadcast(near) if few else near, ["fingerprint", "asked"], "left")
    return found.select(*[c.split()[0] for c in SCHEMA.split(", ")], "n_near")
