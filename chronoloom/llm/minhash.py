"""MinHash near-duplicates: one-permutation hashing, banded buckets, star-shaped candidates.

A text's word shingles are hashed once; the top bits of a hash name its bin, and
each bin keeps its lowest hash. Empty bins borrow by optimal densification. Bands
of bins are bucket keys. ``near_duplicates`` tells how buckets become links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, cut_lineage, kept, small
from .components import components

#: Bins of the one permutation, and the bands that they are cut in.
BINS, BANDS = 128, 32
CACHE_ENTRIES = 250_000
_words: dict[bytes, int] = kept("minhash")
_A = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of a 64-bit hash (its constants are splitmix64's)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _word(w: bytes) -> int:
    if len(_words) > CACHE_ENTRIES:
        _words.clear()
    h = _words[w] = xxhash.xxh64_intdigest(w)
    return h


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles.

    Words are runs of other than ASCII white space, A-Z in lower case. A text of
    fewer words than ``size`` is one shingle; without words there is none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    try:
        own = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    except KeyError:
        own = np.fromiter((_words.get(w) or _word(w) for w in words), np.uint64, len(words))
    n = min(size, len(own))
    with np.errstate(over="ignore"):
        h = np.full(len(own) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h + own[k : len(own) - n + 1 + k]) * _A
            h ^= h >> np.uint64(29)
        return np.unique(mix(h))


def _probes() -> np.ndarray:
    """Where an empty bin looks at each attempt: a hash of bin and attempt."""
    with np.errstate(over="ignore"):
        return (mix(np.arange(1, 64 * BINS + 1, dtype=np.uint64) * _A) % np.uint64(BINS)).astype(np.int64).reshape(64, BINS)


PROBES = _probes()


def signature(found: np.ndarray) -> np.ndarray:
    """Lowest hash of each bin; an empty bin takes that of the first full bin that its own probes meet.

    A bin is the top bits of a hash. That densification draws donors uniformly and
    independently for each bin, and alike for all texts.
    """
    top = (found >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.append(True, top[1:] != top[:-1]))
    out = np.zeros(BINS, np.uint64)
    full = np.zeros(BINS, bool)
    out[top[first]] = found[first]
    full[top[first]] = True
    todo = np.flatnonzero(~full)
    attempt = 0
    while len(todo):
        if attempt < len(PROBES):
            donor = PROBES[attempt, todo]
        else:  # hardly any bin is full
            with np.errstate(over="ignore"):
                donor = (mix((todo + attempt * BINS + 1).astype(np.uint64) * _A) % np.uint64(BINS)).astype(np.int64)
        ok = full[donor]
        out[todo[ok]] = out[donor[ok]]
        todo = todo[~ok]
        attempt += 1
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; the band is part of the key."""
    with np.errstate(over="ignore"):
        rows = sig.reshape(BANDS, -1)
        key = np.arange(1, BANDS + 1, dtype=np.uint64) * _A
        for k in range(rows.shape[1]):
            key = mix(key * _A + rows[:, k])
        return key


def _digest(found: np.ndarray) -> tuple[int, int]:
    """Two numbers that are equal for equal sets."""
    with np.errstate(over="ignore"):
        one, two = found.sum(dtype=np.uint64), mix(found * _A).sum(dtype=np.uint64)
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("minhash")
        for batch in small(batches):
            n, one, two, keys = [], [], [], []
            for t in batch.column(1).to_pylist():
                found = shingles(t, size)
                a, b = _digest(found)
                n.append(len(found))
                one.append(a)
                two.append(b)
                keys.append(band_keys(signature(found)).view(np.int64).tolist() if len(found) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n", "h1", "h2", "keys"])

    return run


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, in whole numbers."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(size: int, percent: int):
    """Keeps the candidates (c, m, text of c, text of m) whose full sets are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("minhash")
        center, own = None, None
        for batch in small(batches):
            kept = []
            for c, m, ct, mt in zip(*[x.to_pylist() for x in batch.columns]):
                if own is None or ct != center:
                    center, own = ct, shingles(ct, size)
                if alike(own, shingles(mt, size), percent):
                    kept.append((c, m))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in kept], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


#: A semi-join sends its ids to every task up to so many (about 100 bytes each there), and sorts both sides beyond.
BROADCAST_IDS = 500_000


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is among ``ids`` (distinct, in shared storage); texts that go are not shuffled."""
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def _confirmed(edges: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) of the candidate edges (c, m), on the full sets of the documents' whole texts."""
    members = edges.join(texts.select(F.col("doc_id").alias("m"), F.col("text").alias("mt")), "m")
    both = members.join(texts.select(F.col("doc_id").alias("c"), F.col("text").alias("ct")), "c")
    return both.select("c", "m", "ct", "mt").mapInArrow(_confirm(size, percent), "a long, b long")


def _short_sets(size: int):
    """Each text's set, its hashes cut to 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("minhash")
        for batch in small(batches):
            sets = [np.unique(shingles(t, size).astype(np.uint32)).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["doc_id", "short"])

    return run


def _across(percent: int, slack: float = 0.5):
    """Of a bucket, a block of those outside its main component against a block of all: alike documents of different components.

    One sure pair per two components is enough; pairs so close to the threshold
    that shortened hashes could decide are all given, to be confirmed.
    """

    def run(table: pa.Table) -> pa.Table:
        docs, comp = (np.asarray(table.column(c).to_pylist(), np.int64) for c in ("doc_id", "component"))
        keys = np.asarray(table.column("keys").to_pylist(), np.int64)
        asks, outside = (np.asarray(table.column(c).to_pylist(), bool) for c in ("asks", "outside"))
        sets = [np.frombuffer(s, np.uint32) for s in table.column("short").to_pylist()]
        band = int(np.flatnonzero(keys[0] == table.column("key")[0].as_py())[0])
        size = np.asarray([len(s) for s in sets])
        joined = np.concatenate(sets)
        starts = np.cumsum(size) - size
        out = []
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (p := root.get(x, x)) != x:
                root[x] = root.get(p, p)
                x = p
            return x

        for a in np.flatnonzero(asks):
            # not of one component, asked from one side only, near in size, and first met in this band
            others = np.flatnonzero(~asks & (comp != comp[a]) & (~outside | (docs > docs[a])) & (100 * np.minimum(size, size[a]) >= (percent - slack) * np.maximum(size, size[a])))
            if band and len(others):
                others = others[~(keys[others, :band] == keys[a, :band]).any(axis=1)]
            others = others[[find(int(comp[b])) != find(int(comp[a])) for b in others]] if len(others) and root else others
            if not len(others):
                continue
            at = np.concatenate([np.arange(starts[b], starts[b] + size[b]) for b in others])
            hit = np.searchsorted(sets[a], joined[at])
            same = sets[a][np.minimum(hit, size[a] - 1)] == joined[at]
            both = np.add.reduceat(same, np.cumsum(size[others]) - size[others])
            for b, n in zip(others, both):
                union = size[a] + size[b] - n
                if 100 * n >= (percent - slack) * union and find(int(comp[a])) != find(int(comp[b])):
                    out.append((docs[a], docs[b]))
                    if 100 * n >= (percent + slack) * union:  # surely a link, so more between the two components are not needed
                        root[find(int(comp[a]))] = find(int(comp[b]))
        return pa.table([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["c", "m"])

    return run


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, block: int = 512) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Documents are linked when 100 * |intersection| >= percent * |union| of their
    sets of word shingles. ``component_id`` is the least id that links lead to;
    ``kept`` tells the document that has it. Documents without words (null or
    empty texts too) link with nothing; a row without id gets no component and is
    not kept. Repeated rows each give a row; other columns are ignored.

    1. Documents with equal sets are one from here on (the least id stands for them).
    2. One permutation hashing and bands give each 32 keys. With 4 bins a band, two
       documents at the threshold of 0.8 meet in no bucket about once in 20 million times.
    3. Every bucket is a star: each member is a candidate with the bucket's least
       id alone, so candidates grow with the memberships, not with their squares.
    4. Candidates are confirmed on the full sets of the whole texts.
    5. A star may miss a link between two members that its centre is not linked to.
       In buckets whose members are still of several components, those outside the
       bucket's main component are compared with all others, in blocks (about
       ``block`` of them, twice as many others), pairs already met in an earlier
       band left out; what is found there is confirmed likewise. Members of the main
       component are not compared with each other, so a large group of copies with
       a few strays costs rows in proportion.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    base = cut_lineage(rows.mapInArrow(_sketches(size), "doc_id long, n long, h1 long, h2 long, keys array<long>"))
    worded = base.where("n > 0 and doc_id is not null")
    first = worded.groupBy("h1", "h2", "n").agg(F.min(F.struct("doc_id", "keys")).alias("x")).select("h1", "h2", "n", "x.doc_id", "x.keys")
    reps = cut_lineage(first.select("h1", "h2", "n", F.col("doc_id").alias("rep"), "keys"))
    spread = reps.select("rep", F.explode("keys").alias("key"))
    stars = spread.groupBy("key").agg(F.min("rep").alias("c"), F.count(F.lit(1)).alias("members")).where("members > 1")
    buckets = cut_lineage(spread.join(stars, "key").select("key", "c", "members", F.col("rep").alias("m")))
    edges = buckets.where("m > c").select("c", "m").distinct()
    met = cut_lineage(edges.select(F.explode(F.array("c", "m")).alias("doc_id")).distinct())
    texts = cut_lineage(only(rows, met))  # of all that are ever compared
    links = cut_lineage(_confirmed(edges, texts, size, percent))
    known = components(links, "a", "b")

    def labelled(df: DataFrame, column: str, found: DataFrame) -> DataFrame:
        return df.join(found.withColumnRenamed("node", column), column, "left").withColumn("component", F.coalesce("component", column))

    placed = labelled(buckets.where("members > 2"), "m", known)
    sizes = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("all")).where("most < all")
    mine, theirs = (F.ceil(n / size).cast("int") for n, size in ((F.col("all") - F.col("most"), block), (F.col("all"), 2 * block)))
    left = cut_lineage(placed.join(main, "key").select("key", F.col("m").alias("doc_id"), "component", (F.col("component") != F.col("main")).alias("outside"), mine.alias("mine"), theirs.alias("theirs")))
    short = only(texts, cut_lineage(left.select("doc_id").distinct())).dropDuplicates(["doc_id"]).mapInArrow(_short_sets(size), "doc_id long, short binary")
    short = short.join(reps.select(F.col("rep").alias("doc_id"), "keys"), "doc_id")
    spot = lambda n: F.pmod(F.xxhash64("doc_id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = left.where("outside").withColumn("i", spot("mine")).withColumn("j", every("theirs")).withColumn("asks", F.lit(True))
    others = left.withColumn("j", spot("theirs")).withColumn("i", every("mine")).withColumn("asks", F.lit(False))
    pairs = asked.unionByName(others).join(short, "doc_id").select("key", "i", "j", "doc_id", "component", "asks", "outside", "keys", "short")
    more = cut_lineage(pairs.groupBy("key", "i", "j").applyInArrow(_across(percent), "c long, m long").distinct())
    missed = cut_lineage(_confirmed(more, texts, size, percent))
    found = known
    if not missed.isEmpty():
        found = components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(missed), "a", "b")

    whole = labelled(reps.select("h1", "h2", "n", "rep"), "rep", found).select("h1", "h2", "n", "component")
    linked = worded.select("doc_id", "n", "h1", "h2").join(whole, ["h1", "h2", "n"])
    alone = base.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component"))
    out = linked.select("doc_id", "n", "component").unionByName(alone)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(False)).alias("kept"))


def without_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, spare_nameless: bool = True) -> DataFrame:
    """One row of each group of rows that ``near_duplicates`` would link if each had an id of its own.

    The row of the least id stays, and any one of those that share it; a row
    without id only where none has one. With ``spare_nameless`` all rows without
    id stay. Rows without words all stay. ``docs`` is written once, with a key for
    each row; texts are not shuffled while the rows that go are few.
    """
    row = "__row"
    while row in docs.columns:
        row += "_"
    keyed = cut_lineage(docs.withColumn(row, F.monotonically_increasing_id()))  # kept, as another run could number rows otherwise
    found = near_duplicates(keyed.select(F.col(row).alias("doc_id"), "text"), size, percent)
    placed = cut_lineage(keyed.select(row, "doc_id").join(found.select(F.col("doc_id").alias(row), "component_id"), row))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", row)).alias("best")
    groups = placed.groupBy("component_id").agg(best, F.count(F.lit(1)).alias("members")).where("members > 1")
    groups = cut_lineage(groups.select("component_id", F.col(f"best.{row}").alias("stays")))
    groups = F.broadcast(groups) if groups.count() <= BROADCAST_IDS else groups  # so that a very large group stays where its rows are
    gone = placed.join(groups, "component_id").where(F.col(row) != F.col("stays"))
    if spare_nameless:
        gone = gone.where("doc_id is not null")
    gone = cut_lineage(gone.select(row))
    few = gone.count() <= BROADCAST_IDS
    return keyed.join(F.broadcast(gone) if few else gone, row, "left_anti").select(docs.columns)
