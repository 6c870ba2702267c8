"""Near-duplicate embeddings by an inverted multi-index.

Each half of a vector has a codebook of its own; the pairs of code words are the
cells of a product grid. An entry lies in the cell of its nearest words. A query
visits cells in the order of the sum of its two squared distances, by the
multi-sequence algorithm, until that sum exceeds the nearest cell's by a slack;
the entries it meets are verified by cosine in double precision.

Codebooks and slack come from a bounded sample (``SAMPLE`` vectors). The slack is
the least with which a share ``recall`` of neighbours exactly at the threshold,
drawn around sampled vectors, would be met; nearer neighbours are met more often.

Visits are not symmetric: of two alike vectors, one may visit the other's cell and
not be visited itself. Each entry carries the cells that it visits, so the task
that meets a pair knows if it is met from the other side too, and a link counts
once for either end.

Equal vectors are merged first. Crowded cells are cut in blocks of entries and of
queries; a block pair is one task's matrix product, which gives each vector its
number of links, and the links themselves only as a spanning star of each of the
block's components. Vectors of each length have an index of their own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, cut_lineage, small
from .components import components

#: Vectors of a length that its codebooks are fitted on, and most words of one.
SAMPLE, WORDS = 20_000, 1024
#: Entries and queries of a block.
ENTRIES, QUERIES = 1024, 4096


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _distances(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Squared distances of rows to code words."""
    return np.maximum(0, (x**2).sum(axis=1)[:, None] - 2 * x @ words.T + (words**2).sum(axis=1))


def codebook(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Code words by Lloyd's iterations from distinct random rows."""
    r = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    words = x[r.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = _distances(x, words).argmin(axis=1)
        n = np.bincount(near, minlength=len(words))
        total = np.zeros_like(words)
        np.add.at(total, near, x)
        words = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], words)
    return words


def multi_sequence(one: np.ndarray, two: np.ndarray, slack: float) -> Iterator[tuple[int, int]]:
    """Pairs of indices in the order of ``one[i] + two[j]``, up to ``slack`` above the least sum."""
    a, b = np.argsort(one, kind="stable").tolist(), np.argsort(two, kind="stable").tolist()
    x, y = one[a].tolist(), two[b].tolist()
    limit = x[0] + y[0] + slack
    heap = [(x[0] + y[0], 0, 0)]
    while heap:
        _, i, j = heapq.heappop(heap)
        yield a[i], b[j]
        if j + 1 < len(y) and x[i] + y[j + 1] <= limit:
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(x) and x[i + 1] + y[0] <= limit:
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))


class Index:
    """Two codebooks and the slack of a visit."""

    def __init__(self, one: np.ndarray, two: np.ndarray, slack: float):
        self.one, self.two, self.slack = one, two, slack

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.one.shape[1]
        return _distances(x[:, :cut], self.one), _distances(x[:, cut:], self.two)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.halves(x)
        return a.argmin(axis=1) * len(self.two) + b.argmin(axis=1)

    def visits(self, x: np.ndarray) -> list[list[int]]:
        a, b = self.halves(x)
        return [[i * len(self.two) + j for i, j in multi_sequence(p, q, self.slack)] for p, q in zip(a, b)]


def fit(sample: np.ndarray, rows: int, threshold: float, recall: float = 0.999, seed: int = 7) -> Index:
    """An index from sampled vectors, with cells for about ``rows`` entries."""
    x = unit(sample)
    k = int(min(WORDS, max(1, round((rows / 8) ** 0.5))))
    cut = max(1, x.shape[1] // 2)
    one = codebook(x[:, :cut], k)
    two = codebook(x[:, cut:], k) if x.shape[1] > cut else np.zeros((1, 0))
    index = Index(one, two, 0.0)
    r = np.random.default_rng(seed)
    base = x[r.choice(len(x), min(2000, len(x)), replace=False)].repeat(5, axis=0)
    aside = r.normal(size=base.shape)
    aside -= (aside * base).sum(axis=1, keepdims=True) * base
    norm = np.linalg.norm(aside, axis=1, keepdims=True)
    near = threshold * base + (1 - threshold**2) ** 0.5 * np.divide(aside, norm, out=np.zeros_like(aside), where=norm > 1e-12)
    a, b = index.halves(base)
    p, q = index.halves(near)
    at = np.arange(len(base))
    needed = a[at, p.argmin(axis=1)] + b[at, q.argmin(axis=1)] - a.min(axis=1) - b.min(axis=1)
    index.slack = float(np.quantile(needed, recall, method="higher")) + 1e-9
    return index


def _lists(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of lists without nulls in them (a null list counts as empty), and their values in a row."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False), array.flatten().to_numpy(zero_copy_only=False)


def _visits(shared):
    """Each vector's own cell, and the cells that it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("multiindex")
        indexes = {size: Index(*parts) for size, parts in shared.value.items()}
        for batch in small(batches):
            size, values = _lists(batch.column("vector"))
            starts = np.cumsum(size) - size
            own, visits = np.zeros(len(size), np.int32), [[] for _ in size]
            for n in np.unique(size):
                if index := indexes.get(int(n)):  # else nothing has that length but one vector
                    at = np.flatnonzero(size == n)
                    x = unit(values[starts[at][:, None] + np.arange(n)])
                    own[at] = index.cells(x)
                    for k, cells in zip(at, index.visits(x)):
                        visits[k] = cells
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("label"), pa.array(size, pa.int32()), pa.array(own), pa.array(visits, pa.list_(pa.int32()))], names=["rep", "label", "size", "own", "visits"])

    return run


def _verify(threshold: float):
    """One block pair: for each vector with a link, the links that it has here, and the least vector of its local component."""

    def run(table: pa.Table) -> pa.Table:
        reps, who = np.unique(table.column("rep").to_numpy(), return_inverse=True)
        many, own = (table.column(c).to_numpy().astype(np.int64) for c in ("many", "own"))
        x = _lists(table.column("vector"))[1].astype(np.float64).reshape(len(who), -1)
        asks = table.column("asks").to_numpy()
        norm = np.linalg.norm(x, axis=1)
        e, q = np.flatnonzero(~asks), np.flatnonzero(asks)
        count, visits = _lists(table.column("visits"))
        seen = np.unique((np.repeat(np.arange(len(who)), count) << 32) + visits)
        found = np.zeros(len(reps), np.int64)
        root: dict[int, int] = {}

        def find(v: int) -> int:
            while (p := root.setdefault(v, v)) != v:
                root[v] = root[p]
                v = p
            return v

        for a in range(0, len(q), 512):
            part = q[a : a + 512]
            cosine = (x[part] @ x[e].T) / (norm[part][:, None] * norm[e])
            i, j = np.nonzero((cosine >= threshold) & (who[part][:, None] != who[e]))
            i, j = part[i], e[j]
            np.add.at(found, who[i], many[j])
            once = ~np.isin((j << 32) + own[i], seen)  # the entry doesn't ask in the query's cell
            np.add.at(found, who[j[once]], many[i[once]])
            met = np.unique(np.stack([np.minimum(who[i], who[j]), np.maximum(who[i], who[j])]), axis=1)
            for s, t in met.T.tolist():
                s, t = find(s), find(t)
                if s != t:
                    root[max(s, t)] = min(s, t)
        nodes = np.asarray(list(root), np.int64)
        ends = np.asarray([find(v) for v in nodes.tolist()], np.int64)
        return pa.table([pa.array(reps[nodes]), pa.array(reps[ends]), pa.array(found[nodes])], names=["a", "b", "n"])

    return run


def _sample(distinct: DataFrame, size: int, total: int) -> np.ndarray:
    """About ``SAMPLE`` of the vectors of a length, by a hash of their ids; all where there are no more."""
    own = distinct.where(F.col("size") == size)
    if total > SAMPLE:
        own = own.where(F.xxhash64("rep") < F.lit(int(SAMPLE / total * 2**64) - 2**63))
    found = own.select("vector").orderBy("vector").toArrow().column(0).combine_chunks()
    if len(found) < 2:
        raise RuntimeError(f"no sample of {total} vectors of length {size}")
    return found.flatten().to_numpy().reshape(-1, size)


def linked_vectors(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Only vectors of equal, non-null label and equal length are compared. A vector
    that is null, zero or without components, that holds a null or a non-finite
    component, or that has no label or id, links with nothing. Rows with equal
    vectors and labels are linked without being compared; repeated rows count as
    vectors of their own. Each length that vectors have takes a fit at the driver.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ~bad & F.exists("vector", lambda v: v != 0), F.lit(False))
    keyed = rows.withColumn("good", good).withColumn("k1", F.xxhash64("vector")).withColumn("k2", F.xxhash64(F.lit(1), "vector"))
    distinct = keyed.where("good").groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("many"), F.first("vector").alias("vector"))
    distinct = cut_lineage(distinct.withColumn("size", F.size("vector")))
    indexes = {}
    for r in distinct.groupBy("size").count().where("count > 1").orderBy("size").collect():  # a row for each length
        index = fit(_sample(distinct, r["size"], r["count"]), r["count"], threshold)
        indexes[r["size"]] = index.one, index.two, index.slack
    reps = distinct.select("label", "k1", "k2", "rep", "many")
    if not indexes:
        reps = reps.withColumn("n", F.lit(0).cast("long")).withColumn("component", F.col("rep"))
    else:
        links = cut_lineage(_links(distinct, spark.sparkContext.broadcast(indexes), threshold))
        counts = links.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
        found = components(links, "a", "b").withColumnRenamed("node", "rep")
        reps = reps.join(counts, "rep", "left").join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    linked = keyed.where("good").select("vec_id", "label", "k1", "k2").join(reps, ["label", "k1", "k2"]).select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).cast("long").alias("n_links"), F.col("component").alias("component_id"))
    alone = keyed.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _links(distinct: DataFrame, shared, threshold: float) -> DataFrame:
    """What block pairs find: vectors, the least of their component there, their links there."""
    label = distinct.schema["label"].dataType.simpleString()
    placed = cut_lineage(distinct.select("rep", "vector", "label").mapInArrow(_visits(shared), f"rep long, label {label}, size int, own int, visits array<int>"))
    entry = F.struct(F.col("own").alias("cell"), F.lit(False).alias("asks"), F.col("visits").alias("visits"))
    asked = F.transform("visits", lambda c: F.struct(c.alias("cell"), F.lit(True).alias("asks"), F.lit(None).cast("array<int>").alias("visits")))
    places = placed.select("rep", "label", "size", "own", F.explode(F.concat(F.array(entry), asked)).alias("p")).select("rep", "label", "size", "own", "p.*")
    where = ["label", "size", "cell"]
    cells = places.groupBy(*where).agg(F.sum(F.when(F.col("asks"), 0).otherwise(1)).alias("e"), F.sum(F.when(F.col("asks"), 1).otherwise(0)).alias("q"))
    cells = cells.where("e > 0 and q > 0 and e + q > 2").select(*where, F.ceil(F.col("e") / ENTRIES).cast("int").alias("eb"), F.ceil(F.col("q") / QUERIES).cast("int").alias("qb"))
    met = places.join(cells, where)
    mine = F.when(F.col("asks"), F.pmod(F.xxhash64("rep"), "qb")).otherwise(F.pmod(F.xxhash64("rep"), "eb")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("asks"), F.col("eb")).otherwise(F.col("qb")) - 1))
    met = met.withColumn("mine", mine).withColumn("other", other)
    met = met.select("rep", *where, "asks", "own", "visits", F.when(F.col("asks"), F.col("other")).otherwise(F.col("mine")).alias("i"), F.when(F.col("asks"), F.col("mine")).otherwise(F.col("other")).alias("j"))
    full = met.join(distinct.select("rep", "vector", "many"), "rep")
    return full.groupBy(*where, "i", "j").applyInArrow(_verify(threshold), "a long, b long, n long")
