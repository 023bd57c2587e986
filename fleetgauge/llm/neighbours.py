"""Approximate nearest neighbours by inner product: inverted lists with an adaptive dimension scan.

1. Vectors get one more component, so that the largest inner product is the
   least Euclidean distance, and are turned by a random rotation, after which
   the first components of a difference estimate its whole length.
2. Centroids come from a sample of at most ``SAMPLE`` vectors.  Every vector
   goes into the list of its nearest centroid.
3. For ``PROBED`` sample queries the exact neighbours are found over all rows;
   the number of lists that a search probes is the least that holds a
   ``RECALL`` share of them.
4. Queries visit their nearest list first, then in rounds four times as many
   each; the 20th best so far bounds the search of a round.  A list is scanned
   by column blocks: after each one a candidate is abandoned if its partial
   distance, scaled to all dimensions, is beyond the bound by more than a
   hypothesis test allows.
5. What remains is scored on the original vectors in double precision.

Lists are cut into blocks of at most ``BLOCK`` vectors and ``QUERIES`` queries,
so that no task holds a list; each returns its 20 best per query.

Defined results: vectors null, empty, zero or with null or non-finite
components take no part, nor do those whose length isn't the most frequent one
(ties: the smaller) and rows without id; of rows with the same id the vector
first in array order counts; ties go to the smaller id; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.llm.common import hash_sample, materialise

TOP = 20
EVERY = 20
#: Vectors that the centroids are fitted on, at most, and the centroids' number for so many: bounds of what is broadcast.
SAMPLE, MOST_LISTS = 20_000, 1024
LIST_SIZE = 256
#: Sample queries and the share of their exact neighbours that the probed lists hold.
PROBED, RECALL = 100, 0.97
BLOCK, QUERIES = 4096, 1024
#: Components of one column block, and the width of the hypothesis test.
COLUMNS, EPSILON = 16, 2.1
#: Pairs compared at once.
PAIRS = 1 << 21
SEED = 20240611


def vectors_of(rows: DataFrame) -> DataFrame:
    """(vec_id, x): one finite vector of the usual length per id, in double precision."""
    x = F.col("embedding").cast("array<double>")
    found = rows.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null and size(x) > 0")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf))
    found = found.where(finite & F.exists("x", lambda v: v != 0))
    found = found.groupBy("vec_id").agg(F.min("x").alias("x"))
    found = materialise(found, "vectors")
    sizes = found.groupBy(F.size("x").alias("dims")).agg(F.count(F.lit(1)).alias("n"))
    usual = sizes.orderBy(F.col("n").desc(), "dims").first()
    return found.where(F.size("x") == (usual["dims"] if usual else 0))


def as_matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """The vectors of an Arrow list column as rows."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed component by component in double precision."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


class Index:
    """Rotation and centroids; at most ``MOST_LISTS`` + dims vectors."""

    def __init__(self, sample: np.ndarray, longest: float, lists: int):
        rng = np.random.default_rng(SEED)
        self.longest = longest
        dims = sample.shape[1] + 1
        self.rotation = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
        turned = self.turn(sample)
        centres = turned[rng.permutation(len(turned))[: max(1, lists)]].copy()
        for _ in range(10):
            at = self.nearest(turned, centres)
            size = np.bincount(at, minlength=len(centres))
            order = np.argsort(at, kind="stable")
            full = np.flatnonzero(size)
            sums = np.add.reduceat(turned[order], np.searchsorted(at[order], full), axis=0)
            centres[full] = sums / size[full, None]
        self.centres = centres

    def turn(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Rotated vectors; with the further component all candidates have the length of the longest."""
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.longest**2 - (x * x).sum(axis=1), 0.0))
        return np.column_stack([x, rest]) @ self.rotation

    @staticmethod
    def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return (centres * centres).sum(axis=1)[None, :] - 2 * x @ centres.T

    def nearest(self, x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        step = max(1, PAIRS // len(centres))
        return np.concatenate([np.zeros(0, np.int64), *(self.distances(x[k : k + step], centres).argmin(axis=1) for k in range(0, len(x), step))])

    def order(self, queries: np.ndarray) -> np.ndarray:
        """The lists from near to far, for each query."""
        return np.argsort(self.distances(self.turn(queries, True), self.centres), axis=1, kind="stable")


def fit(vectors: DataFrame, dims: int, n: int) -> Index:
    """Centroids from a hashed sample of at most ``SAMPLE`` vectors."""
    longest = vectors.agg(F.max(F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)))).first()[0]
    sample = hash_sample(vectors, "vec_id", SAMPLE).orderBy("vec_id").toArrow()
    return Index(as_matrix(sample.column("x"), dims), float(longest), min(MOST_LISTS, math.ceil(n / LIST_SIZE)))


def exact_neighbours(vectors: DataFrame, queries: pa.Table, dims: int, top: int = TOP) -> DataFrame:
    """(query_id, vec_id, score, list): the best of all rows for a bounded set of queries, by brute force."""
    ids, wanted = queries.column("vec_id").to_numpy(), as_matrix(queries.column("x"), dims)
    shared = vectors.sparkSession.sparkContext.broadcast((ids, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, wanted = shared.value
        for batch in batches:
            own, x, home = batch.column(0).to_numpy(), as_matrix(batch.column(1), dims), batch.column(2).to_numpy()
            score = wanted @ x.T
            score[ids[:, None] == own[None, :]] = -math.inf
            keep = np.argsort(-score, axis=1, kind="stable")[:, :top]
            row = np.repeat(np.arange(len(ids)), keep.shape[1])
            keep = keep.ravel()
            good = score[row, keep] > -math.inf
            row, keep = row[good], keep[good]
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(own[keep]), pa.array(score[row, keep]), pa.array(home[keep])], ["query_id", "vec_id", "score", "list"])

    found = vectors.select("vec_id", "x", "list").mapInArrow(run, "query_id long, vec_id long, score double, list long")
    return best_of(found, top)


def best_of(found: DataFrame, top: int) -> DataFrame:
    """The ``top`` best rows of each query with their rank; ties go to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def lists_to_probe(index: Index, vectors: DataFrame, queries: DataFrame, dims: int, recall: float = RECALL, top: int = TOP) -> int:
    """How many lists hold a ``recall`` share of the exact neighbours of sample queries."""
    sample = hash_sample(queries.select("vec_id", "x"), "vec_id", PROBED).toArrow()
    if not len(sample):
        return 1
    order = index.order(as_matrix(sample.column("x"), dims))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
    row = {q: k for k, q in enumerate(sample.column("vec_id").to_pylist())}
    found = exact_neighbours(vectors, sample, dims, top).select("query_id", "list").collect()  # PROBED * TOP rows
    places = np.sort([place[row[r["query_id"]], r["list"]] for r in found])
    return int(places[math.ceil(recall * len(places)) - 1]) + 1 if len(places) else 1


def scan(queries: np.ndarray, bounds: np.ndarray, candidates: np.ndarray, skip: np.ndarray, top: int, columns: int = COLUMNS) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) pairs that no test abandons, by partial squared distances over column blocks.

    ``bounds`` are squared distances; ``skip`` marks pairs of a query with itself.
    """
    dims = queries.shape[1]
    rows, found = [], []
    step = max(1, PAIRS // max(len(candidates), 1))
    for at in range(0, len(queries), step):
        part = slice(at, at + step)
        first = np.s_[:, :columns]
        a, b = queries[part][first], candidates[first]
        partial = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
        seen = min(columns, dims)
        alive = ~skip[part] & (partial * (dims / seen) <= bounds[part][:, None] * _slack(seen, dims))
        row, col = np.nonzero(alive)
        value = partial[row, col]
        row = row + at
        while seen < dims and len(row):
            block = slice(seen, seen + columns)
            apart = queries[row, block] - candidates[col, block]
            value = value + (apart * apart).sum(axis=1)
            seen = min(seen + columns, dims)
            keep = value * (dims / seen) <= bounds[row] * _slack(seen, dims)
            row, col, value = row[keep], col[keep], value[keep]
        rows.append(row)
        found.append(col)
    return np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, np.int64), *found])


def _slack(seen: int, dims: int) -> float:
    """Factor on a squared bound: the estimate of ``seen`` rotated components may be off by so much; the whole distance only by rounding."""
    return 1 + 1e-9 if seen >= dims else (1 + EPSILON / math.sqrt(seen)) ** 2


def scan_lists(vectors: DataFrame, probes: DataFrame, index: Index, dims: int, top: int) -> DataFrame:
    """(query_id, vec_id, score): each list's best for the queries that probe it.

    ``probes`` has query_id, x, list and bound; blocks of lists meet blocks of queries.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(index)

    def parts(rows: DataFrame, key: str, size: int) -> DataFrame:
        return rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).alias(key))

    # One row per list, so at most MOST_LISTS.
    cuts = F.broadcast(parts(vectors, "blocks", BLOCK).join(parts(probes, "groups", QUERIES), "list"))

    def numbers(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    left = vectors.join(cuts, "list").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks")).withColumn("part", numbers("groups"))
    right = probes.join(cuts, "list").withColumn("part", F.pmod(F.xxhash64("query_id"), "groups")).withColumn("block", numbers("blocks"))

    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        if len(candidates) and len(queries):
            index = shared.value
            x, ids = as_matrix(candidates.column("x"), dims), candidates.column("vec_id").to_numpy()
            q, query_ids = as_matrix(queries.column("x"), dims), queries.column("query_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            x, ids = x[order], ids[order]
            # From inner products to squared distances of the lengthened vectors.
            bounds = np.maximum((q * q).sum(axis=1) + index.longest**2 - 2 * queries.column("bound").to_numpy(), 0.0) + 1e-12
            row, col = scan(index.turn(q, True), bounds, index.turn(x), query_ids[:, None] == ids[None, :], top)
            score = exact_scores(q[row], x[col])
            order = np.lexsort((col, -score, row))
            row, col, score = row[order], col[order], score[order]
            head = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else row
            place = np.arange(len(row)) - np.repeat(head, np.diff(np.r_[head, len(row)]))
            best = place < top
            found = [query_ids[row[best]], ids[col[best]], score[best]]
        return pa.table([pa.array(v) for v in found], names=["query_id", "vec_id", "score"])

    keys = ["list", "block", "part"]
    met = left.select(*keys, "vec_id", "x").groupBy(*keys).cogroup(right.select(*keys, "query_id", "x", "bound").groupBy(*keys))
    return met.applyInArrow(run, "query_id long, vec_id long, score double")


def search(rows: DataFrame, every: int = EVERY, top: int = TOP, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest of each row whose id is divisible by ``every``."""
    vectors = vectors_of(rows)
    first = vectors.select(F.size("x").alias("dims")).first()
    if first is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, n = first["dims"], vectors.count()
    index = fit(vectors, dims, n)
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            home = index.nearest(index.turn(as_matrix(batch.column(1), dims)), index.centres)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home)], ["vec_id", "x", "list"])

    listed = materialise(vectors.select("vec_id", "x").mapInArrow(place, "vec_id long, x array<double>, list long"), "listed")
    queries = listed.where(F.col("vec_id") % every == 0)
    probed = lists_to_probe(index, listed, queries, dims, recall, top)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                order = index.order(as_matrix(part.column(1), dims))[:, :probed]
                again = pa.array(np.repeat(np.arange(len(part)), order.shape[1]))
                columns = [part.column(0).take(again), part.column(1).take(again), pa.array(order.ravel()), pa.array(np.tile(np.arange(order.shape[1]), len(part)))]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "x", "list", "visit"])

    probes = materialise(queries.select("vec_id", "x").mapInArrow(visit, "query_id long, x array<double>, list long, visit long"), "probes")
    # Each round visits four times as many lists as the one before, within the bounds found so far.
    best, start, many = None, 0, 1
    while start < probed:
        due = probes.where((F.col("visit") >= start) & (F.col("visit") < start + many)).select("query_id", "x", "list")
        if best is None:
            due = due.withColumn("bound", F.lit(-math.inf))
        else:
            known = best.where(F.col("rank") == top).select("query_id", F.col("score").alias("bound"))
            due = due.join(known, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(-math.inf)))
        found = scan_lists(listed, due, index, dims, top)
        best = materialise(best_of(found if best is None else best.drop("rank").unionByName(found), top), "best")
        start, many = start + many, many * 4
    return best.select("query_id", "rank", "vec_id", "score")
