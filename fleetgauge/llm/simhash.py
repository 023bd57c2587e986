"""SimHash near-duplicate detection by generalised pigeonhole search.

1. Fingerprints of whole texts (Arrow batches, see ``simhash_kernel``).
2. Equal fingerprints collapse to one node, with map-side combine.
3. Correlated bits are grouped into partitions, and dynamic programming gives
   each partition its own threshold from candidate counts: two
   fingerprints within ``radius`` bits agree up to threshold ``t_i`` in some
   partition whenever the ``t_i`` sum up to ``radius - partitions + 1``.
4. Each node is listed once per partition and probes the ball of its
   partition's threshold; candidates are verified inside the join.
5. Buckets with more than ``dense`` nodes emit no pairs: their nodes, and those
   that probe them, are linked through shared midpoints.  Two fingerprints are
   within 4 bits exactly when some value is within 2 bits of both, so grouping
   by such values loses no connection and stays linear.
6. Connected components by alternating large and small stars, each round a
   table in the shared folder.

Defined results: null, empty and blank texts have fingerprint zero and are
linked like any other; repeated rows get equal results; the component id is
the smallest id reachable, null only if the component has no id; other columns
of the input are ignored by :func:`near_duplicates` and passed on by
:func:`keep_representatives`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import discard, hot_join, materialise
from fleetgauge.llm.exact_dedup import take
from fleetgauge.llm.simhash_kernel import fingerprint

RADIUS = 4
WIDTH = 4
#: Nodes that may share one bucket before its links go through midpoints.
DENSE = 4096
#: Cost of one probe row (shuffled) against one candidate pair (verified).
PROBE_COST = 20.0


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, raw_hash, fp): fp is the 64-bit pattern as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), width) for t in batch.column(2)]
            fps = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fps)], ["doc_id", "raw_hash", "fp"])

    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("raw_hash"),
        F.col("text").cast("binary").alias("text"),
    )
    return texts.mapInArrow(run, "doc_id long, raw_hash long, fp long")


def bit_counts(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of nodes and, for all pairs of bits, in how many both are set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((64, 64), np.int64)
        n = 0
        for batch in batches:
            bits = np.unpackbits(batch.column(0).to_numpy().view(np.uint8), bitorder="little").reshape(-1, 64)
            for at in range(0, len(bits), 1 << 14):
                part = bits[at : at + (1 << 14)].astype(np.float32)
                both += np.rint(part.T @ part).astype(np.int64)
            n += len(bits)
        i, j = np.triu_indices(64)
        at = pa.array(np.r_[i * 64 + j, -1])
        yield pa.RecordBatch.from_arrays([at, pa.array(np.r_[both[i, j], n])], ["at", "n"])

    sums = nodes.select("fp").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    both, n = np.zeros(64 * 64), 0
    for row in sums.collect():  # 2,081 rows at any input size
        if row["at"] < 0:
            n = row["n"]
        else:
            both[row["at"]] = row["n"]
    both = both.reshape(64, 64)
    return n, np.maximum(both, both.T)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of about equal size, correlated ones together."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, groups = set(range(64)), []
    sizes = [64 // parts + (k < 64 % parts) for k in range(parts)]
    for size in sizes:
        first = max(left, key=lambda b: (corr[b, sorted(left)].sum(), -b))
        group = [first]
        left.discard(first)
        while len(group) < size:
            best = max(left, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def _ball(bits: int, radius: int) -> int:
    size, term = 0, 1
    for k in range(radius + 1):
        size += term
        term = term * (bits - k) // (k + 1)
    return size


def equal_pairs(nodes: DataFrame, groupings: dict[int, list[list[int]]]) -> dict[tuple[int, int], float]:
    """For each partition of each grouping, how many pairs of nodes agree on all its bits."""
    keys = []
    for parts, groups in groupings.items():
        for k, bits in enumerate(groups):
            inside = F.col("fp").bitwiseAND(F.lit(_mask(bits)))
            keys.append(F.struct(F.lit(parts).alias("parts"), F.lit(k).alias("part"), inside.alias("key")))
    counted = nodes.select(F.explode(F.array(*keys)).alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.sum(F.col("n") * (F.col("n") - 1) / 2)
    found = counted.groupBy("at.parts", "at.part").agg(pairs.alias("pairs")).collect()  # one row per partition
    return {(r["parts"], r["part"]): float(r["pairs"]) for r in found}


def plan_search(nodes: DataFrame, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """Partitions of the bits with thresholds of least estimated cost.

    The candidates at threshold 0 are counted over all nodes, so correlated and
    skewed bits show.  Those of threshold t follow by the ratio that a sum of
    independent bit differences has between distances up to t and none; -1
    leaves a partition out.
    """
    n, both = bit_counts(nodes)
    groupings = {parts: group_bits(n, both, parts) for parts in range(2, radius + 2)}
    return choose_plan(n, both, groupings, equal_pairs(nodes, groupings), radius)


def choose_plan(
    n: int, both: np.ndarray, groupings: dict[int, list[list[int]]], equal: dict[tuple[int, int], float], radius: int = RADIUS
) -> list[tuple[list[int], int]]:
    """The grouping and thresholds of least cost, by dynamic programming over the sum of thresholds."""
    p = np.diag(both) / max(n, 1)
    differ = 2 * p * (1 - p)
    best: tuple[float, list[tuple[list[int], int]]] = (np.inf, [])
    for parts, groups in groupings.items():
        costs = []
        for k, group in enumerate(groups):
            dist = np.zeros(radius + 1)
            dist[0] = 1.0
            for b in group:
                dist[1:] = dist[1:] * (1 - differ[b]) + dist[:-1] * differ[b]
                dist[0] *= 1 - differ[b]
            expected = n * n / 2 * np.cumsum(dist)
            pairs = expected + max(0.0, equal.get((parts, k), 0.0) - expected[0])
            costs.append([0.0] + [PROBE_COST * n * _ball(len(group), t) + pairs[t] for t in range(radius + 1)])
        need = radius - parts + 1
        # table[s]: least cost of the partitions so far with thresholds summing up to s.
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for cost in costs:
            step: dict[int, tuple[float, list[int]]] = {}
            for s, (c, chosen) in table.items():
                for t in range(-1, radius + 1):
                    new = (c + cost[t + 1], [*chosen, t])
                    if s + t not in step or new[0] < step[s + t][0]:
                        step[s + t] = new
            table = step
        cost, chosen = table[need]
        if cost < best[0]:
            best = (cost, [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0])
    return best[1]


def _flips(bits: list[int], radius: int) -> np.ndarray:
    """All masks over ``bits`` with at most ``radius`` of them set."""
    masks = [sum(1 << b for b in some) for k in range(radius + 1) for some in combinations(bits, k)]
    return np.array(masks, np.uint64).view(np.int64)


def _mask(bits: list[int]) -> int:
    """The mask of ``bits`` as a signed 64-bit number."""
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def _keys(nodes: DataFrame, plan: list[tuple[list[int], int]], probe: bool) -> DataFrame:
    """(part, key, fp): each node's value in every partition, or its ball."""
    keys = []
    for k, (bits, radius) in enumerate(plan):
        inside = F.col("fp").bitwiseAND(F.lit(_mask(bits)))
        masks = _flips(bits, radius if probe else 0).tolist()
        keys += [F.struct(F.lit(k).alias("part"), inside.bitwiseXOR(F.lit(m)).alias("key")) for m in masks]
    return nodes.select("fp", F.explode(F.array(*keys)).alias("at")).select("at.part", "at.key", "fp")


def _midpoint_links(fps: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that connect every two of ``fps`` within ``radius`` bits, linear in their number.

    Needs an even ``radius``: such a pair shares a value within half of it.
    """
    masks = [int(m) for m in _flips(list(range(64)), radius // 2)]
    around = fps.select("fp", F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask"))
    around = around.select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("key"))
    least = around.groupBy("key").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return around.join(least, "key").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def links(nodes: DataFrame, plan: list[tuple[list[int], int]], radius: int = RADIUS, dense: int = DENSE) -> DataFrame:
    """Links (a, b) with the same connected components as all pairs within ``radius`` bits."""
    listed, probes = _keys(nodes, plan, False), _keys(nodes, plan, True)
    crowded = listed.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > dense)
    crowded = materialise(crowded, "crowded")
    # Each node lies in one bucket of a partition: at most partitions * nodes / dense rows.
    some = not crowded.isEmpty()
    if some:
        near = probes.join(crowded, ["part", "key"], "left_semi").select("fp").distinct()
        near = materialise(near, "crowded-nodes")
        listed = listed.join(crowded, ["part", "key"], "left_anti")
    b = listed.select("part", "key", F.col("fp").alias("b"))
    a = probes.select("part", "key", F.col("fp").alias("a"))
    close = (F.col("a") > F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    pairs = a.join(b, (a["part"] == b["part"]) & (a["key"] == b["key"]) & close).select("a", "b")
    return pairs.unionByName(_midpoint_links(near, radius)) if some else pairs


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the least node reachable.

    Alternates stars around larger and smaller neighbours until nothing moves;
    every round is a table of the shared folder, and only its count and
    checksum reach the driver.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    edges = materialise(edges.distinct(), "star")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        before, edges = edges, materialise(small.select("e.a", "e.b").where("a <> b").distinct(), "star")
        discard(before)
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def _components_of(docs: DataFrame, width: int, radius: int, dense: int) -> DataFrame:
    """(doc_id, raw_hash, fp, root, component_id) of each row."""
    prints = materialise(fingerprints(docs, width), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n_docs"))
    nodes = materialise(nodes, "nodes")
    edges = links(nodes, plan_search(nodes, radius), radius, dense)
    roots = components(edges).select(F.col("node").alias("fp"), "root")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialise(rooted, "rooted")
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("n_nodes"))
    named = hot_join(rooted, ids, "root", "n_nodes", rooted.count()).select("fp", "n_docs", "root", "component_id")
    return hot_join(prints, materialise(named, "named"), "fp", "n_docs", prints.count())


def near_duplicates(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, dense: int = DENSE) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    found = _components_of(docs, width, radius, dense)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def linked_texts(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, dense: int = DENSE) -> DataFrame:
    """(a, b) of text hashes: each text of a component of several and the least of them."""
    rows = materialise(_components_of(docs, width, radius, dense).select("root", "raw_hash").distinct(), "texts")
    least = rows.groupBy("root").agg(F.min("raw_hash").alias("b"), F.count(F.lit(1)).alias("n_texts")).where("n_texts > 1")
    found = hot_join(rows, least, "root", "n_texts", rows.count())
    return found.select(F.col("raw_hash").alias("a"), "b").where("a <> b")


def keep_representatives(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, dense: int = DENSE) -> DataFrame:
    """The documents of which one per component stays: the one with the smallest id.

    A row without id stays only where no row of its component has one; of
    repeated rows, and of different texts that share the id, one stays.
    """
    rows = _components_of(docs, width, radius, dense).groupBy("root", "doc_id", "raw_hash").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("raw_hash"), F.col("n")))
    return take(docs, rows.groupBy("root").agg(first.alias("first")).select("first.doc_id", "first.raw_hash", "first.n"))
