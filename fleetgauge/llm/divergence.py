"""Source divergence audit: how far the term distribution of each source is from those of its language.

1. Arrow tasks find the terms on bytes (``byte_tokens``), count them per
   language, source and term, and count for each term the documents that have
   it; partial counts are summed by Spark.
2. Each language keeps the terms of at least ``MIN_DOCS`` of its documents;
   group totals follow by aggregation.
3. The kept counts are cut into blocks by language and hash of the term,
   about ``BLOCK`` counts each, so that no task holds a language, and a task
   answers for ``SLICE`` sources.  Each block gets the totals of all groups of
   its language, builds CSR matrices (groups by terms) and sums the divergences
   of its terms per pair of groups with ``reduceat``; blocks' sums add up, and a
   block's best 200 terms of a group hold all of the group's best 200 that are
   in the block.

Probabilities are whole numbers of 1e-9, all arithmetic is on integers:
``p = 1 + floor(1e9 * (count + 1) / (N + V))`` by long division in base 1000
(exact for N + V < 9e15) and ``f = floor((p - q)^2 / q)``.

Defined results: null text, language and source are ''; texts without a term
still make their group; rows are documents, also repeated ones and those
without id; a language without kept terms has pairs of value 0; equal values
rank by the item's UTF-8; no documents give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.llm import byte_tokens
from fleetgauge.llm.common import hot_join, materialise

MIN_DOCS = 3
TOP = 200
#: Counts of one block, about; a block also has one row for each group of its language.
BLOCK = 200_000
#: Sources, about, whose rows one task returns: at most that many times the language's sources.
SLICE = 64
SCALE_DIGITS = 3  # 1e9 = 1000 ** 3

COUNTS = "lang string, source string, term string, n long, n_docs long"


def count_terms(docs: DataFrame) -> DataFrame:
    """Partial counts: (lang, source, term, n, n_docs); a null term for each group that occurs in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column(2)).to_numpy(zero_copy_only=False)
            chunk = np.cumsum(sizes) // byte_tokens.CHUNK
            cuts = np.r_[0, np.flatnonzero(np.diff(chunk)) + 1, len(chunk)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    yield _counted(batch.slice(a, b - a))

    texts = docs.select(
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
    )
    return texts.mapInArrow(run, COUNTS)


def _counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Counts of one batch of texts."""
    groups = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], ["lang", "source"])
    keys: dict[tuple, int] = {}
    of_text = np.array([keys.setdefault((g["lang"], g["source"]), len(keys)) for g in groups.to_pylist()])
    data = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8)
    ends = np.cumsum(pa.compute.binary_length(batch.column(2)).to_numpy(zero_copy_only=False))
    data = byte_tokens.lowered(data)
    starts, stops, text = byte_tokens.boundaries(data, ends)
    first, term = byte_tokens.group_slices(data, starts, stops)
    # One entry per text and term, as in a CSR matrix; its rows are then summed by group.
    cell, n = np.unique(text * max(len(first), 1) + term, return_counts=True)
    text, term = cell // max(len(first), 1), cell % max(len(first), 1)
    at = of_text[text] * max(len(first), 1) + term
    order = np.argsort(at, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(at[order]) != 0]) if len(at) else np.zeros(0, np.int64)
    total = np.add.reduceat(n[order], edges) if len(at) else edges
    n_docs = np.diff(np.r_[edges, len(at)])
    group, term = at[order][edges] // max(len(first), 1), at[order][edges] % max(len(first), 1)
    raw, lang, source = data.tobytes(), [k[0] for k in keys], [k[1] for k in keys]
    names = pa.array([raw[starts[k] : stops[k]] for k in first], pa.binary())
    group = np.r_[group, np.arange(len(keys))].astype(np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(lang, pa.string()).take(pa.array(group)),
            pa.array(source, pa.string()).take(pa.array(group)),
            # Bytes that aren't UTF-8 stay as they are: Spark's strings are bytes.
            pa.Array.from_buffers(pa.string(), len(names), names.buffers()).take(pa.array(np.r_[term.astype(float), np.full(len(keys), np.nan)], from_pandas=True).cast(pa.int64())),
            pa.array(np.r_[total, np.zeros(len(keys), np.int64)].astype(np.int64)),
            pa.array(np.r_[n_docs, np.zeros(len(keys), np.int64)].astype(np.int64)),
        ],
        ["lang", "source", "term", "n", "n_docs"],
    )


def probability(count: np.ndarray, of: np.ndarray) -> np.ndarray:
    """``1 + floor(1e9 * (count + 1) / of)`` by long division, without overflow."""
    whole, rest = np.divmod(count + 1, of)
    for _ in range(SCALE_DIGITS):
        digit, rest = np.divmod(rest * 1000, of)
        whole = whole * 1000 + digit
    return whole + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``floor((p - q)^2 / q)``."""
    return (p - q) * (p - q) // q


def block_divergences(
    mine: np.ndarray, of: np.ndarray, of_lang: int, source: np.ndarray, term: np.ndarray, n: np.ndarray, names: list[str], top: int = TOP
) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sums over a block's terms per pair of sources, and best terms: two times arrays of source, other source or term, value.

    ``of`` has N + V of each source, ``of_lang`` that of the language; ``mine``
    are the sources asked for; ``source``, ``term`` and ``n`` are the block's
    counts, and every term has some.
    """
    order = np.lexsort((term, source))
    source, term, n = source[order], term[order], n[order]
    row = np.searchsorted(source, np.arange(len(of) + 1))  # CSR
    p, zero = probability(n, of[source]), probability(np.zeros(len(of), np.int64), of)
    by_term = np.argsort(term, kind="stable")
    column = np.searchsorted(term[by_term], np.arange(len(names)))
    in_lang = probability(np.add.reduceat(n[by_term], column), np.full(len(names), of_lang)) if len(names) else n
    gain = np.where(p > in_lang[term], divergence(p, in_lang[term]), -1)

    full = np.flatnonzero(np.diff(row))
    other = np.arange(len(of))
    pairs, best = [], []
    for a in mine.tolist():
        own = slice(row[a], row[a + 1])
        dense = np.full(len(names), zero[a])
        dense[term[own]] = p[own]
        # As if the other source had none of the terms; distinct values of a row are few.
        value, times = np.unique(dense, return_counts=True)
        sums = sum((divergence(v, zero) * k for v, k in zip(value, times, strict=True)), np.zeros(len(of), np.int64))
        if len(full):
            here = dense[term]
            sums[full] += np.add.reduceat(divergence(here, p) - divergence(here, zero[source]), row[full])
        pairs.append((np.full(len(of) - 1, a), other[other != a], sums[other != a]))

        at = np.flatnonzero(gain[own] >= 0) + row[a]
        if len(at) > top:
            at = at[gain[at] >= np.partition(gain[at], len(at) - top)[len(at) - top]]
        at = np.array(sorted(at.tolist(), key=lambda k: (-gain[k], names[term[k]].encode()))[:top], np.int64)
        best.append((np.full(len(at), a), term[at], gain[at]))
    empty = [np.zeros(0, np.int64)] * 3
    return tuple([np.concatenate(x) for x in zip(*rows, strict=True)] if rows else empty for rows in (pairs, best))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, block: int = BLOCK, slice_: int = SLICE) -> DataFrame:
    """(lang, source, part, item, value, rank): pairs of sources of a language, and each source's most divergent terms."""
    counts = count_terms(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    counts = materialise(counts, "term-counts")
    of_term = Window.partitionBy("lang", "term")
    kept = counts.where("term is not null").withColumn("in_docs", F.sum("n_docs").over(of_term))
    # One source of each term stands for the term where terms are counted.
    kept = kept.withColumn("lead", (F.min("source").over(of_term) == F.col("source")).cast("long"))
    kept = materialise(kept.where(F.col("in_docs") >= min_docs).select("lang", "source", "term", "n", "lead"), "kept-counts")

    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("rows"), F.sum("lead").alias("terms"))
    groups = counts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").na.fill(0)
    groups = materialise(groups, "groups")
    sums = [F.sum("total").alias("lang_total"), F.sum("rows").alias("lang_rows"), F.sum("terms").alias("v"), F.count(F.lit(1)).alias("sources")]
    langs = groups.groupBy("lang").agg(*sums)
    langs = langs.withColumn("blocks", F.ceil((F.col("lang_rows") + 1) / F.lit(block))).withColumn("slices", F.ceil(F.col("sources") / F.lit(slice_)))
    langs = materialise(langs, "languages")
    n_rows = kept.count()

    def numbers(n: str) -> Column:
        return F.sequence(F.lit(0).cast("long"), F.col(n) - 1)

    none = F.lit(None)
    cells = hot_join(kept, langs.select("lang", "lang_rows", "blocks", "slices"), "lang", "lang_rows", n_rows)
    cells = cells.withColumn("block", F.pmod(F.xxhash64("term"), "blocks")).withColumn("slice", F.explode(numbers("slices")))
    cells = cells.select("lang", "block", "slice", "source", "term", "n", *(none.cast(t).alias(c) for c, t in (("size", "long"), ("lang_size", "long"), ("mine", "boolean"))))
    heads = hot_join(groups, langs.select("lang", "lang_total", "v", "sources", "blocks", "slices"), "lang", "sources", groups.count())
    heads = heads.withColumn("block", F.explode(numbers("blocks"))).withColumn("slice", F.explode(numbers("slices")))
    mine = F.pmod(F.xxhash64("source"), "slices") == F.col("slice")
    heads = heads.select("lang", "block", "slice", "source", none.cast("string").alias("term"), none.cast("long").alias("n"), (F.col("total") + F.col("v")).alias("size"), (F.col("lang_total") + F.col("v")).alias("lang_size"), mine.alias("mine"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        is_group = pa.compute.is_null(table.column("term"))
        heads, cells = table.filter(is_group), table.filter(pa.compute.invert(is_group))
        sources = heads.column("source").combine_chunks()
        source = pa.compute.index_in(cells.column("source").combine_chunks(), sources).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = cells.column("term").combine_chunks().dictionary_encode()
        of = np.maximum(heads.column("size").to_numpy(), 1)
        pairs, best = block_divergences(
            np.flatnonzero(heads.column("mine").to_numpy()), of, max(heads.column("lang_size")[0].as_py(), 1), source,
            coded.indices.to_numpy().astype(np.int64), cells.column("n").to_numpy().astype(np.int64), coded.dictionary.to_pylist(), top,
        )
        parts = []
        for part, items, (a, b, value) in (("pair", sources, pairs), ("term", coded.dictionary, best)):
            columns = [pa.array([key[0].as_py()] * len(a), pa.string()), sources.take(pa.array(a)), pa.array([part] * len(a), pa.string()), items.take(pa.array(b)), pa.array(value)]
            parts.append(pa.table(columns, names=["lang", "source", "part", "item", "value"]))
        return pa.concat_tables(parts)

    found = cells.unionByName(heads).groupBy("lang", "block", "slice").applyInArrow(run, "lang string, source string, part string, item string, value long")
    # A term lies in one block of its language, so the sum leaves its value as it is.
    summed = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), F.col("item"))
    ranked = summed.withColumn("rank", F.row_number().over(ranked))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")
