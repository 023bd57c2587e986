"""Packing by optimal length buckets.

The global histogram of lengths is one row per length up to ``max_len``;
dynamic programming over it chooses the bucket boundaries of least padding.
Inside each bucket, batches of a fixed token budget are formed.

Documents longer than ``max_len`` are cut into pieces of ``max_len`` words and
a rest, so that whole texts are packed.  Defined results: null and blank texts
have no words and give no piece (they appear with piece null, in no batch);
repeated rows and rows without id are packed as often as they occur, told apart
by a row id that is written once, so groups stay small and slots unique however
often an id occurs; which of equal rows gets which slot may differ between
runs; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.llm.common import materialise, words_of

MAX_LEN = 2048
BUCKETS = 16
#: Padded words of one batch.
BUDGET = 16384
#: Pieces that are numbered in one group; larger buckets are split by hash.
GROUP_ROWS = 20000


def best_boundaries(counts: dict[int, int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets that minimise padding.

    Padding is the sum over pieces of their bucket's upper bound less their
    length.  Only lengths that occur are bounds.  With cost(i, j) the padding
    of lengths i+1..j in one bucket, least[k][j] = min over i of
    least[k-1][i] + cost(i, j).
    """
    lengths = np.array(sorted(counts), np.int64)
    if not len(lengths):
        return []
    number = np.array([counts[x] for x in lengths.tolist()], np.float64)
    n_upto = np.r_[0.0, np.cumsum(number)]
    words_upto = np.r_[0.0, np.cumsum(number * lengths)]
    m = len(lengths)
    least = np.full(m + 1, np.inf)
    least[0] = 0.0
    cuts = []
    for _ in range(min(buckets, m)):
        new, cut = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
        new[0] = 0.0
        for j in range(1, m + 1):
            cost = least[:j] + lengths[j - 1] * (n_upto[j] - n_upto[:j]) - (words_upto[j] - words_upto[:j])
            cut[j] = int(np.argmin(cost))
            new[j] = cost[cut[j]]
        least = new
        cuts.append(cut)
    bounds, j = [], m
    for cut in reversed(cuts):
        if j == 0:
            break
        bounds.append(int(lengths[j - 1]))
        j = int(cut[j])
    return bounds[::-1]


def pieces_of(docs: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """(doc_id, row_id, doc_words, piece, start, n_words); piece is null for a document without words."""
    sized = docs.select("doc_id", F.monotonically_increasing_id().alias("row_id"), F.size(words_of(F.col("text"))).cast("long").alias("doc_words"))
    last = F.ceil(F.col("doc_words") / F.lit(max_len)).cast("long") - 1
    pieces = F.when(F.col("doc_words") > 0, F.sequence(F.lit(0).cast("long"), last))
    rows = sized.withColumn("piece", F.explode_outer(pieces)).withColumn("start", F.col("piece") * max_len)
    length = F.when(F.col("piece").isNotNull(), F.least(F.lit(max_len), F.col("doc_words") - F.col("start")))
    return rows.withColumn("n_words", length.cast("long"))


def pack(docs: DataFrame, max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = BUDGET, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per piece: doc_id, doc_words, piece, start, n_words, bucket, bucket_len, padding, batch, slot.

    A batch holds ``budget // bucket_len`` pieces of one bucket (at least one).
    """
    pieces = materialise(pieces_of(docs, max_len), "pieces")
    histogram = pieces.where("piece is not null").groupBy("n_words").agg(F.count(F.lit(1)).alias("n"))
    counts = {row["n_words"]: row["n"] for row in histogram.collect()}  # at most max_len rows
    bounds = best_boundaries(counts, buckets)
    if not bounds:
        bounds = [max_len]
    sizes = [sum(n for x, n in counts.items() if low < x <= high) for low, high in zip([0, *bounds], bounds, strict=False)]
    groups = [max(1, -(-n // group_rows)) for n in sizes]
    bucket = sum(((F.col("n_words") > b).cast("int") for b in bounds[:-1]), F.lit(0))

    def of_bucket(values: list[int]):
        return F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("bucket") + 1)

    rows = pieces.where("piece is not null").withColumn("bucket", bucket).withColumn("bucket_len", of_bucket(bounds).cast("long"))
    order = F.xxhash64("doc_id", "piece", "row_id")
    rows = rows.withColumn("group", F.pmod(F.xxhash64("piece", "doc_id", "row_id", F.lit(7)), of_bucket(groups).cast("long")))
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("bucket", "group").orderBy(order, "doc_id", "piece", "row_id")) - 1)
    per_batch = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.col("bucket_len")))
    batch = F.concat_ws("-", "bucket", "group", F.floor(F.col("at") / per_batch))
    packed = rows.select(
        "doc_id", "doc_words", "piece", "start", "n_words", "bucket", "bucket_len",
        (F.col("bucket_len") - F.col("n_words")).alias("padding"), batch.alias("batch"), (F.col("at") % per_batch).alias("slot"),
    )
    nothing = pieces.where("piece is null")
    for name, kind in packed.dtypes:
        if name not in nothing.columns:
            nothing = nothing.withColumn(name, F.lit(None).cast(kind))
    return packed.unionByName(nothing.select(packed.columns))
