"""Mixing sources to target weights.

Words are aggregated per source, weights and caps give each source a target
and so a repetition rate, and every document is emitted floor(rate) times plus
one hash-seeded Bernoulli copy with probability equal to the fraction.

Independent coins would let a few long documents move a small source off its
target.  So the coins of a stratum (documents of one source whose sizes have
the same power of two, split by hash into groups of about ``GROUP_ROWS``) share
one seeded offset: in order of size, ties by the document's hash, the k-th gets
its copy when the fraction times k plus the offset passes a whole number.  The
offset is uniform, so each document's probability is the fraction exactly, and
the copies of a group number its expectation rounded up or down.  All
documents go by this one rule.

Defined results: null text has size 0; a null source is a source, last in
order; a source without words has target and rate 0; rows that repeat id, text
and source share one coin; rows without id go by their texts; an empty table
gives an empty mix; other columns are ignored by :func:`plan_mix` and passed on
by :func:`emit`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.llm.common import columns_of, hot_join, materialise, words_of

WEIGHTS = (5, 2, 1)
#: All sources together give this share of all words.
SHARE = 1.5
#: No source gives more than this many times its words.
MOST = 2
SEED = "mix"
#: Documents that share one offset, about; bounds the rows of one task's window.
GROUP_ROWS = 500


def _unit(*parts: Column) -> Column:
    """Number in [0, 1) from the MD5 of the parts, the same in every run."""
    text = F.concat_ws("|", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(16**13))


def _draw() -> Column:
    """The document's own number in [0, 1), from its id and whole text."""
    return _unit(F.col("doc_id"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def _stratum(size: Column) -> Column:
    """Number of binary digits of a size."""
    return F.length(F.bin(size))


def _weighed(sums: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """``sums`` with each source's weight by its place in code-point order.

    Ranges of names are written with their number; only the count of each range
    comes to the driver, and places are counted inside a range.
    """
    name = F.col("source").asc_nulls_last()
    ranged = materialise(sums.repartitionByRange(name).withColumn("range", F.spark_partition_id()), "sources")
    counts = sorted((r["range"], r["count"]) for r in ranged.groupBy("range").count().toLocalIterator())
    starts, so_far = [], 0
    for number, n in counts:
        starts.append((number, so_far))
        so_far += n
    # One row per range, as many as shuffle partitions at most.
    first = sums.sparkSession.createDataFrame(starts, "range int, first long")
    place = F.col("first") + F.row_number().over(Window.partitionBy("range").orderBy(name)) - 1
    cycle = F.array(*[F.lit(w) for w in weights])
    rows = ranged.join(F.broadcast(first), "range")
    return rows.withColumn("weight", F.element_at(cycle, (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))).drop("range", "first")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: source, n_docs, source_size, target.

    All sources begin at one level of words per weight.  Those whose cap lies
    below it give their cap, and the rest raise the level for the others, until
    a round finds no more of them.  A round is one aggregate over the sources;
    nothing sorts or holds them in one task.
    """
    sums = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    weighed = materialise(_weighed(sums, weights), "weighed")
    whole = weighed.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    known, level = 0, 0.0
    if whole["weight"]:
        level = share * whole["size"] / whole["weight"]
    while True:
        under = weighed.where(F.lit(most) * F.col("source_size") < F.lit(level) * F.col("weight"))
        capped = under.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
        if capped["n"] <= known or capped["weight"] == whole["weight"]:
            break
        known, level = capped["n"], (share * whole["size"] - most * capped["size"]) / (whole["weight"] - capped["weight"])
    target = F.least(F.lit(float(most)) * F.col("source_size"), F.lit(float(level)) * F.col("weight"))
    return weighed.select("source", "n_docs", "source_size", target.alias("target"))


def _coins(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, draw, n_rows, copies, source_size, target): one row per coin."""
    sizes = docs.select("doc_id", "source", F.size(words_of(F.col("text"))).cast("long").alias("size"), _draw().alias("draw"))
    coins = materialise(sizes.groupBy("doc_id", "source", "size", "draw").agg(F.count(F.lit(1)).alias("n_rows")), "coins")
    name = F.to_json(F.struct("source"))
    coins = coins.withColumn("stratum", _stratum(F.col("size"))).withColumn("key", F.concat_ws("|", name, "stratum"))
    weighed = coins.groupBy("source", "size").agg(F.sum("n_rows").alias("n"))
    targets = source_targets(weighed.select("source", (F.col("size") * F.col("n")).alias("size")))
    # One row per source and power of two.
    strata = coins.groupBy("key", "source").agg(F.count(F.lit(1)).alias("n_coins"))
    same = F.col("s.source").eqNullSafe(F.col("t.source"))
    strata = strata.alias("s").join(targets.alias("t"), same).select("key", "n_coins", "source_size", "target")
    strata = materialise(strata, "strata")
    rows = hot_join(coins, strata, "key", "n_coins", coins.count())
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("rate", rate).withColumn("fraction", F.col("rate") - F.floor("rate"))
    rows = rows.withColumn("part", F.floor(F.col("draw") * F.ceil(F.col("n_coins") / GROUP_ROWS)))
    order = Window.partitionBy("key", "part").orderBy(F.col("size").desc(), "draw", "doc_id")
    rows = rows.withColumn("at", F.row_number().over(order)).withColumn("offset", _unit(F.lit("offset"), F.col("key"), F.col("part")))
    passed = F.floor(F.col("fraction") * F.col("at") + F.col("offset")) - F.floor(F.col("fraction") * (F.col("at") - 1) + F.col("offset"))
    copies = (F.floor("rate") + passed).cast("long")
    return rows.select("doc_id", "source", "size", "draw", "n_rows", copies.alias("copies"), "source_size", "target")


def plan_mix(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    rows = _coins(docs).withColumn("row", F.explode(F.sequence(F.lit(1), F.col("n_rows"))))
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit(docs: DataFrame) -> DataFrame:
    """The mix itself: the documents, each as often as the plan says."""
    plan = _coins(docs).where("copies > 0").select("doc_id", "source", "draw", "copies").toDF("id", "from", "draw", "copies")
    rows = docs.select(F.struct(*columns_of(docs)).alias("row"), F.col("doc_id"), F.col("source"), _draw().alias("draw"))
    same = F.col("d.doc_id").eqNullSafe(F.col("p.id")) & F.col("d.source").eqNullSafe(F.col("p.from")) & (F.col("d.draw") == F.col("p.draw"))
    taken = rows.alias("d").join(plan.alias("p"), same).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.select("row.*").toDF(*docs.columns)
