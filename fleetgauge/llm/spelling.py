"""Spelling variant grouping: each word's frequent near word, and the word at the end of that chain.

1. Words of whole texts are counted (built-in functions, with map-side combine).
2. The vocabulary is sorted by range; each task cuts its range into shards of
   at most ``SHARD`` words and builds a compact trie of each (``trie``).
3. Shards are broadcast in rounds of at most ``ROUND_BYTES``, the size bound
   of the broadcast, and read by the driver round by round; all words
   meet every shard, each by its distance-one Levenshtein automaton.  A round's
   rows are a table of the shared folder, so it needs no broadcast afterwards.
4. Counts of near words add up over rounds, and the best of all is the form;
   roots follow by doubling the steps along forms.  Each step leads to a word
   at least ``TIMES`` as frequent, so chains are short and have no cycle.

Defined results: null and empty texts have no words; a null id is written as
an empty text in the hash; repeated rows count as often as they occur; ties go
to the smaller word by code point; no words give no rows; other columns of the
input are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import discard, materialise
from fleetgauge.llm.trie import Trie, blocks_of, near

MIN_LENGTH, MIN_COUNT = 7, 2
#: A form is at least so many times as frequent as the word.
TIMES = 10
#: One word in so many is damaged on purpose, by a hash of document and word.
NOISE = 31
#: Words of one shard at most, and bytes of the shards of one broadcast.
SHARD = 1 << 18
ROUND_BYTES = 48 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, noise: int | None = NOISE) -> DataFrame:
    """(word, n) of all words of at least ``min_length`` code points and ``min_count`` occurrences."""
    # A greedy run of at least so many letters is always a whole run; damage only shortens it.
    runs = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(rf"([A-Za-zÀ-ÿ]{{{min_length},}})"), F.lit(1))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    word = F.translate("run", UPPER, UPPER.lower())
    if noise:
        runs = runs.select(word.alias("run"), F.crc32(F.concat_ws(":", "id", word).cast("binary")).alias("h"))
        cut = F.pmod("h", F.length("run")).cast("int")
        less = F.concat(F.col("run").substr(F.lit(1), cut), F.col("run").substr(cut + 2, F.length("run")))
        word = F.when(F.col("h") % noise == 0, less).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).where(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def shards(words: DataFrame, total: int, size: int = SHARD) -> DataFrame:
    """(first, bytes, body): tries over ranges of the words, which hold Latin-1 letters only."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts = [], []
        for batch in batches:
            held += batch.column(0).to_pylist()
            counts.append(batch.column(1).to_numpy())
            while len(held) >= size:
                n = np.concatenate(counts)
                yield packed(held[:size], n[:size])
                held, counts = held[size:], [n[size:]]
        if held:
            yield packed(held, np.concatenate(counts))

    def packed(part: list[str], n: np.ndarray) -> pa.RecordBatch:
        coded = [w.encode("latin-1") for w in part]
        body = pickle.dumps((tuple(Trie.build(coded)), b"\n".join(coded), n), protocol=5)
        return pa.RecordBatch.from_arrays([pa.array([part[0]]), pa.array([len(body)]), pa.array([body], pa.binary())], ["first", "bytes", "body"])

    parts = max(1, -(-total * 2 // size))
    ranged = words.select("word", "n").repartitionByRange(parts, "word").sortWithinPartitions("word")
    return ranged.mapInArrow(build, "first string, bytes long, body binary")


def near_words(words: DataFrame, tries: list[bytes]) -> DataFrame:
    """(word, n_near, best_n, best) of the words that have near words in some of these shards."""
    shared = words.sparkSession.sparkContext.broadcast(tries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = [pickle.loads(body) for body in shared.value]
        loaded = [(Trie(*arrays), text, n) for arrays, text, n in loaded]
        names = [w for _, text, _ in loaded for w in text.split(b"\n")]
        n = np.concatenate([x[2] for x in loaded])
        base = np.cumsum([0, *(len(x[2]) for x in loaded)])
        for batch in batches:
            coded = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            for part, chars, size in blocks_of(coded):
                met = [near(trie, chars, size) for trie, _, _ in loaded]
                row = np.concatenate([x[0] for x in met])
                word = np.concatenate([x[1] + b for x, b in zip(met, base, strict=False)])
                order = np.lexsort((word, -n[word], row))
                row, word = row[order], word[order]
                head = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else row
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(part[row[head]])),
                        pa.array(np.diff(np.r_[head, len(row)]).astype(np.int64)),
                        pa.array(n[word[head]]),
                        pa.array([names[k].decode("latin-1") for k in word[head]], pa.string()),
                    ],
                    ["word", "n_near", "best_n", "best"],
                )

    return words.select("word").mapInArrow(run, "word string, n_near long, best_n long, best string")


def variants(docs: DataFrame, size: int = SHARD, round_bytes: int = ROUND_BYTES, noise: int | None = NOISE) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    words = materialise(vocabulary(docs, noise=noise), "vocabulary")
    total = words.count()
    table = materialise(shards(words, total, size), "shards")
    found = None
    for names in rounds(table, round_bytes):
        # One broadcast: at most round_bytes, or a single shard of at most ``size`` words.
        tries = [r["body"] for r in table.where(F.col("first").isin(names)).orderBy("first").select("body").toLocalIterator()]
        part = materialise(near_words(words, tries), "near-words")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = words.select("word", F.col("n").alias("n_near"), F.col("n").alias("best_n"), F.col("word").alias("best")).limit(0)
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("b"))
    taken = -F.col("b.m") >= TIMES * F.col("n")
    formed = words.join(best, "word", "left").select(
        "word", F.when(taken, F.col("b.best")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(taken, -F.col("b.m")).alias("form_n"),
    )
    formed = materialise(formed, "forms")
    discard(table)
    ends = roots(formed.where("form is not null").select("word", F.col("form").alias("root")))
    found = formed.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def rounds(table: DataFrame, most: int) -> Iterator[list[str]]:
    """First words of the shards of each round, in order; a round has at most ``most`` bytes or one shard."""
    names, held = [], 0
    # Names and sizes only: one short row for each ``SHARD`` words of the vocabulary.
    for row in table.select("first", "bytes").orderBy("first").toLocalIterator():
        if names and held + row["bytes"] > most:
            yield names
            names, held = [], 0
        names.append(row["first"])
        held += row["bytes"]
    if names:
        yield names


def roots(steps: DataFrame) -> DataFrame:
    """(word, root): the end of each chain of ``steps`` (word, root), by doubling.

    A word has few near words, so no key of the join is large.
    """
    steps = materialise(steps, "roots")
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = materialise(steps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(steps)
        steps = longer.select("word", "root")
        steps.scratch_path = longer.scratch_path
        if longer.where("moved").isEmpty():
            return steps
