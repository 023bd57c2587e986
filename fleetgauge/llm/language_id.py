"""Language identification with language-bitmask n-gram filters.

Each language's frequent character n-grams go into one bit-sliced Bloom filter:
a slot holds a bitmask with one bit per language, so the AND over an n-gram's
slots returns all languages that contain it.  A text is judged by per-language
popcounts over all its n-grams, each corrected for the false positives that
the language's share of set bits leads to.

The filter is learnt from labelled rows: about ``SAMPLE`` documents per
language, chosen by hash, with their whole texts.  An n-gram belongs to a
language if it makes up at least ``MIN_RATE`` of the language's n-grams (so
there are at most ``1 / MIN_RATE`` per language) and at least ``MIN_SHARE`` of
its rate in the language where it is most frequent.

Defined results: null, empty and letterless texts give ``und`` with score 0;
ties go to the language first by code point; rows without id or language are
predicted but never learnt from; without any labelled row all texts are
``und``; other columns of the input are ignored by :func:`predict` and passed
on by :func:`keep_identified`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import columns_of, materialise, remainder
from fleetgauge.llm.ngrams import ORDERS, grams, mix, normalised

UND = "und"
FOLDS, HELD_OUT = 3, 1
SAMPLE = 4000
MIN_RATE = 1e-5
MIN_SHARE = 0.05
SLOTS = 1 << 20
HASHES = 3
#: Texts whose best language explains less than this share of their n-grams are rejected by the filter stage.
MIN_SCORE = 0.5


@dataclass
class BitmaskFilter:
    """``table[g][slot]`` has bit b set for language ``64 * g + b``."""

    languages: list[str]
    table: np.ndarray
    false_rate: np.ndarray

    @classmethod
    def build(cls, found: dict[str, np.ndarray], slots: int = SLOTS) -> BitmaskFilter:
        languages = sorted(found)
        table = np.zeros((max(1, -(-len(languages) // 64)), slots), np.uint64)
        fill = np.zeros(len(languages))
        for k, lang in enumerate(languages):
            group, bit = table[k // 64], np.uint64(1 << (k % 64))
            for at in cls.slots_of(found[lang].view(np.uint64), slots):
                group[at] |= bit
            fill[k] = ((group & bit) != 0).mean()
        return cls(languages, table, np.minimum(fill**HASHES, 0.99))

    @staticmethod
    def slots_of(hashed: np.ndarray, slots: int) -> Iterator[np.ndarray]:
        low, high = hashed, mix(hashed) | np.uint64(1)
        for k in range(HASHES):
            yield ((low + np.uint64(k) * high) % np.uint64(slots)).astype(np.int64)

    def counts(self, text: str | None) -> tuple[int, np.ndarray]:
        """Number of n-grams and, per language, how many of them its filter has."""
        n, hits = 0, np.zeros(len(self.languages), np.int64)
        for hashed in grams(normalised(text), ORDERS):
            n += len(hashed)
            where = list(self.slots_of(hashed, self.table.shape[1]))
            for g, table in enumerate(self.table):
                mask = table[where[0]]
                for at in where[1:]:
                    mask &= table[at]
                for b in range(min(64, len(self.languages) - 64 * g)):
                    hits[64 * g + b] += int(np.count_nonzero(mask & np.uint64(1 << b)))
        return n, hits

    def decide(self, text: str | None) -> tuple[str, float]:
        n, hits = self.counts(text)
        if not n or not self.languages:
            return UND, 0.0
        share = np.clip((hits / n - self.false_rate) / (1 - self.false_rate), 0.0, 1.0)
        best = int(np.argmax(share))
        return self.languages[best], float(share[best])


def learn(docs: DataFrame, sample: int = SAMPLE, folds: int = FOLDS, held_out: int = HELD_OUT) -> BitmaskFilter:
    """Filter learnt from rows with an id of the other folds, a language and a text."""
    rows = docs.where((remainder(F.col("doc_id"), folds) != held_out) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    rate = F.least(F.lit(1.0), F.lit(float(sample)) / F.col("n"))
    picked = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("rate") * (1 << 20)
    # One row per language.
    rates = {row["lang"]: row["rate"] for row in sizes.select("lang", rate.alias("rate")).collect()}
    if not rates:
        return BitmaskFilter.build({})
    known = F.create_map(*[F.lit(x) for pair in rates.items() for x in pair])
    rows = rows.withColumn("rate", F.element_at(known, F.col("lang"))).where(picked).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in batch.column(0).unique().to_pylist():
                texts = batch.filter(pa.compute.equal(batch.column(0), lang)).column(1)
                held: list[np.ndarray] = []
                size = 0
                for text in texts:
                    for hashed in grams(normalised(text.as_py()), ORDERS):
                        held.append(hashed)
                        size += len(hashed)
                        if size > 1 << 21:
                            yield counted(lang, held)
                            held, size = [], 0
                if held:
                    yield counted(lang, held)

    def counted(lang: str, held: list[np.ndarray]) -> pa.RecordBatch:
        gram, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(gram.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    found = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = materialise(found, "grams")
    total = {r["lang"]: r["n"] for r in found.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not total:
        return BitmaskFilter.build({})
    totals = F.create_map(*[F.lit(x) for pair in total.items() for x in pair])
    rated = found.withColumn("rate", F.col("n") / F.element_at(totals, F.col("lang"))).where(F.col("rate") >= MIN_RATE)
    grouped = rated.groupBy("gram").agg(F.max("rate").alias("most"), F.collect_list(F.struct("lang", "rate")).alias("each"))
    kept = grouped.select("gram", "most", F.explode("each").alias("x")).where(F.col("x.rate") >= MIN_SHARE * F.col("most"))
    local = kept.select("gram", F.col("x.lang").alias("lang")).toArrow()  # at most 1 / MIN_RATE rows per language
    lang, gram = np.array(local.column("lang").to_pylist(), object), local.column("gram").to_numpy()
    return BitmaskFilter.build({x: gram[lang == x] for x in total})


def judged(docs: DataFrame, model: BitmaskFilter, columns: list) -> DataFrame:
    """``columns`` of the documents, named c0, c1, ..., with lang_pred and score.

    Columns go by position, so that any names pass.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.table, model.false_rate))
    names = [f"c{k}" for k in range(len(columns))]
    rows = docs.select(*columns, F.col("text")).toDF(*names, "text")
    schema = rows.drop("text").schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filt = BitmaskFilter(*shared.value)
        for batch in batches:
            found = [filt.decide(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            extra = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *extra], schema.names)

    return rows.mapInArrow(run, schema)


def predict(docs: DataFrame, model: BitmaskFilter | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    model = model or learn(docs)
    held = F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    found = judged(docs, model, [F.col("doc_id"), held])
    return found.toDF("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, model: BitmaskFilter | None = None, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents whose language is identified with at least ``min_score``."""
    model = model or learn(docs)
    found = judged(docs, model, columns_of(docs)).where((F.col("lang_pred") != UND) & (F.col("score") >= min_score))
    return found.drop("lang_pred", "score").toDF(*docs.columns)
