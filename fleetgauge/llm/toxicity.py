"""Toxicity by maximum-scoring segments.

Tokens and their beginnings (which stand for a stem's inflected forms) get
log-odds of standing in toxic rather than in other labelled documents, smoothed
by a Dirichlet prior in proportion to their overall frequency.  Where they are
significant, a token scores the highest of them, less the drift that every
token costs.  A linear scan finds all maximal scoring segments of a
whole text, an extreme-value law turns a segment's score and the text's length
into an expected number of such segments by chance, and a logistic curve over
the summed evidence of the significant segments gives the document's score.

Labels are learnt only from rows whose crc32 remainder isn't the held-out one:
at most ``SAMPLE`` labelled documents, the first by a hash of the id, with
their whole texts.  Label, language, source and id are no input of a score.

Defined results: null, empty and wordless texts have no segment and get the
score of a text without evidence; rows without id are scored and never learnt
from; without labels every score is the prior 0; of several labels of one id
the highest counts; repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import hash_sample, materialise, remainder
from fleetgauge.llm.segments import maximal_segments, score_rate, tokens_of, units_of

FOLDS, HELD_OUT = 5, 0
SAMPLE = 20000
#: Strength of the prior in documents, least standard score, least toxic documents and most tokens kept.
PRIOR, Z_LEAST, DF_LEAST, TERMS = 100.0, 4.0, 5, 10000
#: Score that each token costs.
DRIFT = 0.05
#: A segment is significant below this expected number by chance.
EXPECTED = 1.0
#: Tokens whose weight a task remembers.
REMEMBERED = 1 << 17


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    rate: float = 1.0
    scale: float = 1.0
    intercept: float = -30.0
    slope: float = 0.0

    def __post_init__(self) -> None:
        self._known: dict[str, float | None] = {}

    def weight(self, token: str) -> float | None:
        """Score of a token above the drift; None for most tokens."""
        known = self._known
        if token not in known:
            if len(known) >= REMEMBERED:
                known.clear()
            known[token] = max((self.weights[u] for u in units_of(token) if u in self.weights), default=None)
        return known[token]

    def hits(self, text: str | None) -> tuple[int, list[tuple[int, float]]]:
        tokens = tokens_of(text)
        return len(tokens), [(i, w) for i, w in enumerate(map(self.weight, tokens)) if w is not None]

    def segments(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of tokens and the maximal segments (first token, last token, score)."""
        n, hits = self.hits(text)
        return n, maximal_segments(hits, DRIFT)

    def significant(self, text: str | None) -> list[tuple[int, int, float, float]]:
        """(first token, last token, score, evidence): evidence is -log of the expected number."""
        n, found = self.segments(text)
        rated = [(a, b, s, self.rate * s - log(self.scale * max(n, 1))) for a, b, s in found]
        return [x for x in rated if x[3] > -log(EXPECTED)]

    def evidence(self, text: str | None) -> float:
        return sum(x[3] for x in self.significant(text))

    def score(self, evidence: float) -> float:
        at = self.intercept + self.slope * evidence
        return 1 / (1 + exp(-at)) if at > -700 else 0.0


def training_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(text, toxic) of at most ``sample`` labelled documents of the other folds, as a table; of rows with one id the first text counts."""
    usable = labels.where(F.col("toxic").isNotNull() & (remainder(F.col("doc_id"), FOLDS) != HELD_OUT))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("__fg_toxic"))
    chosen = hash_sample(usable, "doc_id", sample).withColumnRenamed("doc_id", "__fg_id")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__fg_id"))
    rows = rows.groupBy("__fg_id").agg(F.min("text").alias("text"), F.first("__fg_toxic").alias("toxic"))
    return materialise(rows.select("text", "toxic"), "labelled")


def _unit_counts(rows: DataFrame) -> DataFrame:
    """(unit, docs0, docs1): labelled documents with each unit; the empty one counts all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs: Counter = Counter()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                units = {u for t in set(tokens_of(text)) for u in units_of(t)}
                docs.update((u, toxic) for u in {*units, ""})
            columns = [pa.array([k[0] for k in docs], pa.string()), pa.array([k[1] for k in docs], pa.int32()), pa.array(docs.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["unit", "toxic", "docs"])

    found = rows.select("text", "toxic").mapInArrow(run, "unit string, toxic int, docs long").groupBy("unit")
    return found.agg(*[F.sum(F.when(F.col("toxic") == k, F.col("docs")).otherwise(0)).alias(f"docs{k}") for k in (0, 1)])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    rows = training_rows(docs, labels, sample)
    counts = materialise(_unit_counts(rows), "unit-counts")
    whole = counts.where("unit = ''").first()
    if whole is None or not whole["docs0"] or not whole["docs1"]:
        return ToxicityModel({})
    n0, n1 = whole["docs0"], whole["docs1"]
    # Log-odds of the document frequencies: a text full of one word counts once.
    prior = F.lit(PRIOR) * (F.col("docs0") + F.col("docs1")) / F.lit(float(n0 + n1))
    a1, a0 = F.col("docs1") + prior, F.col("docs0") + prior
    delta = F.log(a1 / (F.lit(n1 + PRIOR) - a1)) - F.log(a0 / (F.lit(n0 + PRIOR) - a0))
    rated = counts.where((F.col("unit") != "") & (F.col("docs1") >= DF_LEAST)).withColumn("delta", delta)
    rated = rated.withColumn("z", F.col("delta") / F.sqrt(1 / a1 + 1 / a0)).where(F.col("z") >= Z_LEAST)
    kept = rated.orderBy(F.col("z").desc(), "unit").limit(TERMS).select("unit", "delta").collect()
    model = ToxicityModel({r["unit"]: r["delta"] - DRIFT for r in kept if r["delta"] > DRIFT})
    if not model.weights:
        return model
    clean = rows.where("toxic = 0").select("text")
    uses = {r["weight"]: r["n"] for r in _clean_hits(clean, model).collect()}  # one row per weight
    tokens = max(uses.pop(0.0, 0), 1)
    model.rate = score_rate([(uses.get(w, 0.5) / tokens, w) for w in {*uses, max(model.weights.values())}], DRIFT)
    # Texts of n tokens have K n exp(-rate * s) segments of score s or more by
    # chance; K follows from how many reach the least weight.
    segments = max(_count_segments(clean, model), 0.5)
    model.scale = segments / tokens * exp(model.rate * min(model.weights.values()))
    pairs = _evidence(rows.select("text", "toxic"), model).toArrow()  # at most SAMPLE rows
    x, y = pairs.column("evidence").to_numpy(), pairs.column("toxic").to_numpy().astype(float)
    model.intercept, model.slope = logistic(x, y)
    return model


def _clean_hits(clean: DataFrame, model: ToxicityModel) -> DataFrame:
    """(weight, n): uses of each weight; weight 0 counts all tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uses: Counter = Counter()
            for text in batch.column(0):
                n, hits = model.hits(text.as_py())
                uses[0.0] += n
                uses.update(w for _, w in hits)
            yield pa.RecordBatch.from_arrays([pa.array(uses.keys(), pa.float64()), pa.array(uses.values(), pa.int64())], ["weight", "n"])

    return clean.mapInArrow(run, "weight double, n long").groupBy("weight").agg(F.sum("n").alias("n"))


def _count_segments(clean: DataFrame, model: ToxicityModel) -> int:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [len(model.segments(t.as_py())[1]) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["segments"])

    return clean.mapInArrow(run, "segments long").agg(F.sum("segments")).first()[0] or 0


def _evidence(rows: DataFrame, model: ToxicityModel) -> DataFrame:
    """The other columns of ``rows`` and the evidence of each text (first column)."""
    schema = rows.select(rows.columns[1:]).schema.add("evidence", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([model.evidence(t.as_py()) for t in batch.column(0)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], found], schema.names)

    return rows.mapInArrow(run, schema)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Intercept and slope of a logistic regression, by Newton steps on the standardised input."""
    spread = float(x.std()) or 1.0
    design = np.c_[np.ones(len(x)), x / spread]
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (y - p) - ridge * beta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + step * min(1.0, 5 / max(float(np.abs(step).max()), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1] / spread)


def predict(docs: DataFrame, labels: DataFrame, model: ToxicityModel | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = model or learn(docs, labels)
    held = F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out")
    found = _evidence(docs.select("text", "doc_id", held), model)
    at = F.lit(model.intercept) + F.lit(model.slope) * F.col("evidence")
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-at))
    rows = found.select("doc_id", "held_out", score.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def passages(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Every significant passage: doc_id, first_token, last_token, segment_score, evidence, passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rest = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = tokens_of(text)
                for a, b, s, e in model.significant(text):
                    ids.append(doc_id)
                    rest.append((a, b, s, e, " ".join(tokens[a : b + 1])))
            columns = [ids, *([x[k] for x in rest] for k in range(5))]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    names = ["doc_id", "first_token", "last_token", "segment_score", "evidence", "passage"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, first_token long, last_token long, segment_score double, evidence double, passage string")
