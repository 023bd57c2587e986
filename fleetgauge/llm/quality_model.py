"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or abstain on each document.  Counts of the
vote patterns over all documents go into expectation maximisation, which
estimates every labeller's rates of each vote in good and in bad documents;
the posterior of a document's pattern is its label.  These labels train a
linear scorer over hashed words and word shapes, with each document as a good
and a bad example weighted by its posterior.

Every text is read once: one pass of Arrow batches writes each document's votes
and hashed features into a table, and learning and scoring read that table.
The scorer is fitted on at most ``SAMPLE`` documents, the first by a hash of
the id, with the features of their whole texts.  ``labels`` is never read.

Defined results: null, empty and blank texts are bad by vote and score like
texts without features; rows without id are scored and counted but not trained
on; repeated rows get equal results; an empty table gives no rows, a corpus of
which all posteriors agree gets them as scores; other columns are ignored.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import hash_sample, materialise

SAMPLE = 10000
FEATURES = 1 << 14
#: Documents at or above this score are kept.
KEEP = 0.5
#: Share of good documents EM starts from, and votes added to each cell.
START, SMOOTH = 0.8, 1.0
GOOD, BAD, ABSTAIN = 1, 0, -1
NAMES = ("length", "symbols", "capitals", "stress", "bare_words", "echo", "variety", "pairs", "letters", "plain_words", "word_length")
#: Distinct words a task remembers the shape and hashes of; then it starts anew.
REMEMBERED = 1 << 17

SYMBOLS = frozenset("#*$%&|<>{}\\^~=_")
LETTER = regex.compile(r"\p{L}")
LETTER_OR_DIGIT = regex.compile(r"[\p{L}\p{N}]")
PLAIN = regex.compile(r"\p{L}+[.,;:]?")
SIGNS = ((regex.compile(r"[A-Z]"), "A"), (regex.compile(r"\p{Lu}"), "À"), (regex.compile(r"\p{Ll}"), "a"), (regex.compile(r"\p{N}"), "0"))
REPEATED, KEPT = regex.compile(r"([Aa0])\1+"), r"\1"


def _slot(token: str) -> int:
    return xxhash.xxh32_intdigest(token.encode("utf-8", "surrogatepass"), 42) % FEATURES


class Signs(dict):
    """For ``str.translate``: capitals, small letters and numbers become A (beyond ASCII: À), a and 0; filled as code points come."""

    def __missing__(self, point: int) -> int:
        sign = chr(point)
        for pattern, out in SIGNS:
            if pattern.match(sign):
                sign = out
                break
        self[point] = ord(sign)
        return self[point]


class WordTable:
    """Per distinct word: code points, letters, symbols, capitals, stress marks, bare, plain, and two feature slots."""

    def __init__(self) -> None:
        self.at: dict[bytes, int] = {}
        self.rows = np.zeros((1024, 9), np.int64)
        self.signs = Signs()
        self.forms: dict[str, tuple[int, ...]] = {}

    def look_up(self, counts: Counter[bytes]) -> np.ndarray:
        """One row per word of ``counts``, in its order."""
        if len(self.at) > REMEMBERED:
            self.at = {}
        if len(self.forms) > REMEMBERED:
            self.forms = {}
        for word in counts:
            if word not in self.at:
                if len(self.at) == len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                self.rows[len(self.at)] = self.describe(word.decode("utf-8", "replace"))
                self.at[word] = len(self.at)
        return self.rows[np.fromiter(map(self.at.__getitem__, counts), np.int64, len(counts))]

    def describe(self, word: str) -> tuple[int, ...]:
        form = word.translate(self.signs)
        found = self.forms.get(form)
        if found is None:
            found = self.forms[form] = describe_form(form)
        return (*found, _slot(word.lower()))


def describe_form(form: str) -> tuple[int, ...]:
    """What all words of one form (the word with A, a and 0 for its letters and digits) have in common."""
    return (
        len(form),
        len(LETTER.findall(form)),
        sum(c in SYMBOLS for c in form),
        form.count("A"),
        form.count("!") + form.count("?"),
        LETTER_OR_DIGIT.search(form) is None,
        PLAIN.fullmatch(form) is not None,
        _slot("~" + REPEATED.sub(KEPT, form.replace("À", "A"))),
    )


SAME, OTHER = _slot("=same"), _slot("=other")


def judge_text(text: bytes | None, table: WordTable) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Votes in the order of ``NAMES``, feature slots and their counts.

    The features are words, word shapes (one sign for a run of small letters,
    capitals or digits) and whether a word repeats the one before.  The
    labellers overlap on purpose.
    """
    text = text or b""
    words = text.split()  # of bytes: at 0x20 and 0x09-0x0D only
    n = len(words)
    counts = Counter(words)
    rows = table.look_up(counts)
    times = np.fromiter(counts.values(), np.int64, len(counts))
    in_words, letters, symbols, upper, stress, bare, plain = (times @ rows[:, :7]).tolist()
    chars = max(1, len(text.decode("utf-8", "replace")))
    again = sum(map(operator.eq, words, words[1:]))
    some = max(n, 1)
    pairs = len(set(zip(words, words[1:], strict=False))) / some
    distinct, mean = len(counts) / some, in_words / some
    long = n >= 20

    def vote(good: bool, bad: bool) -> int:
        return BAD if bad else GOOD if good else ABSTAIN

    votes = [
        vote(long, n == 0),
        vote(long and symbols / chars < 0.02, symbols / chars > 0.05),
        vote(long and upper / chars < 0.1, long and upper / chars > 0.3),
        vote(long and stress / chars < 0.01, long and stress / chars > 0.04),
        vote(long and bare / some < 0.05, long and bare / some > 0.2),
        vote(long and again / some < 0.1, long and again / some > 0.3),
        vote(long and distinct > 0.4, n >= 50 and distinct < 0.25),
        vote(long and pairs > 0.7, long and pairs < 0.5),
        vote(long and letters / max(in_words, 1) > 0.9, long and letters / max(in_words, 1) < 0.75),
        vote(long and plain / some > 0.8, long and plain / some < 0.6),
        vote(long and 3 <= mean <= 8, long and not 2 <= mean <= 12),
    ]
    slots = np.r_[rows[:, 7], rows[:, 8], SAME, OTHER]
    slots, where = np.unique(slots, return_inverse=True)
    weights = np.bincount(where, np.r_[times, times, again, max(n - 1 - again, 0)], len(slots)).astype(np.int32)
    return votes, slots[weights > 0].astype(np.int16), weights[weights > 0]


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, one vote column per labeller (prefix ``vote_``), slots and counts of the features; reads every text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = [judge_text(t.as_py(), table) for t in part.column(1)]
                votes = np.array([f[0] for f in found], np.int8)
                ends = pa.array(np.r_[0, np.cumsum([len(f[1]) for f in found])].astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([f[k] for f in found]))) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(v) for v in votes.T], *lists], names)

    names = ["doc_id", *[f"vote_{k}" for k in NAMES], "slots", "counts"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    votes = ", ".join(f"vote_{k} byte" for k in NAMES)
    return rows.mapInArrow(run, f"doc_id long, {votes}, slots array<short>, counts array<int>")


@dataclass
class LabelModel:
    """Share of good documents and, per labeller and class, the rates of bad and good among its votes.

    An abstention says nothing about the class.
    """

    names: list[str]
    good: float = START
    rates: np.ndarray = field(default_factory=lambda: np.zeros((0, 2, 2)))

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of good for each row of votes."""
        odds = np.log(self.good) - np.log(1 - self.good)
        ratio = np.log(self.rates[:, 1, :]) - np.log(self.rates[:, 0, :])
        by_vote = np.where(patterns == GOOD, ratio[:, 1], np.where(patterns == BAD, ratio[:, 0], 0.0))
        return 1 / (1 + np.exp(-np.clip(odds + by_vote.sum(axis=1), -700, 700)))


def fit_labels(patterns: np.ndarray, counts: np.ndarray, names: list[str], rounds: int = 200) -> LabelModel:
    """Expectation maximisation over distinct vote patterns and their counts.

    It starts from the share of good among each pattern's votes, which fixes
    that good is the class labellers mean by it.
    """
    model = LabelModel(names)
    votes = np.stack([patterns == BAD, patterns == GOOD]).astype(float)
    goods, bads = votes[1].sum(axis=1), votes[0].sum(axis=1)
    # One bad vote outweighs several good ones: a text has many ways to be sound in and one to fail.
    p = (goods + START) / (goods + len(names) * bads + 1.0)
    for _ in range(rounds):
        weights = np.stack([counts * (1 - p), counts * p])
        model.good = float(np.clip(weights[1].sum() / max(weights.sum(), 1e-9), 1e-3, 1 - 1e-3))
        # rates[labeller, class, vote]
        rates = SMOOTH + np.einsum("kp,vpj->jkv", weights, votes)
        model.rates = rates / rates.sum(axis=2, keepdims=True)
        new = model.posterior(patterns)
        done = np.abs(new - p).max(initial=0.0) < 1e-9
        p = new
        if done:
            break
    return model


def learn_labels(votes: DataFrame) -> tuple[LabelModel, DataFrame]:
    """The label model, and (votes..., posterior): one row per pattern, at most 3 to the number of labellers."""
    names = [c for c in votes.columns if c.startswith("vote_")]
    found = votes.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()
    patterns = np.array([[r[c] for c in names] for r in found], int).reshape(len(found), len(names))
    counts = np.array([r["n"] for r in found], float)
    model = fit_labels(patterns, counts, names)
    posterior = model.posterior(patterns) if len(found) else np.zeros(0)
    rows = [(*map(int, pattern), float(p)) for pattern, p in zip(patterns, posterior, strict=True)]
    schema = ", ".join([*(f"{c} byte" for c in names), "posterior double"])
    return model, votes.sparkSession.createDataFrame(rows, schema)


def fit_scorer(train: DataFrame) -> tuple[np.ndarray, float]:
    """Weights and intercept of the logistic scorer, from (slots, counts, posterior) of at most ``SAMPLE`` rows."""

    def vector(slots, counts):
        total = float(sum(counts)) or 1.0
        return SparseVector(FEATURES, slots, [c / total for c in counts])

    both = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("posterior").alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("posterior")).alias("weight"))))
    rows = train.select(F.udf(vector, VectorUDT())("slots", "counts").alias("features"), both.alias("example"))
    examples = rows.select("features", "example.label", "example.weight").where("weight > 1e-6")
    fitted = LogisticRegression(weightCol="weight", regParam=1e-5, maxIter=50, standardization=True).fit(examples)
    return fitted.coefficients.toArray(), float(fitted.intercept)


def scored(rows: DataFrame, weights: np.ndarray, intercept: float) -> DataFrame:
    """(doc_id, posterior, score) by the linear scorer; its weights are one fixed-size array."""
    shared = rows.sparkSession.sparkContext.broadcast((weights, intercept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = shared.value
        for batch in batches:
            slots, counts = batch.column(2), batch.column(3)
            row = np.repeat(np.arange(batch.num_rows), np.diff(slots.offsets.to_numpy()))
            count = counts.flatten().to_numpy()
            of_row = np.bincount(row, count * weight[slots.flatten().to_numpy()], batch.num_rows)
            total = np.bincount(row, count, batch.num_rows)
            margin = bias + of_row / np.maximum(total, 1)
            score = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["doc_id", "posterior", "score"])

    return rows.select("doc_id", "posterior", "slots", "counts").mapInArrow(run, "doc_id long, posterior double, score double")


def classify(docs: DataFrame, sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """One row per document: doc_id, weak_label (posterior of its votes), score, kept."""
    table = materialise(judged(docs), "votes")
    names = [c for c in table.columns if c.startswith("vote_")]
    _, patterns = learn_labels(table.select(names))
    rows = table.join(F.broadcast(patterns), names)  # every pattern of the table is there
    ids = hash_sample(table.where("doc_id is not null").select("doc_id").distinct(), "doc_id", sample)
    # One row per sampled id, however often it is repeated: at most ``sample`` rows.
    one = F.min(F.struct("slots", "counts", "posterior")).alias("one")
    train = rows.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(one).select("one.*")
    train = materialise(train, "weakly-labelled")
    edges = train.agg(F.min("posterior"), F.max("posterior")).first()
    if edges[0] is None or edges[1] - edges[0] < 1e-6:
        rows = rows.select("doc_id", "posterior", F.col("posterior").alias("score"))
    else:
        rows = scored(rows, *fit_scorer(train))
    return rows.select("doc_id", F.col("posterior").alias("weak_label"), "score", (F.col("score") >= keep).alias("kept"))
