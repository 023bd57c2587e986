"""Quality rules: counts of a text, and its divergence from language references.

The reference of a language is its share of each character class and of its
most common words over all documents of that language.  A document is held
against all references by Jensen-Shannon distance and judged by the nearest
one.  Short texts have noisy histograms: each limit has a part that shrinks
with the square root of the length, and below a least length it isn't applied.

Only DataFrame functions run on the rows, and each row is judged on its own:
nothing but the reference counts is shuffled.

Defined results: null, empty and blank texts have zero counts and fail the
base rules; rows without a language are judged but add to no reference;
without any reference the method keeps all; repeated rows get equal results;
other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import materialise, words_of

#: Fixed classes; what is in none of them counts as "other", mostly letters.
CLASSES = {
    "symbol": r"[^#*$%&|<>]+",
    "digit": r"[^0-9]+",
    "space": r"[^\x20\x09-\x0D]+",
    "upper": r"[^A-Z]+",
    "stop": r"[^.,;:!?'\"()\[\]-]+",
}
#: What is in no class.
OUTSIDE = "[^" + "".join(c[2:-2] for c in CLASSES.values()) + "]+"
WINDOW = 8
#: Common words of a language: the first TOP of those with this share of its words.
TOP, LEAST_SHARE = 24, 0.001
#: (limit, part that shrinks with length, words from which it holds).
WORD_LIMIT = (0.14, 2.0, 50)
CHAR_LIMIT = (0.12, 1.6, 20)


@dataclass
class Reference:
    lang: str
    words: dict[str, float]
    chars: list[float]


def _marks(text: Column) -> Column:
    """The characters of a text that are in any class; mostly letters go."""
    return F.regexp_replace(text, OUTSIDE, "")


def _class_counts(marks: Column, length: Column) -> list[Column]:
    """Counts of each class and of all other characters, from the marks of a text and its length."""
    counts = [F.length(F.regexp_replace(marks, outside, "")) for outside in CLASSES.values()]
    return [*counts, length - sum(counts[1:], counts[0])]


def learn_references(docs: DataFrame) -> list[Reference]:
    """Class and word shares of each language over all its documents.

    The texts are split once, into a table of (lang, word, n) that is combined
    before the shuffle and grows with the vocabulary.  Classes are counted on
    that table, each word's characters times its count; what words leave of a
    language's length is space.  A language has at most ``1 / LEAST_SHARE``
    words with that share, so what the driver gets is small.
    """
    rows = docs.where("lang is not null").select("lang", F.coalesce("text", F.lit("")).alias("text"))
    length = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).collect()}
    words = rows.select("lang", F.explode(words_of(F.col("text"))).alias("word"))
    counted = materialise(words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "language-words")
    inside = [name for name in CLASSES if name != "space"]
    sums = [F.sum(F.col("n") * F.length(F.regexp_replace("word", CLASSES[name], ""))).alias(name) for name in inside]
    sums += [F.sum(F.col("n") * F.length("word")).alias("all"), F.sum("n").alias("n_words")]
    totals = {r["lang"]: r for r in counted.groupBy("lang").agg(*sums).collect()}
    chars, n_words = {}, {}
    for lang, n in length.items():
        found = totals[lang].asDict() if lang in totals else dict.fromkeys([*inside, "all", "n_words"], 0)
        found["space"] = n - found["all"]
        shares = [float(found[name]) for name in CLASSES]
        chars[lang] = [*shares, n - sum(shares)]
        n_words[lang] = found["n_words"]
    common: dict[str, list[tuple[int, str]]] = {}
    if n_words:
        of_lang = F.create_map(*[F.lit(x) for pair in n_words.items() for x in pair])
        lowered = counted.groupBy("lang", F.lower("word").alias("word")).agg(F.sum("n").alias("n"))
        lowered = lowered.where((F.col("n") >= F.lit(LEAST_SHARE) * F.element_at(of_lang, F.col("lang"))) & F.col("word").rlike(r"^\p{L}+$"))
        for r in lowered.collect():  # at most 1 / LEAST_SHARE rows per language
            common.setdefault(r["lang"], []).append((-r["n"], r["word"]))
    return [Reference(lang, {w: -n / n_words[lang] for n, w in sorted(common.get(lang, []))[:TOP]}, c) for lang, c in sorted(chars.items())]


def _term(a: Column, b: Column) -> Column:
    """a log2(a / mean of a and b), zero for a = 0."""
    return F.when(a > 0, a * F.log2(F.lit(2.0) * a / (a + b))).otherwise(0.0)


def _divergence(pairs: list[tuple[Column, float]]) -> Column:
    """Jensen-Shannon distance of two aligned lists of shares."""
    terms = [_term(p, F.lit(q)) + (_term(F.lit(q), p) if q > 0 else F.lit(0.0)) for p, q in pairs]
    return F.sqrt(F.greatest(F.lit(0.0), sum(terms[1:], terms[0]) / 2))


def word_distance(counts: Column, n_words: Column, reference: Reference) -> Column:
    """Distance of a text's common words from a language's.

    ``counts`` is an array of (word, n) of the text's words that are common in
    any language; bins are the reference's words and all other words.
    """
    shares = F.create_map(*[F.lit(x) for pair in reference.words.items() for x in pair])
    mine = F.transform(
        F.filter(counts, lambda x: F.map_contains_key(shares, x["word"])),
        lambda x: F.struct((x["n"] / n_words).alias("p"), F.element_at(shares, x["word"]).alias("q")),
    )
    zero = F.struct(F.lit(0.0).alias("js"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q"))
    seen = F.aggregate(
        mine,
        zero,
        lambda acc, x: F.struct(
            (acc["js"] + _term(x["p"], x["q"]) + _term(x["q"], x["p"])).alias("js"),
            (acc["p"] + x["p"]).alias("p"),
            (acc["q"] + x["q"]).alias("q"),
        ),
        lambda acc: F.struct(
            # A bin of which the text has nothing adds its share times log2(2).
            (acc["js"] + F.lit(float(sum(reference.words.values()))) - acc["q"]).alias("js"),
            F.greatest(F.lit(0.0), F.lit(1.0) - acc["p"]).alias("p"),
        ),
    )
    rest = float(1 - sum(reference.words.values()))
    other = _term(seen["p"], F.lit(rest)) + _term(F.lit(rest), seen["p"])
    return F.sqrt(F.greatest(F.lit(0.0), (seen["js"] + other) / 2))


def _class(name: str) -> Column:
    return F.get(F.col("classes"), F.lit(list(CLASSES).index(name)))


def _with_hash_at(offset: int):
    return lambda h, i: F.xxhash64(h, F.get(F.col("hashes"), i + offset))


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, words, length, classes, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("words", words_of(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        "doc_id",
        "words",
        F.length("text").alias("length"),
        _marks(F.col("text")).alias("marks"),
        F.size("words").cast("long").alias("n_words"),
        lines.alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    rows = rows.withColumn("classes", F.array(*_class_counts(F.col("marks"), F.col("length"))))
    # Hashes of 1, 2, 4, then WINDOW words; those that would pass the end go.
    span = 1
    while span < WINDOW:
        rows = rows.withColumn("hashes", F.transform("hashes", _with_hash_at(span)))
        span *= 2
    rows = rows.withColumn("hashes", F.slice("hashes", 1, F.greatest(F.size("words") - WINDOW + 1, F.lit(0))))
    twice = F.size(F.array_distinct("hashes")) < F.size("hashes")
    # (hash, start) in order, only for texts in which a window occurs twice.
    rows = rows.withColumn("sorted", F.when(twice, F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))))
    hash_at = lambda k: F.get(F.col("sorted"), k)["h"]
    same = lambda k: F.coalesce((hash_at(k) == hash_at(k - 1)) | (hash_at(k) == hash_at(k + 1)), hash_at(k) == hash_at(k + 1), hash_at(k) == hash_at(k - 1))
    rows = rows.withColumn(
        "repeated",
        F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), F.size("sorted") - 1), same), lambda k: F.get(F.col("sorted"), k)["at"])),
    )
    steps = F.transform("repeated", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("repeated"), i + 1) - p, F.lit(WINDOW))))
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return rows.select(
        "doc_id", "length", "classes", "words", "n_words",
        (F.col("length") - _class("space")).cast("long").alias("word_chars"),
        _class("symbol").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
    )


def judge(docs: DataFrame, references: list[Reference] | None = None) -> DataFrame:
    """doc_id, counts, base_failed, kept, char_distance, word_distance."""
    references = learn_references(docs) if references is None else references
    rows = base_counts(docs)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    common = sorted({w for r in references for w in r.words})
    longest = max(map(len, common), default=0)  # lower case never has fewer code points
    shared = F.filter("words", lambda w: (F.length(w) <= longest) & F.lower(w).isin(common)) if common else F.array().cast("array<string>")
    rows = rows.withColumn("shared", F.transform(shared, F.lower))
    rows = rows.withColumn(
        "counts",
        F.transform(F.array_distinct("shared"), lambda w: F.struct(w.alias("word"), (F.size("shared") - F.size(F.array_remove(F.col("shared"), w))).alias("n"))),
    )
    length = F.greatest(F.col("length"), F.lit(1)).cast("double")
    no = F.lit(None).cast("double")
    chars, words = no, no
    for r in references:
        size = max(sum(r.chars), 1.0)
        pairs = [(F.get(F.col("classes"), F.lit(k)) / length, c / size) for k, c in enumerate(r.chars)]
        chars = F.least(chars, _divergence(pairs))
        if r.words:
            words = F.least(words, word_distance(F.col("counts"), F.greatest(F.col("n_words"), F.lit(1)), r))
    rows = rows.withColumn("char_distance", chars).withColumn("word_distance", words)
    bad = F.lit(False)
    for name, (limit, noise, least) in {"word_distance": WORD_LIMIT, "char_distance": CHAR_LIMIT}.items():
        over = F.col(name) > F.lit(limit) + F.lit(noise) / F.sqrt("n_words")
        bad = bad | ((F.col("n_words") >= least) & F.coalesce(over, F.lit(False)))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~bad).alias("kept"),
        F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"),
    )
