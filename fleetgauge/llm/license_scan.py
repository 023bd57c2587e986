"""License scans with a positional rare-token index.

Templates are the grant texts of common licenses.  Corpus document frequencies
of their words give IDF weights.  The index is one table for any number of
templates: per template its words in order of IDF, each with its positions.

1. A file's licence words are ranked by IDF: of each template it looks up the
   ``RARE`` rarest words that it has itself, if these weigh at least
   ``RARE_SHARE`` of the template's ``RARE`` rarest.
2. Each hit and each posting of its word give the place where the template
   would start.  The hits are sorted by template and place; places on which at
   least ``VOTES`` hits agree are the intersection of the postings.
3. There the template's mandatory phrase must stand word by word, and
   ``WORD_SHARE`` of all its words at their positions.

Base phrases are indexed by their rarest word and verified word by word, at
every place.  Only DataFrame functions run on the rows; each row is judged on
its own, and the only shuffle is that of the word frequencies, one row per
template word.

Defined results: a null or empty text has no words, no labels and score 0;
repeated rows get equal results; an empty table gives no rows; other columns
are ignored.  Letters A-Z are folded; no other character becomes a letter of a
template, as the one sign whose lower case is an ASCII letter is replaced.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases and labels of the contract.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Public grant texts, with the phrase that must stand in them.
TEMPLATES = {
    "agpl": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
        "gnu affero general public license",
    ),
    "apache": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "apache license version 2 0",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistribution and use in source and binary forms",
    ),
    "cc-by": (
        "this work is licensed under the creative commons attribution 4 0 international license",
        "creative commons attribution",
    ),
    "cc-by-nc": ("licensed under cc by nc 4 0", "cc by nc"),
    "cc0": (
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
        "waived all copyright and related or neighboring rights",
    ),
    "epl": (
        "this program and the accompanying materials are made available under the terms of the eclipse public license",
        "eclipse public license",
    ),
    "gpl": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "gnu general public license",
    ),
    "gpl-3": ("licensed under the gnu general public license version 3", "gnu general public license version 3"),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "permission to use copy modify and or distribute this software",
    ),
    "lgpl": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
        "gnu lesser general public license",
    ),
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "permission is hereby granted free of charge",
    ),
    "mpl": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
        "mozilla public license",
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
        "free and unencumbered software released into the public domain",
    ),
}

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rarest words of a template that a file looks up.
RARE = 6
#: Hits that must agree on a place.
VOTES = 3
#: Share of the weight of a template's rarest words that a file must have, and of all its words that must stand at their positions.
RARE_SHARE, WORD_SHARE = 0.5, 0.6


def words_of(text: Column) -> Column:
    folded = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("Å")))
    return F.array_remove(F.split(folded, SEPARATORS), "")


def inverse_frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """IDF of each word over all documents, log((1 + documents) / (1 + documents with it))."""
    words = F.array_distinct(F.filter(words_of(F.col("text")), lambda w: w.isin(vocabulary)))
    # A document also counts under null; one row per word reaches the driver.
    marked = docs.select(F.explode(F.concat(words, F.array(F.lit(None).cast("string")))).alias("word"))
    counts = {r["word"]: r["n"] for r in marked.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = counts.get(None, 0)
    return {w: math.log((1 + total) / (1 + counts.get(w, 0))) for w in vocabulary}


def rarest(words: list[str], idf: dict[str, float], n: int) -> list[str]:
    return sorted(set(words), key=lambda w: (-idf[w], w))[:n]


def _literal(value: object) -> Column:
    """A nested list, tuple (fields a, b, c, ...) or number as one constant."""
    if isinstance(value, list):
        return F.array(*map(_literal, value))
    if isinstance(value, tuple):
        return F.struct(*[_literal(x).alias(name) for name, x in zip("abcdefgh", value, strict=False)])
    return F.lit(value)


def index_of(idf: dict[str, float]) -> Column:
    """The index: per template label, words by IDF as (word, weight, positions), least weight, words, phrase and its place."""
    entries = []
    for label, (text, mandatory) in TEMPLATES.items():
        words, phrase = text.split(), mandatory.split()
        by_idf = rarest(words, idf, len(words))
        postings = [(w, idf[w], [i for i, x in enumerate(words) if x == w]) for w in by_idf]
        at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
        entries.append((label, postings, RARE_SHARE * sum(idf[w] for w in by_idf[:RARE]), words, phrase, at))
    return _literal(entries)


def _standing(words: Column, start: Column) -> Column:
    """How many of ``words`` stand at their positions from ``start`` on."""
    return F.size(F.filter(words, lambda w, k: F.get(F.col("words"), start + k) == w))


def _phrase_places(phrase: list[str], anchor: str) -> Column:
    """All places of a phrase, found by its anchor word and verified word by word."""

    def stands(start: Column) -> Column:
        same = [F.coalesce(F.get(F.col("words"), start + k) == w, F.lit(False)) for k, w in enumerate(phrase)]
        return reduce(lambda a, b: a & b, same) & (start >= 0)

    hits = F.filter("hits", lambda x: x["word"] == anchor)
    return F.filter(F.transform(hits, lambda x: x["at"] - phrase.index(anchor)), stands)


def _template_shares(rows: DataFrame, index: Column) -> DataFrame:
    """``rows`` with ``found``: (label, share) of each template at each place where it holds."""
    rows = rows.withColumn("present", F.array_distinct(F.transform("hits", lambda x: x["word"])))

    def looked_up(template: Column) -> Column:
        mine = F.slice(F.filter(template["b"], lambda w: F.array_contains("present", w["a"])), 1, RARE)
        return F.struct(template["a"].alias("label"), mine.alias("mine"), template["c"].alias("least"), template["d"].alias("all"), template["e"].alias("phrase"), template["f"].alias("phrase_at"))

    def heavy(x: Column) -> Column:
        return F.aggregate(x["mine"], F.lit(0.0), lambda weight, w: weight + w["b"]) >= x["least"]

    some = F.size("present") >= VOTES
    rows = rows.withColumn("plan", F.when(some, F.filter(F.transform(index, looked_up), heavy)))
    some = F.size("plan") > 0

    def places(x: Column, k: Column) -> Column:
        of_word = F.transform(x["mine"], lambda w: F.flatten(F.transform(F.filter("hits", lambda h: h["word"] == w["a"]), lambda h: F.transform(w["c"], lambda at: F.struct(k.alias("k"), (h["at"] - at).alias("start"))))))
        return F.flatten(of_word)

    rows = rows.withColumn("votes", F.when(some, F.array_sort(F.flatten(F.transform("plan", places)))))
    # Sorted, votes for one place are neighbours: its last one looks back at the one VOTES - 1 before.
    agreed = F.filter("votes", lambda x, i: (F.get("votes", i - (VOTES - 1)) == x) & F.coalesce(F.get("votes", i + 1) != x, F.lit(True)))
    rows = rows.withColumn("places", F.when(some, agreed))

    def share(x: Column) -> Column:
        template = F.get("plan", x["k"])
        phrase = _standing(template["phrase"], x["start"] + template["phrase_at"]) == F.size(template["phrase"])
        return F.struct(template["label"].alias("label"), F.when(phrase, _standing(template["all"], x["start"]) / F.size(template["all"])).alias("share"))

    shares = F.filter(F.transform("places", share), lambda x: x["share"] >= WORD_SHARE)
    return rows.withColumn("found", F.coalesce(shares, F.array().cast("array<struct<label:string,share:double>>")))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row."""
    phrases = {p: p.split() for p in BASE}
    vocabulary = sorted({w for ws in phrases.values() for w in ws} | {w for text, _ in TEMPLATES.values() for w in text.split()})
    idf = inverse_frequencies(docs, vocabulary)

    rows = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    placed = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda x: x["word"].isin(vocabulary))
    rows = rows.select("doc_id", "words", F.size("words").cast("long").alias("n_words"), placed.alias("hits"))
    for k, words in enumerate(phrases.values()):
        rows = rows.withColumn(f"base{k}", _phrase_places(words, rarest(words, idf, 1)[0]))
    rows = _template_shares(rows, index_of(idf))

    bases = [F.size(f"base{k}") for k in range(len(phrases))]
    n_base = sum(bases[1:], bases[0])
    base = F.array_compact(F.array(*[F.when(n > 0, F.lit(label)) for n, label in zip(bases, BASE.values(), strict=True)]))
    places = F.concat(*[F.col(f"base{k}") for k in range(len(phrases))])

    def joined(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    best = F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0))
    return rows.select(
        "doc_id", "n_words", n_base.cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, F.transform("found", lambda x: x["label"]))).alias("labels"),
        F.greatest(F.when(n_base > 0, 1.0).otherwise(0.0), best).alias("score"),
    )
