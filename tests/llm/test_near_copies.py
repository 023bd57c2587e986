"""The near-dedup stage against all pairs of plain Python sets."""

import itertools
import random

import pytest

import corpus_pipeline
from fleetgauge.llm import near_copies, simhash
from fleetgauge.llm.simhash_kernel import fingerprint

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = text.lower().split()
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def first_ids(rows):
    """Smallest id of each component of the pairs of Jaccard similarity 0.8."""
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {find(d) for d in sets}


def varied(rng, groups, copies, words):
    rows = []
    for _ in range(groups):
        base = [rng.choice("abcdefghij") + str(rng.randint(0, 400)) for _ in range(rng.randint(3, words))]
        for _ in range(rng.randint(1, copies)):
            text = list(base)
            for _ in range(rng.randint(0, 5)):
                text[rng.randrange(len(text))] = f"x{rng.randint(0, 10**6)}"
            rows.append((len(rows) + 1, " ".join(text)))
    return rows


def documents(spark, rows):
    return spark.createDataFrame([(d, t, "en", "a", 1) for d, t in rows], DOCS)


def test_stage_drops_near_copies_and_nothing_else(spark):
    base = [f"w{k}" for k in range(104)]  # 100 shingles; a changed word in the middle renews five of them
    near, far = list(base), list(base)
    near[20] = near[60] = "y"  # 90 of 110
    for k in (20, 40, 60):
        far[k] = "z"  # 85 of 115
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far))]
    got = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, documents(spark, rows), "")
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 3]


@pytest.mark.parametrize("dense, pivots", [(256, 16), (3, 1)])
def test_against_all_pairs(spark, dense, pivots):
    rng = random.Random(3)
    rows = varied(rng, 40, 6, 150) + [(1000 + d, t) for d, t in varied(rng, 1, 1, 60) for _ in range(1)]
    base = [f"v{k}" for k in range(120)]
    rows += [(2000 + k, " ".join(f"u{rng.randint(0, 10**6)}" if rng.random() < 0.03 else w for w in base)) for k in range(60)]
    got = near_copies.keep_one(documents(spark, rows), dense, pivots).collect()
    assert {r["doc_id"] for r in got} == first_ids(rows) and len(got) == len(first_ids(rows))


def test_rows_without_ids(spark):
    text = " ".join(f"w{k}" for k in range(104))
    rows = [(None, text), (None, text + " x"), (None, text + " x"), (7, "a"), (None, "a"), (8, "a"), (9, None), (10, " ")]
    got = [r["doc_id"] for r in near_copies.keep_one(documents(spark, rows)).collect()]
    assert sorted(got, key=str) == [7, 9, None]


def test_fingerprints_link_and_sets_check(spark, monkeypatch):
    rng = random.Random(1)

    def linked(changes):
        while True:
            base = [f"{rng.choice('abcdef')}{rng.randint(0, 10**6)}" for _ in range(104)]
            other = list(base)
            for k in changes:
                other[k] = f"y{rng.randint(0, 10**6)}"
            a, b = " ".join(base), " ".join(other)
            if (fingerprint(a.encode(), 4) ^ fingerprint(b.encode(), 4)).bit_count() <= 4:
                return a, b

    rows = list(enumerate([*linked([40]), *linked([15, 40, 65, 90]), " ".join(f"z{k}" for k in range(50))]))
    docs = documents(spark, rows)
    found = simhash.linked_texts(docs).cache()
    assert found.count() == 2  # the second pair has too few common shingles
    hashes = {r["h"]: r["doc_id"] for r in docs.selectExpr("doc_id", "xxhash64(text) as h").collect()}
    assert sorted(sorted((hashes[r["a"]], hashes[r["b"]])) for r in found.collect()) == [[0, 1], [2, 3]]
    asked = []
    monkeypatch.setattr(near_copies, "verified", lambda pairs, sets, whole=near_copies.verified: asked.append(pairs.count()) or whole(pairs, sets))
    got = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "")
    assert {r["doc_id"] for r in got.collect()} == first_ids(rows) == {0, 2, 3, 4}
    assert asked[0] == 2  # the exact check was given what the fingerprints link
