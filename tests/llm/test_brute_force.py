"""Operators that SQL can't express, against plain Python or held-out labels."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from fleetgauge.llm import exact_dedup, language_id, mixing, packing, quality_model, segments, simhash, toxicity
from fleetgauge.llm.simhash_kernel import fingerprint

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def slow_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 4:
            root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_fingerprints(docs):
    texts = [r["text"] for r in docs.limit(60).collect()] + ["", None, "One", "a b\tc", "A b c d", "x " * 50, "É é \u00a0 Z"]
    assert [fingerprint(t.encode() if t is not None else None) for t in texts] == [slow_fingerprint(t) for t in texts]


def test_near_duplicates_against_all_pairs(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    prints = {r["doc_id"]: slow_fingerprint(r["text"]) for r in rows}
    roots = slow_components(sorted(set(prints.values())))
    least = {}
    for d, f in prints.items():
        least[roots[f]] = min(d, least.get(roots[f], d))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {d: (f"{f:016x}", least[roots[f]]) for d, f in prints.items()}


def test_links_lose_no_pair(spark):
    rng = random.Random(1)
    fps = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        fps |= {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(8)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    nodes = spark.createDataFrame(signed, "fp long")
    plan = simhash.plan_search(nodes)
    assert sum(t for _, t in plan) >= simhash.RADIUS - 5 + 1
    roots = slow_components(sorted(fps))
    plans = [plan, [(list(range(32)), 2), (list(range(32, 64)), 1)], [(list(range(0, 64, 3)), 1), (list(range(1, 64, 3)), 1), (list(range(2, 64, 3)), 0)]]
    for at, dense in ((0, 4096), (1, 4096), (2, 4096), (0, 3)):
        got = simhash.components(simhash.links(nodes, plans[at], dense=dense)).collect()
        found = {f: f for f in fps} | {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in got}
        groups = {}
        for f in fps:
            groups.setdefault(roots[f], set()).add(f)
        mine = {}
        for f in fps:
            mine.setdefault(found[f], set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)], "a long, b long")
    assert {r["root"] for r in simhash.components(edges).collect()} == {0}


def test_mix_meets_its_targets(docs):
    rows = mixing.plan_mix(docs).collect()
    words = sum(r["size"] for r in rows)
    by_source = {}
    for r in rows:
        by_source.setdefault(r["source"], []).append(r)
    targets = {s: rs[0]["target"] for s, rs in by_source.items()}
    assert sum(targets.values()) == pytest.approx(1.5 * words)
    for s, rs in by_source.items():
        size = sum(r["size"] for r in rs)
        assert rs[0]["source_size"] == size and targets[s] <= 2 * size + 1e-6
        assert all(r["copies"] in (int(targets[s] / size), int(targets[s] / size) + 1) for r in rs)
        assert abs(sum(r["taken"] for r in rs) - targets[s]) <= 0.03 * targets[s] + max(r["size"] for r in rs) / 2


def test_coins_are_fair_and_reruns_agree(spark):
    rows = [(k, "w " * (1 + k % 37), f"s{k % 3}") for k in range(6000)]
    plan = mixing.plan_mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    first = sorted(plan.collect())
    assert first == sorted(plan.collect())
    for source in ("s0", "s1", "s2"):
        mine = [r for r in first if r["source"] == source]
        rate = mine[0]["target"] / mine[0]["source_size"]
        for low in (1, 8, 16):  # in every range of sizes as many as the fraction says
            some = [r["copies"] for r in mine if low <= r["size"] < 2 * low]
            assert abs(np.mean(some) - rate) < 0.03


def test_boundaries_are_optimal():
    rng = random.Random(2)
    for _ in range(30):
        counts = {rng.randint(1, 40): rng.randint(1, 9) for _ in range(rng.randint(1, 9))}
        lengths = sorted(counts)
        for buckets in (1, 2, 3, 5):
            def padding(bounds):
                return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in counts.items())

            inner = [c for k in range(min(buckets, len(lengths))) for c in itertools.combinations(lengths[:-1], k)]
            best = min(padding([*c, lengths[-1]]) for c in inner)
            bounds = packing.best_boundaries(counts, buckets)
            assert len(bounds) <= buckets and padding(bounds) == best


def test_packing_holds_every_word_once(docs):
    rows = packing.pack(docs).collect()
    size = {r["doc_id"]: len([w for w in re.split(r"[\x20\x09-\x0D]+", r["text"] or "") if w]) for r in docs.collect()}
    spans = {}
    for r in rows:
        if r["piece"] is not None:
            spans.setdefault(r["doc_id"], []).append((r["start"], r["n_words"]))
            assert r["padding"] == r["bucket_len"] - r["n_words"] >= 0
    for d, n in size.items():
        at = 0
        for start, length in sorted(spans.get(d, [])):
            assert start == at
            at += length
        assert at == n
    assert len({(r["batch"], r["slot"]) for r in rows if r["batch"]}) == len([r for r in rows if r["batch"]])


def test_language_is_right_on_held_out_rows(docs):
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = language_id.predict(docs).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.98


def test_filter_returns_all_languages_of_a_gram():
    rng = np.random.default_rng(0)
    found = {f"l{k:02d}": rng.integers(-(1 << 62), 1 << 62, 500) for k in range(70)}
    filt = language_id.BitmaskFilter.build(found, 1 << 15)
    for k, name in enumerate(filt.languages):
        places = list(filt.slots_of(found[name].view(np.uint64), 1 << 15))
        masks = filt.table[k // 64]
        assert all((masks[at] >> np.uint64(k % 64) & np.uint64(1)).all() for at in places)


def test_segments_are_maximal():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randint(1, 14)
        scores = [rng.choice([-1.0, -1.0, -1.0, 1.5, 2.25, 0.5]) for _ in range(n)]
        got = segments.maximal_segments([(i, s) for i, s in enumerate(scores) if s > 0], 1.0)
        expected, rest = [], [(0, n)]
        while rest:
            a, b = rest.pop()
            best = max(((sum(scores[i : j + 1]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i, b)), default=None)
            if best and best[0] > 0:
                expected.append((best[3], best[4], best[0]))
                rest += [(a, best[3]), (best[4] + 1, b)]
        assert sum(s for *_, s in got) == pytest.approx(sum(s for *_, s in expected))
        assert [g[2] for g in got] == pytest.approx([e[2] for e in sorted(expected)])


def test_toxic_passages_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = toxicity.predict(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out")
    cells = {(r["toxic"], r["predicted"]): r["n"] for r in found.groupBy("toxic", "predicted").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert cells.get((1, 1), 0) / (cells.get((1, 1), 0) + cells.get((1, 0), 0)) > 0.85
    assert cells.get((0, 1), 0) / cells[(0, 0)] < 0.01


def test_weak_labels_find_bad_documents(docs, labels):
    found = quality_model.classify(docs).join(labels.select("doc_id", "quality"), "doc_id").collect()
    bad = [r for r in found if r["quality"] == 0]
    good = [r for r in found if r["quality"] == 1]
    assert np.mean([not r["kept"] for r in bad]) > 0.9 and np.mean([r["kept"] for r in good]) > 0.98


def test_votes_and_features_against_plain_python(docs):
    texts = [r["text"] for r in docs.limit(150).collect()] + [None, "", " \t", "One", "a a a b", "É é Übung! 12 #x", "x " * 60, "A!B?c " * 30]
    table = quality_model.WordTable()
    for text in texts:
        votes, slots, counts = quality_model.judge_text(None if text is None else text.encode(), table)
        assert votes == slow_votes(text or "")
        tokens = slow_tokens(text or "")
        expected = {}
        for token in tokens:
            slot = xxhash.xxh32_intdigest(token.encode(), 42) % quality_model.FEATURES
            expected[slot] = expected.get(slot, 0) + 1
        assert dict(zip(slots.tolist(), counts.tolist(), strict=True)) == expected


def slow_words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]


def slow_votes(text):
    words, chars = slow_words(text), max(1, len(text))
    n, some = len(words), max(1, len(words))
    inside = sum(map(len, words))

    def share(signs):
        return sum(c in signs for c in text) / chars

    def vote(good, bad):
        return 0 if bad else 1 if good else -1

    pairs = len({(words[k], words[k + 1]) for k in range(n - 1)}) / some
    again = sum(words[k] == words[k + 1] for k in range(n - 1)) / some
    distinct, mean = len(set(words)) / some, inside / some
    symbols, upper, stress = share("#*$%&|<>{}\\^~=_"), share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share("!?")
    bare = sum(not re.search(r"[^\W_]", w) for w in words) / some
    letters = sum(c.isalpha() for c in text) / max(1, inside)
    plain = sum(w.rstrip(".,;:").isalpha() and len(w) - len(w.rstrip(".,;:")) <= 1 for w in words) / some
    long = n >= 20
    return [
        vote(long, n == 0), vote(long and symbols < 0.02, symbols > 0.05), vote(long and upper < 0.1, long and upper > 0.3),
        vote(long and stress < 0.01, long and stress > 0.04), vote(long and bare < 0.05, long and bare > 0.2),
        vote(long and again < 0.1, long and again > 0.3), vote(long and distinct > 0.4, n >= 50 and distinct < 0.25),
        vote(long and pairs > 0.7, long and pairs < 0.5), vote(long and letters > 0.9, long and letters < 0.75),
        vote(long and plain > 0.8, long and plain < 0.6), vote(long and 3 <= mean <= 8, long and not 2 <= mean <= 12),
    ]


def slow_tokens(text):
    words = slow_words(text)
    shapes = ["".join(k for k, _ in itertools.groupby("A" if c.isupper() else "a" if c.islower() else "0" if c.isnumeric() else c for c in w)) for w in words]
    shapes = [s if not re.search(r"([^Aa0])\1", w) else None for s, w in zip(shapes, words, strict=True)]
    for k, w in enumerate(words):
        if shapes[k] is None:  # other signs are not run together
            shapes[k] = re.sub("0+", "0", re.sub("a+", "a", re.sub("A+", "A", "".join("A" if c.isupper() else "a" if c.islower() else "0" if c.isnumeric() else c for c in w))))
    echoes = ["=same" if words[k] == words[k - 1] else "=other" for k in range(1, len(words))]
    return [w.lower() for w in words] + [f"~{s}" for s in shapes] + echoes


def test_language_counts_against_plain_python():
    rng = np.random.default_rng(3)
    texts = {"aa": "abra kadabra " * 30, "bb": "xyzzy plugh " * 30}
    found = {k: np.unique(np.concatenate(list(language_id.grams(language_id.normalised(t))))).view(np.int64) for k, t in texts.items()}
    filt = language_id.BitmaskFilter.build(found, 1 << 12)
    known = {k: set(v.view(np.uint64).tolist()) for k, v in found.items()}
    for text in ("abra xyzzy", "Plugh, kadabra!", "", "123", "".join(map(chr, rng.integers(97, 123, 40)))):
        grams = np.concatenate([np.zeros(0, np.uint64), *language_id.grams(language_id.normalised(text))]).tolist()
        n, hits = filt.counts(text)
        assert n == len(grams)
        for k, lang in enumerate(filt.languages):
            true = sum(g in known[lang] for g in grams)
            assert true <= hits[k] <= true + 6 * filt.false_rate[k] * n + 3


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(7)
    truth = rng.random(20000) < 0.8
    accuracy = np.array([0.95, 0.85, 0.75, 0.9])
    votes = np.where(rng.random((20000, 4)) < accuracy, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random((20000, 4)) < 0.3] = -1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality_model.fit_labels(patterns, counts.astype(float), list("abcd"))
    assert model.good == pytest.approx(0.8, abs=0.03)
    assert model.rates[:, 1, 1] == pytest.approx(accuracy, abs=0.03)


def test_pipeline_against_plain_stages(spark, docs):
    kept = {r["doc_id"]: r for r in docs.collect()}
    found = {r["doc_id"]: r for r in language_id.predict(docs).collect()}
    kept = {d: r for d, r in kept.items() if found[d]["lang_pred"] != "und" and found[d]["score"] >= language_id.MIN_SCORE}
    first = {}
    for d in sorted(kept):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", kept[d]["text"]), d)
    kept = {d: kept[d] for d in first.values()}
    sets = {d: shingles(r["text"]) for d, r in kept.items()}
    root = {d: d for d in kept}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(kept, 2):
        if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
            root[find(a)] = find(b)
    least = {}
    for d in sorted(kept):
        least.setdefault(find(d), d)
    left = [kept[d] for d in least.values()]
    mix = {r["doc_id"]: r["copies"] for r in mixing.plan_mix(spark.createDataFrame(left, docs.schema)).collect()}
    expected = sorted((d, s) for d, n in mix.items() for s in pieces(kept[d]["text"]) for _ in range(n))
    got = sorted((r["doc_id"], r["n_words"] or 0) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == expected


def shingles(text):
    """Sets of word 5-shingles; the near-dedup stage links texts of Jaccard similarity 0.8 or more."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def pieces(text):
    n = len([w for w in re.split(r"[\x20\x09-\x0D]+", text) if w])
    return [min(packing.MAX_LEN, n - at) for at in range(0, n, packing.MAX_LEN)] or [0]


def test_drop_copies_keeps_the_first(docs):
    first = {}
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or ""), r["doc_id"])
    assert sorted(r["doc_id"] for r in exact_dedup.drop_copies(docs).collect()) == sorted(first.values())


def test_levels_of_many_sources(spark):
    """Targets of thousands of sources, sizes over nine powers of ten, against filling one source after the other."""
    sizes = {None if k == 7 else f"s{k * 7919 % 5003:05d}": int(10 ** (k * 37 % 900 / 100)) if k % 50 else 0 for k in range(3000)}
    rows = [(s, size // 2 + j * (size % 2)) for s, size in sizes.items() for j in (0, 1)]
    got = {r["source"]: r for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long").repartition(7)).collect()}
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    left, open_weight, target = 1.5 * sum(sizes.values()), sum(weight.values()), {}
    for s in sorted(names, key=lambda s: sizes[s] / weight[s]):
        target[s] = min(2.0 * sizes[s], left / open_weight * weight[s])
        left, open_weight = left - target[s], open_weight - weight[s]
    assert len(got) == 3000
    for s in names:
        assert got[s]["source_size"] == sizes[s] and got[s]["target"] == pytest.approx(target[s], rel=1e-9), s
    same = mixing.source_targets(spark.createDataFrame([("a", 0), ("b", 0)], "source string, size long"))
    assert [r["target"] for r in same.collect()] == [0.0, 0.0]
    tripled = mixing.source_targets(spark.createDataFrame([("a", 4), ("b", 8)], "source string, size long"), share=3.0)
    assert sorted(r["target"] for r in tripled.collect()) == [8.0, 16.0]
