"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fleetgauge.llm import common, exact_dedup, language_id, license_scan, mixing, packing, quality_model, quality_rules, simhash, toxicity, url_rules

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (6, 0, 1), (7, None, None), (None, 1, 1), (2, 0, 1)], LABELS)


def by_id(df):
    found = {}
    for r in df.collect():
        found.setdefault(r["doc_id"], []).append(r)
    return found


def test_license_scan(spark, edge_docs, no_docs):
    got = by_id(license_scan.scan(edge_docs))
    assert got[3][0]["n_words"] == 0 and got[3][0]["labels"] == "" and got[3][0]["score"] == 0.0
    assert got[7][0]["n_words"] == 6 and len(got[2]) == 2 and got[6][0]["n_words"] == 30000
    assert license_scan.scan(no_docs).count() == 0
    texts = ["MIT License. mit-license", "GNU GENERAL public licence", "x cc  by y CC-BY-NC 4.0", "Apache\nLicense apache license"]
    rows = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r["doc_id"]: (r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows.collect()}
    assert got == {0: (2, 0, 2, "mit"), 1: (0, None, None, ""), 2: (2, 1, 4, "cc-by"), 3: (2, 0, 2, "apache")}


def test_quality_classifier(edge_docs, no_docs):
    got = by_id(quality_model.classify(edge_docs))
    assert sum(map(len, got.values())) == 13 and all(0 <= r["score"] <= 1 for rs in got.values() for r in rs)
    assert got[2][0] == got[2][1] and quality_model.classify(no_docs).count() == 0


def test_mixing(spark, edge_docs, no_docs):
    got = by_id(mixing.plan_mix(edge_docs))
    assert got[3][0]["taken"] == 0 and got[2][0] == got[2][1] and sum(map(len, got.values())) == 13
    assert mixing.plan_mix(no_docs).count() == 0 and mixing.emit(no_docs).count() == 0
    out = mixing.emit(edge_docs)
    assert out.columns == edge_docs.columns
    assert out.count() == sum(r["copies"] for rs in got.values() for r in rs)


def test_url_rules(spark):
    urls = [None, "no scheme", "", "http://", "HTTP://EXAMPLE.ORG/es/x?y", "a://org", "a://org/", "a://x.org/z", "a://xorg/z", "a://b.example.org/en/12#q", "a://b.com/fr/", "a://b.com/de/1", "a://b.com/frx", "b://c://org/", "a://example.org:80/es/"]
    df = spark.createDataFrame([(None if k == 1 else k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, stack string")
    got = {(r["host"], r["path"]): (r["rule"], r["verdict"]) for r in url_rules.judge(df).collect()}
    assert got[("", "")] == (None, "allow") and got[("example.org", "/es/x")] == ("example.org/es/", "block")
    assert got[("org", "")] == (None, "allow") and got[("org", "/")] == ("org/", "allow") and got[("x.org", "/z")] == ("org/", "allow")
    assert got[("xorg", "/z")] == (None, "allow") and got[("b.example.org", "/en/12")] == ("example.org/en/1", "block")
    assert got[("b.com", "/fr/")][1] == "allow" and got[("b.com", "/de/1")] == ("com/de/", "block") and got[("b.com", "/frx")][0] is None
    assert url_rules.judge(df).count() == len(urls) and url_rules.judge(df.limit(0)).count() == 0


def test_url_rules_against_all_rules(spark):
    rules = [("block", h, p) for h in ("net", "a.net", "b.a.net", "x.com", "c.b.a.net", "a") for p in ("/", "/q/", "/q/1")]
    hosts = ["net", "a.net", "b.a.net", "z.b.a.net", "c.b.a.net", "d.c.b.a.net", "aa.net", "x.com", "y.x.com", "com", "a", "b.a", "zz"]
    urls = [f"h://{h}{p}" for h in hosts for p in ("", "/", "/q", "/q/", "/q/12", "/z")]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    got = {r["page_id"]: r["rule"] for r in url_rules.judge(df, url_rules.rules_table(spark, rules)).collect()}
    for k, u in enumerate(urls):
        host, _, path = u[4:].partition("/")
        path = f"/{path}" if "/" in u[4:] else ""
        fits = [h + p for _, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[k] == (max(fits, key=len) if fits else None), u


def test_toxicity(edge_docs, no_docs, labels):
    got = by_id(toxicity.predict(edge_docs, labels))
    assert sum(map(len, got.values())) == 13 and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for rs in got.values() for r in rs)
    assert got[None][0]["held_out"] is False
    assert toxicity.predict(no_docs, labels).count() == 0 and toxicity.predict(edge_docs, labels.limit(0)).count() == 13


def test_simhash(spark, edge_docs, no_docs):
    got = by_id(simhash.near_duplicates(edge_docs))
    assert got[4][0]["fingerprint"] == "0" * 16 and {r["component_id"] for k in (3, 4, 5) for r in got[k]} == {3}
    assert got[2][0] == got[2][1] and got[2][0]["component_id"] == 1 and simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.keep_representatives(edge_docs)
    assert kept.columns == edge_docs.columns and {1, 3, 6} <= {r["doc_id"] for r in kept.collect()}


def test_exact_dedup(spark, edge_docs, no_docs):
    got = by_id(exact_dedup.annotate(edge_docs))
    assert sorted(r["kept"] for r in got[2]) == [False, False] and got[1][0]["kept"] and got[1][0]["group_size"] == 4
    assert got[3][0]["keep_id"] == 3 and got[3][0]["group_size"] == 3 and got[4][0]["keep_id"] == 3 and got[5][0]["keep_id"] == 5
    assert exact_dedup.annotate(no_docs).count() == 0 and exact_dedup.drop_copies(no_docs).count() == 0
    out = exact_dedup.drop_copies(edge_docs)
    assert out.columns == edge_docs.columns
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == sorted([1, 3, 5, 6, 7, 8, 9, 10], key=str)
    repeated = spark.createDataFrame([(1, "x y", "en", "a", 1)] * 3 + [(None, "x  y", None, None, 1)] * 2, "doc_id long, text string, lang string, source string, n_chars long")
    assert exact_dedup.drop_copies(repeated).count() == 1


def test_index_persists(spark, tmp_path):
    schema = "doc_id long, text string"
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 3)
    first = exact_dedup.annotate(spark.createDataFrame([(5, "a b"), (6, "c")], schema), index).collect()
    assert all(r["kept"] for r in first)
    again = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 3)
    second = by_id(exact_dedup.annotate(spark.createDataFrame([(1, "a  b"), (7, "d"), (8, "d")], schema), again))
    assert (second[1][0]["keep_id"], second[1][0]["kept"]) == (5, False)
    assert (second[7][0]["kept"], second[8][0]["kept"], second[8][0]["group_size"]) == (True, False, 2)
    assert again.rows().count() == 3


def test_index_keeps_its_buckets_and_batches(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(40)], "doc_id long, text string")
    path = str(tmp_path / "index")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    index = exact_dedup.DigestIndex(spark, path)
    assert all(r["kept"] for r in exact_dedup.annotate(docs, index, "one").collect())
    spark.sql(f"DROP TABLE {index.name}")  # as in another catalogue
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        again = exact_dedup.DigestIndex(spark, path)
        assert again.buckets == index.buckets
        assert not any(r["kept"] for r in exact_dedup.annotate(docs, again, "two").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, path, again.buckets + 1)
    # The first batch once more, as after a failure: the same answers, nothing added.
    assert all(r["kept"] for r in exact_dedup.annotate(docs, again, "one").collect()) and again.rows().count() == 40
    exact_dedup.annotate(spark.createDataFrame([(99, "new")], "doc_id long, text string"), again, "three").count()
    again.compact()
    assert again.rows().count() == 41 and exact_dedup.DigestIndex(spark, path).version == 1
    assert not any(r["kept"] for r in exact_dedup.annotate(docs, exact_dedup.DigestIndex(spark, path), "four").collect())
    assert len(again.rows().inputFiles()) <= again.buckets


def test_shared_folder(spark, monkeypatch):
    class Cluster:
        conf, sparkContext = spark.conf, type("C", (), {"master": "yarn"})

    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(ValueError):
            common.scratch_dir(Cluster)
    table = common.materialise(spark.range(3), "probe")
    assert table.count() == 3
    common.clear_scratch(spark)
    with pytest.raises(Exception):
        spark.read.parquet(table.scratch_path).count()


def test_packing_without_ids_and_with_ties(spark):
    rows = [(None, "a b c")] * 900 + [(7, "a b c")] * 300
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), group_rows=200).collect()
    assert len(packed) == 1200 and len({(r["batch"], r["slot"]) for r in packed}) == 1200
    groups = {}
    for r in packed:
        group = r["batch"].rsplit("-", 1)[0]
        groups[group] = groups.get(group, 0) + 1
    assert len(groups) == 6 and max(groups.values()) < 400


def test_url_rules_with_repeated_null_ids(spark):
    df = spark.createDataFrame([(None, None)] * 5 + [(None, "a://org/")] * 3, "page_id long, url string")
    rows = url_rules.judge(df).collect()
    assert sorted((r["host"], r["rule"]) for r in rows) == sorted([("", None)] * 5 + [("org", "org/")] * 3)


def test_toxic_passages(spark, edge_docs, no_docs, labels):
    model = toxicity.learn(edge_docs, labels)
    assert toxicity.passages(no_docs, model).count() == 0
    rows = toxicity.passages(edge_docs, model).collect()
    assert all(r["doc_id"] in (None, *range(1, 11)) for r in rows)


def test_quality_rules(edge_docs, no_docs):
    got = by_id(quality_rules.judge(edge_docs))
    assert got[3][0]["n_words"] == 0 and got[3][0]["base_failed"] and not got[3][0]["kept"]
    assert got[10][0]["n_repeat_words"] == 120 and got[9][0]["n_symbols"] == 6 and got[2][0] == got[2][1]
    assert got[6][0]["n_words"] == 30000 and quality_rules.judge(no_docs).count() == 0


def test_packing(edge_docs, no_docs):
    rows = packing.pack(edge_docs, max_len=512, buckets=4, budget=2048).collect()
    assert sum(r["n_words"] or 0 for r in rows if r["doc_id"] == 6) == 30000
    assert [r["piece"] for r in rows if r["doc_id"] in (3, 4, 5)] == [None] * 3 and packing.pack(no_docs).count() == 0
    batches = {}
    for r in rows:
        if r["batch"]:
            batches.setdefault(r["batch"], []).append(r)
    assert all(len(b) * b[0]["bucket_len"] <= 2048 and len({r["slot"] for r in b}) == len(b) for b in batches.values())


def test_language_id(edge_docs, no_docs):
    got = by_id(language_id.predict(edge_docs))
    assert got[3][0]["lang_pred"] == got[5][0]["lang_pred"] == "und" and got[9][0]["lang_pred"] == "und"
    assert got[2][0] == got[2][1] and sum(map(len, got.values())) == 13 and language_id.predict(no_docs).count() == 0
    kept = language_id.keep_identified(edge_docs)
    assert kept.columns == edge_docs.columns


def test_pipeline_stages(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            assert name == "packing" or out.columns == docs.columns
            out.withColumn("checked", F.lit(1)).count()
