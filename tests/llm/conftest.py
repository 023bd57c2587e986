import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names the operators use inside; as columns of the input they must not disturb.
CLASHES = "key string, size long, n long, words array<string>, kept boolean, row_id long, score double, fp long, copies long, piece long, lang_pred string, vote_length byte, evidence double, unit string, part int, stack string, host string, n_words long, text_sha256 string, `a.b` int"

WORDS = "the valve was opened and it is closed by hand as the pressure rose to the limit of that test on this day".split()


def prose(n, seed=0):
    return " ".join(WORDS[(k * 7 + seed * 3 + k * k * (seed + 1)) % len(WORDS)] for k in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    long_text = prose(30000, 5)
    return [
        (1, prose(60), "en", "a", 1),
        (2, prose(60), "en", "a", 1),
        (2, prose(60), "en", "a", 1),
        (None, prose(60), None, None, None),
        (3, None, None, None, None),
        (None, None, "en", "b", 0),
        (4, "", "en", "b", 0),
        (5, " \t\n\r\x0b\x0c ", "de", "b", 3),
        (6, long_text, "en", "c", 9),
        (7, "Ünïcode ÄÖÜ ß 漢字 \U0001f600 \u212a", "de", "", 9),
        (8, "word", "en", "a", 4),
        (9, "12345 !!! ### $$$", "en", "a", 4),
        (10, "same same same " * 40, "en", "c", 4),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    df = spark.createDataFrame(edge_rows, DOCS)
    for spec in CLASHES.split(", "):
        name, kind = spec.rsplit(" ", 1)
        df = df.withColumn(name.strip("`"), __import__("pyspark.sql.functions", fromlist=["lit"]).lit(None).cast(kind))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
