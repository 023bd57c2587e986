"""One document of each component stays, with or without ids."""

from fleetgauge.llm import simhash


def test_one_row_of_each_component(spark):
    rows = [(None, "A b c d"), (None, "a b c d"), (5, "x y z w"), (5, "X y z w"), (None, "x y z w"), (None, "q r s t"), (None, "q r s t")]
    kept = simhash.keep_representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"].lower()) for r in kept) == [(0, "a b c d"), (0, "q r s t"), (5, "x y z w")]
