"""Rows that share an id but not a component are all kept."""

from prospectra.llm import simhash


def test_unlinked_rows_of_one_id_stay(spark):
    a, b = " ".join(f"w{i}" for i in range(80)), " ".join(f"v{i}" for i in range(80))
    rows = [(1, a, "x"), (1, b, "y"), (1, a, "w"), (2, b, "z"), (3, "other words here", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for kept in (simhash.keep_one_each(docs), simhash.keep_one_each(docs.repartition(5, "source"), similarity=0.8, width=5)):
        assert sorted(map(tuple, kept.collect())) == [(1, b, "y"), (1, a, "w"), (3, "other words here", "q")]
