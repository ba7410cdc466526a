"""Rows are taken out by marks, however many share an id."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from plumbline.llm import common, exact_dedup


def brute(rows: list[tuple]) -> Counter:
    """The least id (null last) of each text."""
    least = {}
    for doc_id, text in rows:
        key = (doc_id is None, doc_id or 0)
        least[text] = min(least.get(text, key), key)
    return Counter((None if null else doc_id, text) for text, (null, doc_id) in least.items())


@pytest.mark.parametrize("limit", [5, 100, 200_000])
def test_marks_of_one_id_are_not_gathered(spark, monkeypatch, limit):
    rows = [(None, f"text {i % 300}") for i in range(600)] + [(None, "the same")] * 200 + [(i % 40, f"text {i}") for i in range(100)] + [(7, f"alone {i}") for i in range(50)]
    held, broadcast = [], F.broadcast
    monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    marks = common.without_marked
    # Only what without_marked broadcasts is looked at; heavy_winners has a bound of its own.
    def watched(*args):
        with monkeypatch.context() as m:
            m.setattr(F, "broadcast", lambda df: (held.append(df), broadcast(df))[1])
            return marks(*args)

    monkeypatch.setattr(exact_dedup, "without_marked", watched)
    found = exact_dedup.deduplicated(docs, k=4)
    assert Counter(map(tuple, found.collect())) == brute(rows)
    assert held and all(df.count() <= limit for df in held)
    assert not any(isinstance(f.dataType, ArrayType) for df in held for f in df.schema)
