import hashlib
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import common, exact_dedup


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_groups_with_few_counters(spark):
    """A summary of two counters splits heavy and light digests; the result is that of grouping."""
    rows = [(i, "hot" if i % 2 else f"text {i % 11}") for i in range(300)] + [(None, "hot"), (301, None), (302, "")]
    found = exact_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), k=2).collect()
    by = defaultdict(list)
    for i, t in rows:
        by[normal(t)].append(i)
    assert len(found) == len(rows)
    for r in found:
        text = next(t for t in by if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        ids = [i for i in by[text] if i is not None]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (min(ids), len(by[text]), r["doc_id"] == min(ids))


@pytest.mark.parametrize("broadcast", [0, 200_000])
def test_filter_keeps_one_row_of_each_text(spark, monkeypatch, broadcast):
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    rows = [(2, "a  b"), (1, "a\tb"), (1, "a b"), (5, None), (4, ""), (None, "c"), (None, "c"), (9, "a b ")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, digest string")
    for k in (1, 8192):
        kept = exact_dedup.deduplicated(docs, k)
        assert kept.columns == docs.columns
        assert Counter((r["doc_id"], normal(r["text"])) for r in kept.collect()) == Counter([(1, "a b"), (4, ""), (None, "c"), (9, "a b ")])


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c", b"d", b"e"]), max_size=60), st.integers(1, 4), st.integers(1, 5))
def test_merged_summaries_keep_heavy_keys(values, k, parts):
    total: dict[bytes, int] = {}
    for part in range(parts):
        counters: dict[bytes, int] = {}
        for value in values[part::parts]:
            counters[value] = counters.get(value, 0) + 1
            counters = exact_dedup.merge_counters(counters, k)
        total = exact_dedup.merge_counters({key: total.get(key, 0) + counters.get(key, 0) for key in total | counters}, k)
    assert len(total) <= k
    assert all(key in total for key, n in Counter(values).items() if n * (k + 1) > len(values))
