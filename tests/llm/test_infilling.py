"""op13 against its SQL is in test_against_sql; here its parts and its edges."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import infilling

TEXT = st.text(alphabet=st.one_of(st.sampled_from("ab\n\r  é😀"), st.characters(codec="utf-8")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(1, 9))
def test_starts_are_those_of_the_pattern_in_any_sections(text, section):
    plain = [m.start() for m in re.finditer(infilling.LINES, text)]
    assert infilling.LineSplitter()(text) == plain
    assert infilling.LineSplitter(section=section)(text) == plain


def plain_row(doc_id, text):
    """The row by the contract's words, with re instead of the pre-tokenizer."""
    text = text or ""
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return doc_id, n, "plain", None, None, text
    p, m, s = "".join(lines[:low]), "".join(lines[low:high]), "".join(lines[high:])
    if h[3] % 100 < 50:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


HARD = ["a<\n<P\nS>\nx", "<P", "<", "M>\n", "<P>", "x<S>\ny", "\n", "\n\n", "é\n😀\nlast", "<<\n<\n>P>", "<|x|>\n" * 40, "a\r\nb\rc\x0b\x0cd e\n", "<P\x00>\n<S\n\x00"]


def test_rows_and_round_trip(spark):
    rows = [(i, HARD[i % len(HARD)]) for i in range(400)] + [(None, "one\ntwo\n"), (3, None), (3, "one\ntwo"), (3, "one\ntwo")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = infilling.infilled(docs).withColumn("restored", infilling.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((*r[:6],) for r in found), key=key) == sorted((plain_row(*r) for r in rows), key=key)
    assert {(r["doc_id"], r["restored"]) for r in found} == {(i, t or "") for i, t in rows}
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}


def test_a_very_long_text_is_split_in_sections(spark, monkeypatch):
    text = "".join("x" * (i % 97) + "\n" for i in range(60_000)) + "y" * 1_500_000
    found = infilling.infilled(spark.createDataFrame([(5, text)], "doc_id long, text string")).first()
    assert tuple(found) == plain_row(5, text)


def test_rates(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a\nb\nc\n").alias("text"))
    forms = {r["form"]: r["count"] for r in infilling.infilled(docs, rate=60, suffix_first=25).groupBy("form").count().collect()}
    assert 700 < forms["plain"] < 900 and 220 < forms["spm"] < 380 and 800 < forms["psm"] < 1000


def test_marks_that_could_be_found_elsewhere_are_refused(spark):
    docs = spark.createDataFrame([(1, "a\n")], "doc_id long, text string")
    for marks in (("<P>", "<P>", "<M>"), ("aba", "<S>", "<M>"), ("<\n>", "<S>", "<M>")):
        with pytest.raises(ValueError, match="marks"):
            infilling.infilled(docs, marks=marks)


def test_nothing_is_shuffled(spark, odd_dir):
    assert "Exchange" not in infilling.op13_fill_in_middle(spark, odd_dir)._jdf.queryExecution().executedPlan().toString()
