import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import packing


@pytest.fixture(scope="module")
def encoder():
    return packing.WordEncoder(packing.tokenizer_path())


def whole(encoder, text):
    return np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aAéÀß.,!?'-_<|>19 \t\n\r\v\f\u00a0\u0301\x1c\x85İΣ日"), st.characters(codec="utf-8")), max_size=40), max_size=4))
def test_words_encode_like_whole_texts(encoder, texts):
    assert encoder(texts) == [whole(encoder, t) for t in texts]


def test_markers_and_contractions(encoder):
    texts = ["<|endoftext|> <|ENDOFTEXT|>x <|startoftext|>", "don't they'll we've. I'm 's 's, it's.", "a,,b .. c.d ,e 3.5,4", "thing, thing. THING! Éa, éa."]
    assert encoder(texts) == [whole(encoder, t) for t in texts]


def test_a_small_memory_changes_nothing(encoder, monkeypatch):
    monkeypatch.setattr(encoder, "most", 10)
    texts = [f"word{i} thing{'abcdefghij'[i % 10]} the of, and." for i in range(300)]
    expected = [whole(encoder, t) for t in texts]
    assert [encoder([t])[0] for t in texts] == expected


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_bins_hold_every_piece_once_and_never_too_much(lengths):
    bins = packing.best_two_fit(lengths, 50)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(0 < sum(lengths[i] for i in b) <= 50 for b in bins)
    # a sequence is closed only when nothing that is left fits its gap
    left = [i for b in bins for i in b]
    for b in bins:
        left = left[len(b) :]
        assert all(sum(lengths[i] for i in b) + lengths[j] > 50 for j in left)


def plain_two_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-two-fit by trying every piece and every pair of pieces."""
    free, bins = sorted(lengths, reverse=True), []
    while free:
        chosen, gap = [], capacity
        for length in list(free):
            if length <= gap:
                chosen.append(length)
                free.remove(length)
                gap -= length
        while gap and free:
            least = min(chosen)
            pairs = [(a + b, a, b) for i, a in enumerate(free) for b in free[i + 1 :] if a + b <= gap + least]
            pairs += [(a, a, 0) for a in free if a <= gap + least]
            best = max(pairs, default=(0, 0, 0))
            if best[0] <= least:
                break
            chosen.remove(least)
            for one in filter(None, best[1:]):
                chosen.append(one)
                free.remove(one)
            free = sorted([*free, least], reverse=True)
            gap = capacity - sum(chosen)
        bins.append(chosen)
    return bins


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=25))
def test_as_full_as_trying_every_pair(lengths):
    """Which of several pairs of one sum is taken differs, so sequences are compared while both are at the first of them."""
    mine = [sorted(lengths[i] for i in b) for b in packing.best_two_fit(lengths, 50)]
    plain = [sorted(b) for b in plain_two_fit(lengths, 50)]
    assert sum(mine[0]) == sum(plain[0]) if lengths else mine == plain == []
    assert -(-sum(lengths) // 50) <= len(mine) <= len(plain) + 1


def test_two_replace_one_where_they_fill_more():
    assert sorted(map(sorted, packing.best_two_fit([6, 3, 2, 2], 10))) == [[0, 2, 3], [1]]


def test_rows_round_trip(spark, odd_dir, encoder):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    found = packing.pack_documents(docs, capacity=64, chunk_tokens=500).withColumn("ids_crc32", F.crc32("ids")).toPandas()
    query = packing.op10_best_fit_packing(spark, odd_dir).toPandas()
    chained = packing.packed(packing.pieces(docs)).withColumn("ids_crc32", F.crc32("ids")).toPandas()
    for frame, capacity in ((found, 64), (query, 4096), (chained, 4096)):
        rows = sorted(docs_ids(docs, encoder, capacity))
        mine = sorted((-1 if np.isnan(r.doc_id) else int(r.doc_id), (int(r.piece), int(r.start), int(r.length), int(r.ids_crc32))) for r in frame.itertuples())
        assert rows == mine
        for _, own in frame.sort_values("offset").groupby("sequence_id"):
            assert (own["offset"].to_numpy() == np.concatenate(([0], own["length"].cumsum()[:-1]))).all() and own["length"].sum() <= capacity


def test_few_more_sequences_than_the_bound(spark):
    """On sf0.01, in four tasks with chunks of a few sequences: at most one underfull sequence a task, and one in a hundred, over the least."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(4)
    rows = packing.pack_documents(docs, ids=False, chunk_tokens=1 << 17).toPandas()
    filled = rows.groupby("sequence_id")["length"].sum()
    assert filled.max() <= 4096 and len(filled) <= -(-filled.sum() // 4096) * 1.01 + 4


def test_nothing_is_shuffled_and_whole_pieces_are_not_held(spark, encoder):
    docs = spark.createDataFrame([(i, "word " * 60_000) for i in range(20)], "doc_id long, text string").coalesce(1)
    found = packing.pack_documents(docs)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    rows = found.select("doc_id", "piece", "length", "sequence_id").toPandas()
    whole = rows[rows["length"] == 4096]
    assert len(whole) == 20 * (60_001 // 4096) and whole["sequence_id"].is_unique


def test_a_tokenizer_that_differs_is_refused(monkeypatch):
    monkeypatch.setattr(packing, "signs_together", lambda text: False)
    with pytest.raises(ValueError, match="don't encode"):
        packing.WordEncoder(packing.tokenizer_path())


def docs_ids(docs, encoder, capacity):
    for r in docs.collect():
        ids = whole(encoder, r["text"] or "") + np.array([1], "<u4").tobytes()
        for n, at in enumerate(range(0, len(ids), 4 * capacity)):
            part = ids[at : at + 4 * capacity]
            yield -1 if r["doc_id"] is None else r["doc_id"], (n, at // 4, len(part) // 4, zlib.crc32(part))
