"""op11 against the sentencepiece library, text by text and by rows."""

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import sentence_pieces as sp
from plumbline.llm.packing import tokenizer_path

HARD = st.one_of(st.sampled_from("▁▁  \t\n\r\x00 ▁éÀßabeginthour.,!<>s/0019日本テ語😀́‍"), st.characters(codec="utf-8"))
TEXT = st.one_of(st.text(alphabet=HARD, max_size=60), st.text(alphabet="in the  a", max_size=80), st.text(alphabet="tionhe", max_size=300))


@pytest.fixture(scope="module")
def encoder():
    return sp.encoder_of(sp.MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(sp.MODEL))


def ids(found):
    return [int.from_bytes(found[i : i + 4], "little") for i in range(0, len(found), 4)]


@settings(max_examples=600, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_ids_are_the_librarys(encoder, library, texts):
    assert [ids(f) for f in encoder(texts)] == library.encode(texts, add_eos=True)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=HARD, min_size=1, max_size=80))
def test_heap_and_arrays_merge_alike(encoder, text):
    word = sp.SPACE + text.replace(" ", sp.SPACE)
    assert encoder.merged_together([word])[0] == encoder._spelled(encoder.merged(word))


def plain_merges(encoder, word):
    """Best pair first, by looking at all of them again after each merge."""
    symbols = list(word)
    while pairs := [(encoder.scores[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in encoder.scores]:
        i = min(pairs)[1]
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
    return symbols


def test_heap_takes_the_best_pair_first(encoder):
    draw = random.Random(3)
    for _ in range(300):
        word = "▁" + "".join(draw.choice("tionhe▁▁▁ingabé\n") for _ in range(draw.randint(0, 40)))
        assert encoder.merged(word) == plain_merges(encoder, word)


def test_ties_go_to_the_left(encoder, library):
    for n in range(1, 40):
        assert ids(encoder([" " * n])[0]) == library.encode(" " * n, add_eos=True)


def test_long_words_and_texts(encoder, library):
    draw = random.Random(1)
    texts = ["".join(draw.choice("abcdehinot") for _ in range(n)) for n in (sp.LONG - 1, sp.LONG, 5_000, 200_000)]
    texts += [" " * 3_000 + "x", "the town " * 40_000, "\n" * 5_000, "日本語" * 2_000]
    assert [ids(f) for f in encoder(texts)] == library.encode(texts, add_eos=True)


def test_a_small_memory_changes_nothing(encoder, library, monkeypatch):
    monkeypatch.setattr(sp, "KEPT", 5)
    for i in range(30):
        texts = [f"word{i} thing{j} the of and." for j in range(5)]
        assert [ids(f) for f in encoder(texts)] == library.encode(texts, add_eos=True)
    assert len(encoder.known) <= 30


def test_a_difference_stops_the_job(encoder, monkeypatch):
    monkeypatch.setattr(encoder, "end", 3)
    with pytest.raises(ValueError, match="differ"):
        encoder.checked(["a text"])


def test_models_of_another_kind_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(tokenizer_path(sp.MODEL), "rb") as file:
        model.ParseFromString(file.read())
    for change in ("unigram", "user", "spaces", "bytes"):
        other = sentencepiece_model_pb2.ModelProto()
        other.CopyFrom(model)
        if change == "unigram":
            other.trainer_spec.model_type = other.trainer_spec.UNIGRAM
        elif change == "user":
            other.pieces[500].type = 4
        elif change == "spaces":
            other.normalizer_spec.remove_extra_whitespaces = True
        else:
            other.trainer_spec.byte_fallback = False
            del other.pieces[3:259]
        path = tmp_path / f"{change}.model"
        path.write_bytes(other.SerializeToString())
        with pytest.raises(ValueError, match=str(path)):
            sp.PieceEncoder(str(path))


def expected(library, rows):
    found = Counter()
    for doc_id, text in rows:
        own = library.encode(text or "", add_eos=True)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        found[doc_id, len(own), digest(" ".join(map(str, own))), digest(library.decode(own))] += 1
    return found


@pytest.mark.parametrize("tables", ["generated", "odd"])
def test_rows_of_the_query(spark, library, odd_dir, tables):
    folder = {"generated": "/root/testdata/sf0.01", "odd": odd_dir}[tables]
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    rows = sp.op11_sentence_pieces(spark, folder).collect()
    assert Counter(tuple(r) for r in rows) == expected(library, docs)


def test_encode_then_decode(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    back = sp.decoded(sp.encoded(docs)).collect()
    texts = Counter((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect())
    assert Counter(tuple(r) for r in back) == texts
    none = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {tuple(r) for r in sp.decoded(none).collect()} == {(1, ""), (2, "")}


def test_nothing_is_shuffled(spark, odd_dir):
    assert "Exchange" not in sp.op11_sentence_pieces(spark, odd_dir)._jdf.queryExecution().executedPlan().toString()
