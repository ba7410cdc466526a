from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import chat

TEXTS = st.text(alphabet=st.one_of(st.sampled_from("\\<>/turnsays|e\n ofx"), st.characters(codec="utf-8")), max_size=30)
PIECES = st.lists(st.sampled_from([*chat.MARKERS, chat.TOKENIZER_END, "\\", "<", "turn>", "a", "\n", " "]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant"]), PIECES), st.one_of(TEXTS, PIECES)), max_size=5))
def test_round_trip_and_aligned_masks(turns):
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [said for role, said in turns if role == "assistant"]
    found = chat._tokenizer(chat.TOKENIZER).encode(text, add_special_tokens=False)
    import numpy as np

    offsets = np.array(found.offsets, dtype=np.int32).reshape(-1, 2)
    for (a, b), (first, last) in zip(spans, chat.token_ranges(spans, offsets[:, 0], offsets[:, 1]), strict=True):
        assert (first == last) == (a == b)
        if last > first:  # tokens of the text and no others, also by their own offsets
            assert (offsets[first, 0], offsets[last - 1, 1]) == (a, b)


def test_ids_under_the_mask_decode_to_the_answers(spark, odd_dir):
    rows = spark.read.parquet(f"{odd_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tokenizer = chat._tokenizer(chat.TOKENIZER)
    for r in chat.formatted(rows).collect():
        ranges = list(zip(r["loss_ranges"][::2], r["loss_ranges"][1::2], strict=True))
        said = [chat.unescape(tokenizer.decode(r["input_ids"][a:b], skip_special_tokens=False)) for a, b in ranges]
        assert said == [text for role, text in chat.parse(r["formatted"]) if role == "assistant"]
