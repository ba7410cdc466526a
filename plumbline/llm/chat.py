"""Chat formatting with loss masks aligned by offsets.

A conversation is rendered whole, turn after turn as `<turn>role<says>text</turn>\n`, and
encoded once, with offsets. The character spans of the texts to learn are sorted, as the
tokens' spans are, so a binary search finds the first and last token of each; the mask is
those ranges. The three markers are added to the vocabulary as special tokens, which no merge
crosses, so a text's span begins and ends with a token.

Markers inside a role or text (and the vocabulary's own end marker) get a backslash after
their first character, and backslashes are doubled: `unescape` takes that back exactly, and
nothing but a real marker reads as one.

Turns are ordered by turn (null first), then role and text. Null roles and texts are empty;
rows without conv_id form one conversation. Repeated rows are turns of their own. Rows of a
conversation meet in one row of the result, which is what is trained on; conversations are
spread by conv_id.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from plumbline.llm.common import read, small_batches

TURN, SAYS, END = "<turn>", "<says>", "</turn>"
MARKERS = (TURN, SAYS, END)
TOKENIZER, TOKENIZER_END = "byte_bpe_50k.json", "<|endoftext|>"
LEARNED_ROLE = "assistant"

#: The contract's extra conversation.
EXTRA = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]

_TURNS = re.compile(f"{TURN}(.*?){SAYS}(.*?){END}\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for marker in (*MARKERS, TOKENIZER_END):
        text = text.replace(marker, f"{marker[0]}\\{marker[1:]}")
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]], learned: str = LEARNED_ROLE) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans of its learned texts (as escaped) in order."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{SAYS}", escape(text)
        if role == learned:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns again."""
    return [(unescape(role), unescape(text)) for role, text in _TURNS.findall(formatted)]


def token_ranges(spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """For each character span the half-open range of tokens that overlap it; starts and ends don't fall."""
    if not spans:
        return []
    begin, stop = np.array(spans).T
    first = np.searchsorted(ends, begin, "right")
    last = np.maximum(first, np.searchsorted(starts, stop, "left"))
    return list(zip(first.tolist(), last.tolist(), strict=True))


_tokenizers: dict = {}


def _tokenizer(name: str):
    if name not in _tokenizers:
        import public_tokenizers
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(public_tokenizers.path(name))
        loaded.add_special_tokens(list(MARKERS))
        _tokenizers[name] = loaded
    return _tokenizers[name]


def formatted(conversations: DataFrame, tokenizer: str = TOKENIZER, learned: str = LEARNED_ROLE) -> DataFrame:
    """conv_id, formatted, input_ids, token_starts, token_ends (character offsets), loss_ranges (token ranges).

    conversations has conv_id, turn, role and text.
    """
    small_batches(conversations.sparkSession)
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    ints = pa.list_(pa.int32())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _tokenizer(tokenizer)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                rendered = [render([(t["role"], t["text"]) for t in turns], learned) for turns in part.column(1).to_pylist()]
                columns: list[list] = [[], [], [], []]
                for (_, spans), found in zip(rendered, encoder.encode_batch([text for text, _ in rendered], add_special_tokens=False), strict=True):
                    offsets = np.array(found.offsets, dtype=np.int32).reshape(-1, 2)
                    ranges = token_ranges(spans, offsets[:, 0], offsets[:, 1])
                    for column, value in zip(columns, (found.ids, offsets[:, 0], offsets[:, 1], np.array(ranges, np.int32).reshape(-1)), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([text for text, _ in rendered], pa.string()), *[pa.array(c, ints) for c in columns]],
                    names=["conv_id", "formatted", "input_ids", "token_starts", "token_ends", "loss_ranges"],
                )

    schema = conversations.select("conv_id").schema.add("formatted", "string")
    for name in ("input_ids", "token_starts", "token_ends", "loss_ranges"):
        schema = schema.add(name, ArrayType(IntegerType()))
    return whole.mapInArrow(encode, schema)


def digests(chats: DataFrame) -> DataFrame:
    """What the output of `formatted` says when read back: the contract's columns."""

    def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[], [], [], [], []]
            for text, starts, ends, ranges in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                turns = parse(text)
                whole = hashlib.sha256("".join(f"{role}\n{said}\n" for role, said in turns).encode())
                loss = "".join(
                    unescape(text[starts[first] : ends[last - 1]]) for first, last in zip(ranges[::2], ranges[1::2], strict=True) if last > first
                )
                for column, value in zip(rows, (len(turns), whole.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)), strict=True):
                    column.append(value)
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(rows, types, strict=True)]],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    schema = chats.select("conv_id").schema
    for name, kind in (("n_turns", "long"), ("turns_sha256", "string"), ("loss_chars", "long"), ("loss_sha256", "string"), ("formatted_chars", "long")):
        schema = schema.add(name, kind)
    return chats.select("conv_id", "formatted", "token_starts", "token_ends", "loss_ranges").mapInArrow(read_back, schema)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string")
    return digests(formatted(rows.unionByName(extra)))


ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(replace(replace(replace(replace(replace(role, '\', '\\'), '<turn>', '<\turn>'), '<says>', '<\says>'), '</turn>', '<\/turn>'), '<|endoftext|>', '<\|endoftext|>'))
          + length(replace(replace(replace(replace(replace(text, '\', '\\'), '<turn>', '<\turn>'), '<says>', '<\says>'), '</turn>', '<\/turn>'), '<|endoftext|>', '<\|endoftext|>')) + 20 AS chars
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
