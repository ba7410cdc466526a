"""Best-fit packing: fill a sequence greedily, then try two for one.

Documents are tokenized once, an end token is added, and those over the capacity are cut into
whole pieces and a rest. A whole piece is a sequence of its own and goes on at once. A task gathers
rests into chunks of CHUNK_TOKENS tokens and packs each: a sequence takes the largest pieces that
fit its gap; while a gap is left, its smallest piece is replaced by the two unpacked pieces that
together fill the gap it leaves best, if they fill more than it did. The last sequence of a chunk
is opened again for the next one, so a task leaves at most one underfull for want of pieces, of
some thousand that a partition of 100 MB fills.

Nothing is shuffled: packing is a map over the partitions of the documents. A task holds one chunk,
whatever the number or length of documents, beside the text it encodes. Equal rows are separate
documents.

A null or empty text is the end token alone. Null ids are packed like others.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator
from itertools import chain
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.llm.common import blocks, read, small_batches

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Tokens of the rests that are packed together.
CHUNK_TOKENS = 1 << 21
#: Texts encoded together by a task: so many, and so many characters of them, at most (or one text).
TOGETHER, MOST_CHARS = 256, 1 << 20
#: Lines of 256 words that go through the merges together.
LINES = 16
#: Words whose ids a worker keeps before it forgets all but those in use: a bound on its memory only.
KEPT_WORDS = 250_000

#: Texts on which a tokenizer is tried when a worker loads it.
PROBES = ("The Quick brown fox, it's 3.5 (don't)... <|endoftext|> x", "É à ß ﬁ İ 日本語 e\u0301\tab\nnew", "a,,b .. c.d ,e --- __init__ <b>&")
#: Latin letters whose lower case and composed form don't depend on other letters.
_LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e]+")
#: Where signs stand together they make one word; a comma or stop by itself is a word of its own, wherever it stands.
_SIGNS_TOGETHER = re.compile(r"(?:[^\w\s]|_){2}")
_LATIN_SIGNS = np.array([re.fullmatch(r"[^\w\s]|_", chr(i)) is not None for i in range(256)])
#: The letters that byte-level tokenizers write for bytes that don't print, in order of the bytes.
_BYTE_LETTERS = {byte: 256 + n for n, byte in enumerate([*range(33), *range(127, 161), 173])}


def signs_together(text: str) -> bool:
    """Whether two signs (neither letters, digits nor white space) stand side by side."""
    try:
        signs = _LATIN_SIGNS[np.frombuffer(text.encode("latin-1"), np.uint8)]
    except UnicodeEncodeError:
        return _SIGNS_TOGETHER.search(text) is not None
    return bool((signs[1:] & signs[:-1]).any())


class WordEncoder:
    """Ids of texts by a word-end BPE tokenizer that never joins characters across white space.

    A word's ids don't depend on its neighbours there, so each word is encoded once and kept
    as bytes. Words of Latin letters, with or without ASCII punctuation after them, need no
    more of the tokenizer than lower case, its byte letters and its merges: many go through the
    merges at once, and the tokens that end a word tell them apart. All other words are encoded
    as they stand. The result is that of encoding the whole text, which the tests compare.
    """

    def __init__(self, path: str) -> None:
        # Tasks are the parallelism: a pool of threads in each would only hold memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}
        self.most = KEPT_WORDS
        # A file whose tokenizer normalises or splits otherwise must not give wrong ids silently.
        for text in PROBES:
            if self([text])[0] != np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes():
                raise ValueError(f"words of {path} don't encode as they do in whole texts: {text!r}")

    def _latin(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words of Latin letters."""
        forms = [w.lower() if w.isascii() else w.lower().encode().decode("latin-1").translate(_BYTE_LETTERS) for w in words]
        lines = [" ".join(forms[i : i + 256]) for i in range(0, len(forms), 256)]
        few = (self.merges.encode_batch_fast(lines[i : i + LINES], add_special_tokens=False) for i in range(0, len(lines), LINES))
        ids = np.fromiter(chain.from_iterable(x.ids for found in few for x in found), "<u4")
        stops = 4 * (np.flatnonzero(self.ends[ids]) + 1)
        if len(stops) != len(words):
            raise ValueError("this tokenizer doesn't mark the ends of words")
        data, stops = ids.tobytes(), stops.tolist()
        return {w: data[a:b] for w, a, b in zip(words, [0, *stops], stops)}  # noqa: B905  one start more

    def _whole(self, words: list[str]) -> dict[str, bytes]:
        return {w: np.array(x.ids, "<u4").tobytes() for w, x in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True)}

    def forget(self) -> None:
        """Workers outlive their tasks; the words of one needn't."""
        self.known = {"": b""}

    def __call__(self, texts: list[str]) -> list[bytes]:
        for sign in "\t\n\v\f\r":
            texts = [t.replace(sign, " ") for t in texts]
        texts = [t if signs_together(t) else t.replace(",", " ,").replace(".", " .") for t in texts]
        split = [(t.lower() if t.isascii() and "<|" not in t else t).split(" ") for t in texts]
        words = set(chain.from_iterable(split))
        new = words.difference(self.known)
        if len(self.known) + len(new) > self.most:  # words that come again are worth keeping
            self.known = {w: self.known[w] for w in words.intersection(self.known).union([""])}
        known = self.known
        plain = list(filter(_LATIN.fullmatch, new))
        known |= self._latin(plain)
        new.difference_update(plain)
        both = [(w, s) for w in new if _LATIN.fullmatch(s := w.rstrip(punctuation))]
        known |= self._latin(list({s for _, s in both}.difference(known)))
        new.difference_update(w for w, _ in both)
        known |= self._whole(list(new.union(w[len(s) :] for w, s in both).difference(known)))
        known |= {w: known[s] + known[w[len(s) :]] for w, s in both}
        get = known.__getitem__
        return [b"".join(map(get, words)) for words in split]


_encoders: dict[str, WordEncoder] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where this machine has the public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


Batches = Iterator[pa.RecordBatch]


def _pieces_schema(docs: DataFrame, ids: bool) -> StructType:
    schema = docs.select("doc_id").schema.add("piece", "integer").add("start", "long").add("length", "long")
    return schema.add("ids", "binary") if ids else schema.add("ids_crc32", "long")


def _cutter(tokenizer: str, capacity: int, end_id: int, ids: bool) -> Callable[[Batches], Batches]:
    """From batches (doc_id, text) to batches of pieces, with their ids or, to hold less, only the CRC-32 of those."""
    end = np.array([end_id], "<u4").tobytes()

    def cut_pieces(batches: Batches) -> Batches:
        path = tokenizer_path(tokenizer)
        if path not in _encoders:
            _encoders[path] = WordEncoder(path)
        encoder = _encoders[path]
        # Ids take memory of their own, so fewer words are kept beside them.
        encoder.most = KEPT_WORDS // 5 if ids else KEPT_WORDS
        for batch in batches:
            for part in blocks(batch, [1], TOGETHER, MOST_CHARS):
                rows, piece, start, length, carried = [], [], [], [], []
                for row, found in enumerate(encoder([t or "" for t in part.column(1).to_pylist()])):
                    found += end
                    for at in range(0, len(found), 4 * capacity):
                        own = found[at : at + 4 * capacity]
                        rows.append(row)
                        piece.append(at // (4 * capacity))
                        start.append(at // 4)
                        length.append(len(own) // 4)
                        carried.append(own if ids else zlib.crc32(own))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(carried, pa.binary() if ids else pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids" if ids else "ids_crc32"],
                )
        encoder.forget()
        pa.default_memory_pool().release_unused()

    return cut_pieces


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids (binary: little-endian unsigned 32-bit) of all documents, cut at capacity."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_cutter(tokenizer, capacity, end_id, True), _pieces_schema(docs, True))


def best_two_fit(lengths: list[int] | np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of positions in lengths, each of at most capacity in sum.

    Every bin takes the largest unpacked piece that fits, again and again; then, while it has a gap,
    its smallest piece gives way to the best two unpacked ones if those fill more.
    """
    lengths = np.asarray(lengths, dtype=np.int64)
    stacks: dict[int, list[int]] = {}
    for at in range(len(lengths) - 1, -1, -1):
        stacks.setdefault(int(lengths[at]), []).append(at)
    free = sorted(stacks)

    def take(length: int) -> int:
        at = stacks[length].pop()
        if not stacks[length]:
            del stacks[length]
            free.pop(bisect_right(free, length) - 1)
        return at

    def give(length: int, at: int) -> None:
        if length not in stacks:
            stacks[length] = []
            insort(free, length)
        stacks[length].append(at)

    def best_pair(room: int) -> tuple[int, int]:
        near = np.array(free[: bisect_right(free, room)], dtype=np.int64)
        if not len(near):
            return 0, 0
        other = np.searchsorted(near, room - near, "right") - 1
        single = (other == np.arange(len(near))) & np.array([len(stacks[v]) < 2 for v in near.tolist()])
        other = other - single
        total = np.where(other >= 0, near + near[other], -1)
        best = int(total.argmax())
        return (int(near[best]), int(near[other[best]])) if total[best] > 0 else (0, 0)

    bins: list[list[int]] = []
    while free:
        gap, chosen = capacity, []
        while free and (low := bisect_right(free, gap)):
            length = free[low - 1]
            chosen.append((length, take(length)))
            gap -= length
        if not chosen:
            raise ValueError(f"a piece of {free[-1]} doesn't fit {capacity}")
        while gap and free:
            chosen.sort(reverse=True)
            least, at = chosen[-1]
            one, two = best_pair(gap + least)
            if one + two <= least:
                break
            chosen[-1:] = [(one, take(one)), (two, take(two))]
            give(least, at)
            gap += least - one - two
        bins.append([at for _, at in chosen])
    return bins


def _packer(capacity: int, chunk_tokens: int) -> Callable[[Batches], Batches]:
    """Adds sequence_id and offset to batches of pieces, which it emits in the order of sequences."""

    def pack(batches: Batches) -> Batches:
        made = TaskContext.get().partitionId() << 40
        waiting: list[pa.RecordBatch] = []
        tokens = 0

        def placed(rows: pa.Table, bins: list[list[int]], lengths: np.ndarray) -> Batches:
            nonlocal made
            counts = np.array([len(b) for b in bins], np.int64)
            order = np.array(list(chain.from_iterable(bins)), np.int64)
            upto = np.cumsum(lengths[order]) - lengths[order]
            offset = upto - np.repeat(upto[np.cumsum(counts) - counts], counts) if len(order) else upto
            sequence = made + np.repeat(np.arange(len(bins)), counts)
            made += len(bins)
            yield from rows.take(pa.array(order)).append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64())).to_batches(max_chunksize=1024)

        def flush(last: bool) -> Batches:
            nonlocal waiting, tokens
            rows = pa.Table.from_batches(waiting)
            lengths = rows.column("length").to_numpy()
            bins = best_two_fit(lengths, capacity)
            again = [] if last else bins.pop()
            yield from placed(rows, bins, lengths)
            waiting, tokens = rows.take(pa.array(again, pa.int64())).to_batches(), int(lengths[again].sum())

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            lengths = rows.column("length").to_numpy()
            whole = np.flatnonzero(lengths == capacity)
            yield from placed(rows, [[i] for i in whole.tolist()], lengths)
            rests = np.flatnonzero(lengths < capacity)
            if len(rests):
                waiting += rows.take(pa.array(rests)).to_batches()
                tokens += int(lengths[rests].sum())
            if tokens >= chunk_tokens:
                yield from flush(False)
        if waiting:
            yield from flush(True)

    return pack


def packed(found: DataFrame, capacity: int = CAPACITY, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """found (length, of at most capacity, and any more columns) plus sequence_id and offset."""
    schema = StructType([*found.schema.fields]).add("sequence_id", "long").add("offset", "long")
    return found.mapInArrow(_packer(capacity, chunk_tokens), schema)


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = True, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Packed pieces with their token ids (or ids_crc32): the rows of one sequence_id, in order of offset, are a training sequence."""
    small_batches(docs.sparkSession)
    cutter, packer = _cutter(tokenizer, capacity, end_id, ids), _packer(capacity, chunk_tokens)
    schema = _pieces_schema(docs, ids).add("sequence_id", "long").add("offset", "long")
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(lambda batches: packer(cutter(batches)), schema)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), ids=False)
