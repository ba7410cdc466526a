"""SentencePiece encoding and decoding for merge-type vocabularies.

A text's symbols are its characters, white space written as the mark of SPACE and one put in front. An agenda
holds the adjacent pairs that make a piece of the vocabulary, by score and then from the left; the best pair
becomes one symbol and brings in the pairs it makes with its neighbours, until none is left. Characters that
are no piece then become byte pieces.

No piece of such a vocabulary has white space after another character, so a word with the white space before it
has an agenda of its own. The agendas of the new words of a batch are kept in arrays and served together, one
pair of each word a round; a word of over LONG characters has a heap. A worker remembers KEPT words at most.
Every Arrow batch is encoded by the sentencepiece library too, text by text; a text whose ids differ stops the job.

A null text counts as empty; an empty text is the end id alone. Rows that share an id or have none are encoded
each for itself. Nothing is shuffled; a task holds the rows that are encoded together: at most MOST_CHARS
characters, or one text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from plumbline.llm.common import blocks, read, small_batches
from plumbline.llm.packing import tokenizer_path

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Texts encoded together: so many, and so many characters of them, at most (or one text).
TOGETHER, MOST_CHARS = 128, 1 << 20
#: Words whose ids a worker keeps before it forgets all but those in use: a bound on its memory only.
KEPT = 300_000
#: Characters from which a word's agenda is a heap: in arrays it would take a round for each of its merges.
LONG = 200

#: Kinds of pieces in the public model format.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: The rank of a pair that makes no piece, and the number from which characters that are no piece are numbered.
NO_PAIR, NO_PIECE = 1 << 30, 1 << 28


class PieceEncoder:
    """Ids of texts by a merge-type model, as the sentencepiece library gives them."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kinds = {piece.type for piece in model.pieces}
        normal = model.normalizer_spec
        if model.trainer_spec.model_type != model.trainer_spec.BPE or model.trainer_spec.treat_whitespace_as_suffix or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"{path} isn't a merge-type vocabulary without pieces of its user's own")
        if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not (normal.add_dummy_prefix and normal.escape_whitespaces):
            raise ValueError(f"{path} normalises texts; only models that leave them alone are taken")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.scores = {p.piece: -p.score for p in model.pieces if p.type == NORMAL}
        if any(b == SPACE != a for piece in self.ids for a, b in pairwise(piece)):
            raise ValueError(f"{path} has pieces with white space after other characters")
        if BYTE not in kinds:
            raise ValueError(f"{path} has no byte pieces")
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.end = self.library.eos_id()
        self._index()
        self.known: dict[str, bytes] = {}

    def _index(self) -> None:
        """Numbers of characters, and by pair of symbols the rank of its score and what it makes.

        A piece's number is its id, that of another character NO_PIECE and its code point.
        """
        self.of_char = np.arange(NO_PIECE, NO_PIECE + 0x110000, dtype=np.int64)
        for symbol, number in self.ids.items():
            if len(symbol) == 1:
                self.of_char[ord(symbol)] = number

        def number(symbol: str) -> int | None:
            return int(self.of_char[ord(symbol)]) if len(symbol) == 1 else self.ids.get(symbol)

        ranks = {score: rank for rank, score in enumerate(sorted(set(self.scores.values())))}
        pairs = {}
        for piece, made in self.ids.items():
            for i in range(1, len(piece)):
                left, right = number(piece[:i]), number(piece[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = (ranks[self.scores[piece]], made)
        self.pairs = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([*(pairs[k][0] for k in self.pairs.tolist()), NO_PAIR], np.int64)
        self.makes = np.array([*(pairs[k][1] for k in self.pairs.tolist()), 0], np.int64)

    def _found(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and product of each pair of symbols; NO_PAIR where they make no piece."""
        keys = left << 32 | right
        at = np.searchsorted(self.pairs, keys)
        at[self.pairs[np.minimum(at, len(self.pairs) - 1)] != keys] = len(self.pairs)
        return self.ranks[at], self.makes[at]

    def merged(self, word: str) -> list[str]:
        """The symbols of word when no adjacent pair makes a piece any more, by a heap."""
        scores, symbols, last = self.scores, list(word), len(word) - 1
        right, left = list(range(1, len(word) + 1)), list(range(-1, last))
        agenda = [(scores[pair], i, 2) for i in range(last) if (pair := word[i : i + 2]) in scores]
        heapify(agenda)
        while agenda:
            _, i, size = heappop(agenda)
            j = right[i]
            # a pair is stale when one of its symbols has been merged since
            if j > last or not symbols[i] or len(symbols[i]) + len(symbols[j]) != size:
                continue
            symbols[i] += symbols[j]
            symbols[j] = ""
            right[i] = after = right[j]
            if after <= last:
                left[after] = i
                if (pair := symbols[i] + symbols[after]) in scores:
                    heappush(agenda, (scores[pair], i, len(pair)))
            if (before := left[i]) >= 0 and (pair := symbols[before] + symbols[i]) in scores:
                heappush(agenda, (scores[pair], before, len(pair)))
        return [s for s in symbols if s]

    def _spelled(self, symbols: list[str]) -> bytes:
        """Ids of symbols, byte pieces for those that are no piece."""
        return np.array([i for s in symbols for i in ([self.ids[s]] if s in self.ids else [self.bytes[b] for b in s.encode()])], "<i4").tobytes()

    def merged_together(self, words: list[str]) -> list[bytes]:
        """Ids of words, none of them empty: in each round the best pair of every word becomes one symbol."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        symbols = self.of_char[codes]
        starts, numbers = np.cumsum(sizes) - sizes, np.arange(len(words))
        ranks, makes = self._found(symbols, np.append(symbols[1:], NO_PIECE))
        ranks[starts + sizes - 1] = NO_PAIR
        done_words, done_symbols = [], []
        while len(numbers):
            best = np.minimum.reduceat(ranks << 32 | np.arange(len(ranks)), starts)
            live = best < NO_PAIR << 32
            if not live.all():
                ended = np.repeat(~live, sizes)
                done_words.append(np.repeat(numbers[~live], sizes[~live]))
                done_symbols.append(symbols[ended])
                moved = np.cumsum(ended)
                at = (best & 0xFFFFFFFF)[live]
                at -= moved[at]
                symbols, ranks, makes = symbols[~ended], ranks[~ended], makes[~ended]
                sizes, numbers = sizes[live], numbers[live]
                starts = np.cumsum(sizes) - sizes
            else:
                at = best & 0xFFFFFFFF
            if not len(numbers):
                break
            symbols[at] = makes[at]
            stays = np.ones(len(symbols), bool)
            stays[at + 1] = False
            last = at + 2 == starts + sizes
            symbols, ranks, makes = symbols[stays], ranks[stays], makes[stays]
            sizes = sizes - 1
            starts = np.cumsum(sizes) - sizes
            at = at - np.arange(len(at))
            ranks[at[last]] = NO_PAIR
            changed = np.concatenate((at[~last], at[at > starts] - 1))
            ranks[changed], makes[changed] = self._found(symbols[changed], symbols[changed + 1])
        owner, flat = np.concatenate(done_words), np.concatenate(done_symbols)
        order = np.argsort(owner, kind="stable")
        owner, flat = owner[order], flat[order]
        ends = np.cumsum(np.bincount(owner, minlength=len(words)))
        data, stops = flat.astype("<i4").tobytes(), (4 * ends).tolist()
        found = [data[a:b] for a, b in pairwise([0, *stops])]
        for i in np.unique(owner[flat >= NO_PIECE]).tolist():
            own = flat[ends[i - 1] if i else 0 : ends[i]].tolist()
            found[i] = np.array([x for s in own for x in ([s] if s < NO_PIECE else [self.bytes[b] for b in chr(s - NO_PIECE).encode()])], "<i4").tobytes()
        return found

    def words(self, text: str) -> list[str]:
        """The words of a text, each with the white space before it."""
        text = text.replace(SPACE, " ")
        if "  " not in text and not text.startswith(" ") and not text.endswith(" "):
            return text.split(" ") if text else []
        found, spaces = [], -1
        for word in text.split(" "):
            spaces += 1
            if word:
                found.append(" " * spaces + word)
                spaces = -1
        return [*found, " " * spaces] if spaces >= 0 else found

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids with the end id, by the agenda, as little-endian 32-bit integers."""
        split = [self.words(t) for t in texts]
        words = set(chain.from_iterable(split))
        new = list(words.difference(self.known))
        if len(self.known) + len(new) > KEPT:  # words that come again are worth keeping
            self.known = {w: self.known[w] for w in words if w in self.known}
        known = self.known
        short = [w for w in new if len(w) < LONG]
        if short:
            known |= zip(short, self.merged_together([SPACE + w.replace(" ", SPACE) for w in short]), strict=True)
        known |= {w: self._spelled(self.merged(SPACE + w.replace(" ", SPACE))) for w in new if len(w) >= LONG}
        get, end = known.__getitem__, np.array([self.end], "<i4").tobytes()
        return [b"".join(map(get, words)) + end for words in split]

    def checked(self, texts: list[str]) -> tuple[list[bytes], list[list[int]]]:
        """The same, compared with the library's, which are returned beside them."""
        found, theirs = self(texts), self.library.encode(texts, add_eos=True, num_threads=1)
        for text, mine, ids in zip(texts, found, theirs, strict=True):
            if mine != np.array(ids, "<i4").tobytes():
                raise ValueError(f"ids differ from those of the sentencepiece library: {text[:200]!r}")
        return found, theirs

    def forget(self) -> None:
        """Workers outlive their tasks; what one remembers needn't."""
        self.known = {}


_encoders: dict[str, PieceEncoder] = {}
Batches = Iterator[pa.RecordBatch]


def encoder_of(model: str) -> PieceEncoder:
    path = tokenizer_path(model)
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def _id_lists(found: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(f) // 4 for f in found)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4")))


def _encode(model: str, back: bool) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        encoder = encoder_of(model)
        for batch in batches:
            for part in blocks(batch, [1], TOGETHER, MOST_CHARS):
                found, ids = encoder.checked(part.column(1).to_pylist())
                columns, names = [part.column(0), _id_lists(found)], ["doc_id", "ids"]
                if back:
                    columns.append(pa.array(encoder.library.decode(ids, num_threads=1), pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names=names)
        encoder.forget()
        pa.default_memory_pool().release_unused()

    return run


def encoded(docs: DataFrame, model: str = MODEL, back: bool = False) -> DataFrame:
    """doc_id, ids (with the end id) of each row of docs; with back, also decoded, what the library's decode makes of ids."""
    small_batches(docs.sparkSession)
    schema = docs.select("doc_id").schema.add("ids", ArrayType(IntegerType()))
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return docs.select("doc_id", text).mapInArrow(_encode(model, back), schema.add("decoded", "string") if back else schema)


def decoded(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and the text of ids, an array of int; null or empty ids give an empty text."""
    small_batches(rows.sparkSession)

    def run(batches: Batches) -> Batches:
        library = encoder_of(model).library
        for batch in batches:
            texts = library.decode([ids or [] for ids in batch.column(1).to_pylist()], num_threads=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, rows.select("doc_id").schema.add("text", "string"))


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encoded(read(spark, sf_dir, "documents"), back=True)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
