"""TF-IDF bags of texts, with the exact document frequency of every shingle that texts share.

A text's elements are its five-word shingles, weighing times * idf with idf = 1 + ln(N / df), where
df of the N documents hold the shingle (copies of a text count each). Shingles that at most one document in RARE holds
weigh alike: what tells them apart is how many near copies their text has, and an edit would weigh the more the
larger the table and the fewer its own copies. So groups of up to N / RARE near copies are told by their plain overlap.

Frequencies come from one exchange of packed hashes. Texts are dealt to blocks by their digest; a
text that many rows carry is sent once by each task. A block sends the sorted hashes of its
shingles, each once with the documents that hold it, to buckets of the hash space; a bucket
counts every hash over all blocks and answers each block with those that several texts hold. No
hash is a hot key, since a block sends it once, and no table of frequencies is broadcast or
collected. A shingle without an answer is in no other text, so its df is the copies of its own.

A text can only be similar to others in shingles that they share. Where those weigh less than
the threshold's share of the whole text, no similarity reaches the threshold (the union holds at
least the whole text), so such texts get no bag. The others keep only their shared shingles, and the
weight of all.

Shingles are told apart by 48-bit hashes. Of D different ones a share of about 1 - exp(-D / 2^48) has the
hash of another and counts as shared, with both frequencies: 1 in 280,000 for 10^9 shingles, 0.36 % for
10^12, 3.5 % for 10^13. A text that shares nothing then gets a small bag more often, and its weights are
off by that share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shingles import HASH_BITS, shingles, windows

#: Characters of a block's texts on average, and of all texts for a bucket of the hash space.
BLOCK_CHARS, BUCKET_CHARS = 1 << 20, 1 << 22
#: Texts hashed together by a task: so many, and so many characters of them, at most (or one text).
TOGETHER, MOST_CHARS = 256, 1 << 18
#: What sums of weights may be off by; bounds leave that much room.
SLACK = 1e-9
#: One document in so many: shingles that no more of all documents hold weigh alike.
RARE = 1000
#: Runs of a text's shared shingles, in its order, that bounds on similarity tell apart.
RUNS = 32

BAG = "shingles binary, df binary, times binary, runs binary, weight double"


def packed(values: np.ndarray) -> bytes:
    """48-bit numbers as six planes of bytes, the highest first: those of sorted or small numbers compress."""
    return values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(data, np.uint8).reshape(6, -1).T
    return out.view(">u8").reshape(-1).astype(np.uint64)


def idf(df: np.ndarray, n_docs: int) -> np.ndarray:
    return 1 + np.log(np.minimum(n_docs / df, RARE))


def slices(texts: list[str]) -> Iterator[slice]:
    """Parts of texts, of at most TOGETHER texts and MOST_CHARS characters, or one text."""
    upto, low = np.cumsum([len(t) for t in texts]), 0
    while low < len(texts):
        high = int(np.searchsorted(upto, (upto[low - 1] if low else 0) + MOST_CHARS, "right"))
        high = min(max(high, low + 1), low + TOGETHER)
        yield slice(low, high)
        low = high


def placed(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, times, place) of each distinct shingle of each text, sorted by text and hash; place orders those of a text."""
    of, hashed = windows(texts)
    keyed = (of.astype(np.uint64) << np.uint64(HASH_BITS)) | hashed
    order = np.argsort(keyed, kind="stable")
    keyed = keyed[order]
    fresh = np.flatnonzero(np.concatenate(([True], keyed[1:] != keyed[:-1]))) if len(keyed) else np.zeros(0, np.int64)
    first = order[fresh]
    return of[first], hashed[first], np.diff(np.append(fresh, len(keyed))), first


def once(rows: DataFrame, heavy: dict[bytes, int]) -> DataFrame:
    """rows (digest, text) plus copies: of texts in heavy (rows that carry it, by digest) a task keeps one row; 0 for others."""
    if not heavy:
        return rows.withColumn("copies", F.lit(0).cast("long"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            kept, copies = [], []
            for i, digest in enumerate(batch.column(0).to_pylist()):
                if digest not in seen:
                    kept.append(i)
                    copies.append(heavy.get(digest, 0))
                    if copies[-1]:
                        seen.add(digest)
            part = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(copies, pa.int64())], names=["digest", "text", "copies"])

    return rows.mapInArrow(keep, "digest binary, text string, copies long")


def _distinct(block: pa.Table) -> tuple[list[bytes], list[str], np.ndarray]:
    """Digests, texts and numbers of copies of the texts of a block (digest, text, copies), each once."""
    at: dict[bytes, int] = {}
    copies: list[int] = []
    kept: list[int] = []
    for i, (digest, known) in enumerate(zip(block.column("digest").to_pylist(), block.column("copies").to_pylist(), strict=True)):
        if digest not in at:
            at[digest] = len(kept)
            kept.append(i)
            copies.append(known or 1)
        elif not known:
            copies[at[digest]] += 1
    return list(at), [t or "" for t in block.column("text").take(pa.array(kept, pa.int64())).to_pylist()], np.array(copies, np.int64)


def parts_of(hashes: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Buckets, the first bits of hashes, that sorted hashes are in, and where; the time is that of the hashes, however many buckets there are."""
    if not len(hashes):
        return
    buckets = hashes >> np.uint64(HASH_BITS - bits)
    starts = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1])))
    for bucket, low, high in zip(buckets[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(hashes)], strict=True):
        yield bucket, slice(low, high)


def frequencies(blocks: DataFrame, buckets: int) -> DataFrame:
    """(block, shingles, df) of blocks (block, digest, text, copies): the shingles of each block that several texts hold, packed."""
    bits = (buckets - 1).bit_length()
    schema = "bucket long, block long, single binary, counted binary, documents binary, texts binary"

    def send(block: pa.Table) -> pa.Table:
        _, texts, copies = _distinct(block)
        found = [shingles(texts[s])[:2] for s in slices(texts)]
        starts = [s.start for s in slices(texts)]
        hashes = np.concatenate([h for _, h in found])
        documents = copies[np.concatenate([of + start for (of, _), start in zip(found, starts, strict=True)])]
        order = np.argsort(hashes)
        hashes, documents = hashes[order], documents[order]
        fresh = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
        hashes, documents, texts_in = hashes[fresh], np.add.reduceat(documents, fresh), np.diff(np.append(fresh, len(hashes)))
        single, rows = documents == 1, []
        for bucket, part in parts_of(hashes, bits):
            one = single[part]
            rows.append((bucket, packed(hashes[part][one]), packed(hashes[part][~one]), packed(documents[part][~one]), packed(texts_in[part][~one])))
        columns = list(zip(*rows, strict=True))
        first = block.column("block")[0].as_py()
        return pa.table(
            [pa.array(columns[0], pa.int64()), pa.array([first] * len(rows), pa.int64()), *[pa.array(c, pa.binary()) for c in columns[1:]]],
            names=["bucket", "block", "single", "counted", "documents", "texts"],
        )

    def count(bucket: pa.Table) -> pa.Table:
        hashes, documents, texts, sizes = [], [], [], []
        for batch in bucket.select(["single", "counted", "documents", "texts"]).to_batches(max_chunksize=64):
            for row in batch.to_pylist():
                single, counted = unpacked(row["single"]), unpacked(row["counted"])
                ones = np.ones(len(single), np.int32)
                hashes += [single, counted]
                documents += [ones, unpacked(row["documents"]).astype(np.int64)]
                texts += [ones, unpacked(row["texts"]).astype(np.int32)]
                sizes.append(len(single) + len(counted))
        hashed, total, several = np.concatenate(hashes), np.concatenate(documents), np.concatenate(texts)
        del hashes, documents, texts
        order = np.argsort(hashed)
        hashed, source_of = hashed[order], np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
        fresh = np.flatnonzero(np.concatenate(([True], hashed[1:] != hashed[:-1])))
        held = np.diff(np.append(fresh, len(hashed)))
        total, several = np.add.reduceat(total[order], fresh), np.add.reduceat(several[order], fresh)
        del order
        shared = np.flatnonzero(np.repeat(several > 1, held))
        df = np.zeros(len(hashed), np.int64)
        df[shared] = np.repeat(total, held)[shared]
        shared = shared[np.argsort(source_of[shared], kind="stable")]
        edges = np.searchsorted(source_of[shared], np.arange(bucket.num_rows + 1))
        some = np.flatnonzero(np.diff(edges)).tolist()
        pa.default_memory_pool().release_unused()
        parts = [shared[edges[i] : edges[i + 1]] for i in some]
        return pa.table(
            [bucket.column("block").take(pa.array(some, pa.int64())), pa.array([packed(hashed[p]) for p in parts], pa.binary()), pa.array([packed(df[p]) for p in parts], pa.binary())],
            names=["block", "shingles", "df"],
        )

    return blocks.groupBy("block").applyInArrow(send, schema).groupBy("bucket").applyInArrow(count, "block long, shingles binary, df binary")


#: A function from shingle hashes, weights, and the first element of each text to an array of signatures, a row for each text.
Sign = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def bags(rows: DataFrame, n_docs: int, chars: int, heavy: dict[bytes, int], sign: Sign, threshold: float) -> DataFrame:
    """digest, signature (array of longs) and BAG of each text of rows (digest, text; all have words) that can reach the threshold.

    chars is the size of all texts, and heavy the rows that carry a text, by digest, for those that many rows carry.
    """
    n_blocks = max(1, chars // BLOCK_CHARS)
    keyed = once(rows, heavy).withColumn("block", F.pmod(F.xxhash64("digest"), F.lit(n_blocks)))
    replies = frequencies(keyed, 1 << max(0, chars // BUCKET_CHARS).bit_length())

    def weigh(block: pa.Table, answers: pa.Table) -> pa.Table:
        digests, texts, copies = _distinct(block)
        known = np.concatenate([np.zeros(0, np.uint64), *map(unpacked, answers.column("shingles").to_pylist())])
        known_df = np.concatenate([np.zeros(0, np.uint64), *map(unpacked, answers.column("df").to_pylist())]).astype(np.int64)
        order = np.argsort(known)
        known, known_df = np.append(known[order], np.uint64(1 << HASH_BITS)), np.append(known_df[order], 0)
        out = []
        for part in slices(texts):
            of, hashes, times, place = placed(texts[part])
            at = np.searchsorted(known, hashes)
            shared = known[at] == hashes
            df = np.where(shared, known_df[at], copies[part][of])
            weight = times * idf(df, n_docs)
            n = part.stop - part.start
            total, common = np.bincount(of, weight, n), np.bincount(of, weight * shared, n)
            can = (common > 0) & (common >= (threshold - SLACK) * total)
            whole, of_can, chosen = can[of], shared & can[of], np.flatnonzero(can)
            if not len(chosen):
                continue
            starts = np.searchsorted(of[whole], chosen)
            signatures = sign(hashes[whole], weight[whole], starts)
            of, hashes, times, place, df = of[of_can], hashes[of_can], times[of_can], place[of_can], df[of_can]
            edges = np.searchsorted(of, np.append(chosen, n))
            by_place = np.lexsort((place, of))
            rank = np.arange(len(of)) - np.searchsorted(of, of)
            runs = np.empty(len(of), np.uint8)
            runs[by_place] = rank * RUNS // np.bincount(of, minlength=n)[of]
            for row, text in enumerate(chosen.tolist()):
                s = slice(edges[row], edges[row + 1])
                out.append((digests[part.start + text], signatures[row].view(np.int64), packed(hashes[s]), packed(df[s]), packed(times[s]), runs[s].tobytes(), total[text]))
        columns = list(zip(*out, strict=True)) or [[]] * 7
        kinds = [pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.float64()]
        return pa.table([pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)], names=["digest", "signature", "shingles", "df", "times", "runs", "weight"])

    return keyed.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(weigh, f"digest binary, signature array<long>, {BAG}")


def bag(row: dict, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shared shingles of a bag and their weights."""
    return unpacked(row["shingles"]), unpacked(row["times"]).astype(np.int64) * idf(unpacked(row["df"]).astype(np.int64), n_docs)


def similarity(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray], weight_one: float, weight_two: float) -> float:
    """Weighted Jaccard of two texts from their sorted (shingles, weights), of the shared ones at least, and the weights of all."""
    _, a, b = np.intersect1d(one[0], two[0], assume_unique=True, return_indices=True)
    shared = np.minimum(one[1][a], two[1][b]).sum()
    return float(shared / (weight_one + weight_two - shared))
