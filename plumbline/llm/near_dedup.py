"""Near-dedup: consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

A text's elements are its five-word shingles, weighing times * idf, with the exact document
frequencies and the bound on idf of `bags`; texts that share too little of their weight with all others to be similar
to any have no bag and stay apart.

Improved consistent weighted sampling draws BANDS * ROWS samples of each text; texts that agree
in the samples of a band meet in a bucket. Equal texts are one node throughout.

Within a bucket the node whose buckets hold the most is compared with all others; of a large
group of near copies that is the text they derive from. Links make components. A bucket
that still holds several components goes on: nodes outside its largest component are
compared with all nodes of other components, GROWTH times as many in each round, until every
pair of the bucket was compared, lies in one component, or can't be similar enough. That last
is known from bounds: no intersection holds a shingle that no other text of an open bucket has,
nor more of a run of the centre's shingles than both texts kept of it. So no candidate pair
that could join two components is dropped, none within a component is emitted, and no bucket
is collected. Every link is verified on the bags of whole texts.

Texts without words have no links; they stay apart, also from each other. Null texts count as
empty. Of a class the smallest doc_id stays (null last), of rows that repeat id and text one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.bags import BAG, RUNS, SLACK, bag, bags, similarity
from plumbline.llm.common import WORD, bounded, by_size, cut, forget, ordered_id, read, release, small_batches, without_marked
from plumbline.llm.components import components
from plumbline.llm.exact_dedup import CHANGED_RUN, heavy_winners
from plumbline.llm.shingles import HASH_BITS, mix

THRESHOLD = 0.8
BANDS, ROWS = 12, 4
#: Bags of this size in all are broadcast to their pairs; beyond it both are shuffled.
BROADCAST_BYTES = 16 << 20
#: How many times more nodes of a bucket are compared with its others in each further round.
GROWTH = 1024
#: Parts in which the nodes of a bucket are ranked first.
SALTS = 64

_BAG = [field.split()[0] for field in BAG.split(", ")]


def text_digest(text: Column) -> Column:
    """What equal texts share: MD5 of the lower-cased words with single spaces."""
    return F.unhex(F.md5(F.trim(F.regexp_replace(F.lower(text), CHANGED_RUN, " "))))


def _has_words(text: Column) -> Column:
    return F.coalesce(text.rlike(WORD), F.lit(False))


def samples(hashes: np.ndarray, weight: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Improved consistent weighted samples: a row of n 64-bit values for each run of elements that begins at starts.

    Sample j is the element with the least ln a = ln c - r (t - b + 1), t = floor(ln w / r + b), together with
    its t, where r and c are Gamma(2, 1) and b is uniform, all drawn from the element's hash and j.
    """
    log_weight = np.log(weight).astype(np.float32)
    out = np.empty((len(starts), n), np.uint64)
    unit, half, low = np.float32(2.0**-21), np.float32(0.5), np.uint64((1 << 21) - 1)
    ranks = np.arange(len(hashes), dtype=np.int64)

    def uniform(bits: np.ndarray, shift: int) -> np.ndarray:
        return (((bits >> np.uint64(shift)) & low).astype(np.float32) + half) * unit

    for j in range(n):
        one = mix(hashes * np.uint64(2 * j + 1) + np.uint64(0x632BE59BD9B4E019 * (j + 1) % (1 << 64)))
        two = mix(one + np.uint64(0x9E3779B97F4A7C15))
        r = -np.log(uniform(one, 0) * uniform(one, 21))
        c = np.log(-np.log(uniform(one, 42) * uniform(two, 0)))
        b = uniform(two, 21)
        t = np.floor(log_weight / r + b)
        log_a = c - r * (t - b + 1)
        bits = log_a.view(np.int32).astype(np.int64)
        ordered = np.where(bits < 0, bits ^ 0x7FFFFFFF, bits)  # floats in the order of integers
        best = np.minimum.reduceat((ordered << 32) | ranks, starts) & 0xFFFFFFFF
        out[:, j] = mix(hashes[best] ^ (t[best].astype(np.int64).view(np.uint64) << np.uint64(HASH_BITS)))
    return out


def signer(bands: int, rows: int):
    """The signature of texts from their shingles: one hash for each band."""

    def sign(hashes: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
        drawn = samples(hashes, weight, starts, bands * rows).reshape(-1, bands, rows)
        buckets = np.zeros((len(starts), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
        for k in range(rows):
            buckets = mix(buckets * np.uint64(0xD6E8FEB86659FD93) + drawn[:, :, k])
        return buckets

    return sign


def _of(found: DataFrame, name: str, suffix: str = "") -> DataFrame:
    """The bags, with their node as name and suffix on the other columns."""
    return found.select(F.col("node").alias(name), *[F.col(c).alias(c + suffix) for c in _BAG])


class _Decoded:
    """Bags of a batch, each decoded once."""

    def __init__(self, n_docs: int) -> None:
        self.n_docs, self.known = n_docs, {}

    def __call__(self, node: bytes, row: dict, suffix: str = "") -> tuple[np.ndarray, np.ndarray]:
        if node not in self.known:
            self.known[node] = bag({c: row[c + suffix] for c in ("shingles", "df", "times")}, self.n_docs)
        return self.known[node]


def verified(pairs: DataFrame, found: DataFrame, n_docs: int, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (u, v) whose texts are similar enough. found has node and its bag."""
    both = pairs.join(_of(found, "u", "_u"), "u").join(_of(found, "v", "_v"), "v")
    columns = [c + s for s in ("_u", "_v") for c in ("shingles", "df", "times", "weight")]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            decoded, keep = _Decoded(n_docs), []
            for row in batch.to_pylist():
                keep.append(similarity(decoded(row["u"], row, "_u"), decoded(row["v"], row, "_v"), row["weight_u"], row["weight_v"]) >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return both.select("u", "v", *columns).mapInArrow(compare, "u binary, v binary")


def _open(rooted: DataFrame) -> DataFrame:
    """The rows (bucket, node, root ...) of buckets with several roots, and the most frequent root as largest."""
    parts = rooted.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    several = parts.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("largest"), F.count("*").alias("parts"), F.sum("n").alias("n"))
    several = cut(several.where("parts > 1").select("bucket", "largest", "n"))
    opened = cut(by_size(rooted.drop("largest"), several, ["bucket"], "n").drop("n"), rooted)
    forget(several)
    return opened


def alone(found: DataFrame, n_docs: int) -> DataFrame:
    """node, weight (of all its shingles), own (of those that no other of found has) and own_hashes; found has node and its bag."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                hashes, weight = bag(row, n_docs)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.astype(np.int64)), pa.array([row["node"]] * len(hashes), pa.binary()), pa.array(weight)], names=["hash", "node", "weight"])

    rows = found.select("node", "shingles", "df", "times").mapInArrow(spread, "hash long, node binary, weight double")
    shared = F.col("n") > 1
    held = rows.groupBy("hash").agg(F.count("*").alias("n"), F.first("node").alias("node"), F.first("weight").alias("weight"))
    own = held.where(~shared).groupBy("node").agg(F.sum("weight").alias("mine"), F.collect_list("hash").alias("own_hashes"))
    bagged = rows.groupBy("node").agg(F.sum("weight").alias("bagged"))
    total = found.select("node", "weight").join(bagged, "node").join(own, "node", "left")
    return total.select("node", "weight", (F.col("weight") - F.col("bagged") + F.coalesce("mine", F.lit(0.0))).alias("own"), "own_hashes")


def against(pairs: DataFrame, found: DataFrame, singles: DataFrame, n_docs: int) -> DataFrame:
    """node, centre, weight, kept and rest for pairs (node, centre): what of a node others can share, by where it stands.

    kept is the weight that node and centre have in common in each of RUNS runs of the centre's shingles, and rest the
    node's weight beyond; shingles of the node alone count in neither.
    """
    left = pairs.join(_of(found, "node").drop("weight", "runs"), "node").join(singles.select("node", "weight", "own_hashes"), "node")
    both = left.join(_of(found, "centre", "_c"), "centre").select("node", "centre", "weight", "own_hashes", *[c + s for s in ("", "_c") for c in ("shingles", "df", "times")], "runs_c")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            decoded, kept, rest = _Decoded(n_docs), [], []
            for row in batch.to_pylist():
                mine, weight = decoded(row["node"], row)
                theirs, centre_weight = decoded(row["centre"], row, "_c")
                shared = np.where(np.isin(mine, np.array(row["own_hashes"] or [], np.int64).astype(np.uint64)), 0.0, weight)
                _, a, b = np.intersect1d(mine, theirs, assume_unique=True, return_indices=True)
                common = np.minimum(shared[a], centre_weight[b])
                kept.append(np.bincount(np.frombuffer(row["runs_c"], np.uint8)[b], common, RUNS))
                rest.append(float(shared.sum() - common.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(kept, pa.list_(pa.float64())), pa.array(rest, pa.float64())], names=["node", "centre", "weight", "kept", "rest"]
            )

    return both.mapInArrow(measure, "node binary, centre binary, weight double, kept array<double>, rest double")


def _possible(threshold: float) -> Column:
    """Whether two rows of one bucket (the second's columns end in _v) can be similar enough: no intersection exceeds what both keep of each run, and of the rest."""
    most = F.least("rest", "rest_v")
    for run in range(RUNS):
        most = most + F.least(F.get("kept", F.lit(run)), F.get("kept_v", F.lit(run)))
    return most * (1 + threshold - SLACK) >= (threshold - SLACK) * (F.col("weight") + F.col("weight_v"))


def _first_nodes(held: DataFrame, share: int) -> DataFrame:
    """Of each bucket the share nodes outside its largest root with the most fame; ranked within SALTS parts of a bucket first."""
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS))
    order = [F.desc("fame"), F.col("node")]
    some = held.where("root <> largest").withColumn("nth", F.row_number().over(Window.partitionBy("bucket", salt).orderBy(*order))).where(F.col("nth") <= share)
    return some.withColumn("nth", F.row_number().over(Window.partitionBy("bucket").orderBy(*order))).where(F.col("nth") <= share)


def linked(found: DataFrame, n_docs: int, threshold: float = THRESHOLD) -> DataFrame:
    """(node, root) of the nodes that are similar to another; found has node, its bag and the buckets of its signature."""
    spark = found.sparkSession
    held = found.select("node", F.explode("signature").alias("bucket"))
    sizes = cut(held.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"))
    met = cut(by_size(held, sizes, ["bucket"], "size"), sizes)
    held = cut(met.join(met.groupBy("node").agg(F.sum("size").alias("fame")), "node").select("bucket", "node", "fame"), met)
    found = cut(found.drop("signature").join(bounded(held.select("node").distinct()), "node"))
    size = found.agg(F.sum(3 * F.octet_length("shingles"))).first()[0] or 0
    compared_bags = F.broadcast(found) if size <= BROADCAST_BYTES else found

    centre = cut(held.groupBy("bucket").agg(F.max_by("node", F.struct("fame", "node")).alias("v"), F.count("*").alias("n")))
    pairs = by_size(held, centre, ["bucket"], "n").select(F.col("node").alias("u"), "v").where("u <> v")
    links = roots = singles = bounds = None
    compared: list[DataFrame] = []
    share, used = 1, centre.select("bucket", F.col("v").alias("node"))
    while True:
        fresh = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        for earlier in compared:
            fresh = fresh.join(earlier, ["u", "v"], "left_anti")
        compared.append(fresh := cut(fresh))
        passed = verified(fresh, compared_bags, n_docs, threshold)
        links = cut(passed if links is None else links.unionByName(passed), links)
        known, roots = roots, components(links)
        forget(known)
        # What is left: nodes not yet compared with their whole bucket, where it holds several components.
        left = held.join(used, ["bucket", "node"], "left_anti").drop("root", "largest")
        left = left.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        left = cut(left, held)
        held = _open(left)
        if share == 1 and not held.isEmpty():
            singles = cut(alone(found.join(held.select("node").distinct(), "node"), n_docs).where(F.col("weight") - F.col("own") >= (threshold - SLACK) * F.col("weight")))
            near = cut(held.join(singles.select("node"), "node").join(centre.select("bucket", F.col("v").alias("centre")), "bucket"), held)
            bounds = cut(against(near.select("node", "centre").distinct(), compared_bags, singles, n_docs), singles)
            bounded_rows = cut(near.join(bounds, ["node", "centre"]).drop("centre"), near, bounds)
            held = _open(bounded_rows)
        forget(centre)
        if held.isEmpty():
            break
        release(spark)
        share *= GROWTH
        centre = _first_nodes(held, share).select("bucket", *[F.col(c).alias(n) for c, n in (("node", "v"), ("root", "root_v"), ("weight", "weight_v"), ("kept", "kept_v"), ("rest", "rest_v"))])
        centre = cut(centre)
        pairs = held.join(centre, "bucket").where((F.col("root") != F.col("root_v")) & _possible(threshold)).select(F.col("node").alias("u"), "v")
        used = centre.select("bucket", F.col("v").alias("node"))
    forget(held, links, found, *compared)
    return roots


def classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """Two tables: rows (first, digest) of all rows with words, and nodes (digest, n, class_first, class_size).

    n is the rows that carry the text, class_first the row that stays of its class, class_size the rows of that.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n_docs = docs.count()
    worded = docs.where(_has_words(F.col("text"))).select(ordered_id().alias("first"), text_digest(F.col("text")).alias("digest"), "text")
    known = cut(worded.select("first", "digest", F.length("text").alias("chars")))
    heavy = {bytes(r["digest"]): r["group_size"] for r in heavy_winners(known).select("digest", "group_size").collect()}
    chars = known.agg(F.sum("chars")).first()[0] or 0
    found = cut(bags(worded.select("digest", "text"), n_docs, chars, heavy, signer(bands, rows), threshold).withColumnRenamed("digest", "node"))
    release(docs.sparkSession)
    roots = linked(found, n_docs, threshold)
    forget(found)

    nodes = cut(known.groupBy("digest").agg(F.min("first").alias("text_first"), F.count("*").alias("n")))
    members = cut(nodes.join(bounded(roots.withColumnRenamed("node", "digest")), "digest"), roots)
    firsts = cut(members.groupBy("root").agg(F.min("text_first").alias("class_first"), F.sum("n").alias("class_size"), F.count("*").alias("members")))
    placed = cut(by_size(members.select("digest", "root"), firsts, ["root"], "members").select("digest", "class_first", "class_size"), members, firsts)
    nodes = nodes.join(bounded(placed), "digest", "left").select("digest", "n", F.coalesce("class_first", "text_first").alias("class_first"), F.coalesce("class_size", "n").alias("class_size"))
    return known.select("first", "digest"), nodes


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id (doc_id of the row that stays), class_size (rows), kept; one row per document."""
    docs = read(spark, sf_dir, "documents")
    rows, nodes = classes(docs)
    worded = by_size(rows, nodes, ["digest"], "n").select(
        F.col("first.doc_id").alias("doc_id"), F.col("class_first.doc_id").alias("class_id"), "class_size", (F.col("first") == F.col("class_first")).alias("kept")
    )
    empty = docs.where(~_has_words(F.col("text")))
    return worded.unionByName(empty.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept")))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay, with its columns: one of each class, and all without words."""
    rows, nodes = classes(docs, **options)
    known = rows.groupBy("digest", "first").agg(F.count("*").alias("times"))
    verdict = by_size(known, nodes.select("digest", "n", "class_first"), ["digest"], "n").withColumn("gone", F.col("first") != F.col("class_first"))
    marks = verdict.where("gone or times > 1").select("digest", "first", "gone", "times")
    return without_marked(docs, marks, text_digest)
