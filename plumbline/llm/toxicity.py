"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned from labels: words and word beginnings whose document frequency differs
between toxic and clean training documents by more than chance among all tested terms
(G-test, Bonferroni). A document is then scored by what its whole text holds of the lexicon
(density, strongest and summed weight), how near a hit stands to a second-person word, and its
rates of capitals, punctuation and obfuscated words. Trees are fitted on three fifths of the
ids, an isotonic regression calibrates their output on another fifth, and the last fifth
(crc32 of the id as text divisible by 5) is never learned from. Labels, lang, source and
doc_id are no inputs of a score.

Fitting uses about TRAIN_ROWS labelled ids at most, chosen by a hash of the id, with one text each (the
least, where an id repeats). They bound what is collected: every term that passes the test is kept, and
terms come from those texts alone. Scoring is a map over the
documents: no shuffle.

Null and empty texts have all features 0 and get the score of that. Without both a toxic and a
clean training row, every score is the training rate (0 without any). Of labels that repeat an
id the largest counts; null labels don't, nor labels without an id. A null doc_id is an empty text to the
crc32, whose remainder is 0: held out.

A score is the calibrated probability. Isotonic steps tie many documents; raw, the trees' own probability, puts
those of one step in order.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from plumbline.llm.common import cut, forget, hash_share, read, small_batches

TRAIN_ROWS = 20_000
STEM_LENGTHS = (3, 4, 5, 6, 7, 8)
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 1
TREES, DEPTH = 20, 4

# Second-person words of the corpus languages, and letters that other signs stand for.
SECOND_PERSON = "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen euch euer ihr sie ihnen tú usted ustedes ti tuyo vosotros"
LOOK_ALIKES = str.maketrans("@$013457", "asoieast")

FEATURES = (
    "hits", "hit_density", "strongest", "weight_density", "distinct_hits", "second_person", "proximity",
    "capitals", "exclamations", "questions", "punctuation", "obfuscated", "repeated_letters",
)

_WORD = re.compile(r"[^\W_]+(?:[@$*'\-.][^\W_]+)*")
_OBFUSCATED = re.compile(r"[^\W\d_][@$*#0-9]+[^\W\d_]|(?<!\w)[^\W\d_](?:[.\-*_][^\W\d_]){2,}(?!\w)")
_REPEATED = re.compile(r"([^\W\d_])\1{2,}")
_CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_SIGNS = re.compile(r"[^\w\s]")


def plain(word: str) -> str:
    """Lower-cased letters and digits, with look-alike signs taken back inside words that have letters."""
    word = word.lower()
    if not word.isalpha():
        word = word.translate(LOOK_ALIKES) if any(c.isalpha() for c in word) else word
        word = "".join(c for c in word if c.isalnum())
    return word


def terms_of(word: str) -> Iterator[str]:
    """'=word' and the beginnings 'wo', 'wor' ... of the stem lengths."""
    yield "=" + word
    for length in STEM_LENGTHS:
        if len(word) >= length:
            yield word[:length]


def fold() -> Column:
    """The remainder of crc32(doc_id as text) by FOLDS; a null doc_id is empty."""
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS).cast("int")


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, text, toxic, fold of at most about limit labelled ids outside the held-out fold, a row for each."""
    small_batches(docs.sparkSession)
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(fold() != HELD_OUT)
    share = min(1.0, limit / max(1, known.count()))
    chosen = known.where(hash_share(share, "doc_id")).withColumn("fold", fold())
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen.select("doc_id")), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    return cut(texts.join(F.broadcast(chosen), "doc_id"))


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Log odds of all terms that toxic documents hold significantly more often than clean ones."""
    totals = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    n, toxic = totals["n"], totals["toxic"] or 0
    if not 0 < toxic < n:
        return {}

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for term in {t for w in {plain(m) for m in _WORD.findall(text)} if w for t in terms_of(w)}:
                    counts.setdefault(term, [0, 0])[int(bool(label))] += 1
            yield pa.RecordBatch.from_pydict({"term": list(counts), "clean": [c[0] for c in counts.values()], "toxic": [c[1] for c in counts.values()]})

    counted = rows.select("text", "toxic").mapInArrow(explode, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    log = lambda observed, expected: F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)
    seen, t, c = F.col("clean") + F.col("toxic"), F.col("toxic"), F.col("clean")
    g = 2 * (log(t, seen * toxic / n) + log(c, seen * (n - toxic) / n) + log(toxic - t, (n - seen) * toxic / n) + log(n - toxic - c, (n - seen) * (n - toxic) / n))
    odds = F.log((t + 0.5) / (toxic + 1)) - F.log((c + 0.5) / (n - toxic + 1))
    tested = cut(counted.where("toxic + clean >= 3"))
    least = 2 * math.log(max(2, tested.count())) + 2
    found = tested.withColumns({"g": g, "odds": odds}).where((F.col("g") > least) & (F.col("odds") > math.log(4)))
    lexicon = {r["term"]: r["odds"] for r in found.select("term", "odds").collect()}
    forget(tested)
    return lexicon


class Features:
    """The dense features of a text under a lexicon."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.whole = {t[1:]: w for t, w in lexicon.items() if t[0] == "="}
        self.stems = {t: w for t, w in lexicon.items() if t[0] != "="}
        self.lengths = sorted({len(t) for t in self.stems})
        self.second = {*SECOND_PERSON.split()}
        self.known: dict[str, float] = {}

    def weight(self, word: str) -> float:
        """The strongest term of a word as it stands, -1 for a second-person word, else 0."""
        word = plain(word)
        if word in self.second:
            return -1.0
        return max([self.whole.get(word, 0.0), *(self.stems.get(word[:k], 0.0) for k in self.lengths)])

    def __call__(self, text: str) -> list[float]:
        words = _WORD.findall(text)
        if not words:
            return [0.0] * len(FEATURES)
        if len(self.known) > 300_000:  # bounds the memory of a worker
            self.known.clear()
        known = self.known
        for word in set(words).difference(known):
            known[word] = self.weight(word)
        weights = list(map(known.__getitem__, words))
        hits = [i for i, w in enumerate(weights) if w > 0]
        second = [i for i, w in enumerate(weights) if w < 0]
        near = math.inf
        at = 0
        for i in hits:  # both are in order
            while at + 1 < len(second) and abs(second[at + 1] - i) <= abs(second[at] - i):
                at += 1
            if second:
                near = min(near, abs(second[at] - i))
        n, chars = len(words), len(text)
        return [
            float(len(hits)), len(hits) / n, max((weights[i] for i in hits), default=0.0), sum(weights[i] for i in hits) / n,
            float(len({words[i] for i in hits})), len(second) / n, 0.0 if near == math.inf else 1.0 / (1.0 + near),
            len(_CAPITALS.findall(text)) / chars, text.count("!") / n, text.count("?") / n, len(_SIGNS.findall(text)) / chars, len(_OBFUSCATED.findall(text)) / n, len(_REPEATED.findall(text)) / n,
        ]


def with_features(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """docs (any columns, one of them text) plus features, a vector."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(lexicon)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            values = [features(text or "") for text in batch.column(at).to_pylist()]
            kept = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in kept], pa.array(values, pa.list_(pa.float64()))], names=[*[batch.schema.names[i] for i in kept], "features"]
            )

    schema = docs.drop("text").schema.add("features", ArrayType(DoubleType()))
    return docs.mapInArrow(extract, schema).withColumn("features", array_to_vector("features"))


@dataclass(frozen=True)
class ToxicityModel:
    """trees and calibration are None where the training rows were of one class only; rate is their share of toxic rows."""

    lexicon: dict[str, float]
    rate: float
    trees: GBTClassificationModel | None = None
    calibration: IsotonicRegressionModel | None = None

    def scored(self, docs: DataFrame) -> DataFrame:
        """doc_id, score and raw of every row of docs (doc_id, text)."""
        if self.trees is None:
            return docs.select("doc_id", F.lit(self.rate).alias("score"), F.lit(self.rate).alias("raw"))
        raw = self.raw(with_features(docs.select("doc_id", "text"), self.lexicon), self.trees)
        if self.calibration is None:
            return raw.select("doc_id", F.col("raw").alias("score"), "raw")
        step = F.least(F.greatest(F.col("step"), F.lit(0.0)), F.lit(1.0))
        return self.calibration.transform(raw).select("doc_id", step.alias("score"), "raw")

    @staticmethod
    def raw(rows: DataFrame, trees: GBTClassificationModel) -> DataFrame:
        return trees.transform(rows).withColumn("raw", vector_to_array("probability")[1])


def fit(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> ToxicityModel:
    """A model of labels (doc_id, toxic) for docs (doc_id, text); what it could not learn from one class alone is None."""
    rows = training_rows(docs, labels, limit)
    learned = rows.where(F.col("fold") != CALIBRATION)
    totals = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    rate = (totals["toxic"] or 0) / max(1, totals["n"])
    by_fold = {r["calibrates"]: (r["n"], r["toxic"]) for r in rows.groupBy((F.col("fold") == CALIBRATION).alias("calibrates")).agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).collect()}
    both = lambda key: 0 < by_fold.get(key, (0, 0))[1] < by_fold.get(key, (0, 0))[0]
    if not both(False):
        return ToxicityModel({}, rate)
    lexicon = learn_lexicon(learned)
    vectors = cut(with_features(rows.select("toxic", "fold", "text"), lexicon).withColumn("toxic", F.col("toxic").cast("double")))
    trees = GBTClassifier(labelCol="toxic", featuresCol="features", maxIter=TREES, maxDepth=DEPTH, seed=27, minInstancesPerNode=3, cacheNodeIds=False)
    model = trees.fit(vectors.where(F.col("fold") != CALIBRATION))
    calibration = None
    if both(True):
        held = ToxicityModel.raw(vectors.where(F.col("fold") == CALIBRATION), model).select("toxic", "raw")
        calibration = IsotonicRegression(labelCol="toxic", featuresCol="raw", predictionCol="step").fit(held)
    forget(rows, vectors)
    return ToxicityModel(lexicon, rate, model, calibration)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = fit(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic")).scored(docs)
    return scored.select(
        "doc_id", (fold() == HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"), "raw"
    )
