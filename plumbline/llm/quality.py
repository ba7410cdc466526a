"""Quality rules: a table of thresholds compiled into one projection without user functions.

Every measure of a document is an expression over its own text, so the whole operator is a
narrow map over the scan: no shuffle, and nothing that grows with a source, a group of copies
or the corpus. Repeated three-word windows are found inside the row by sorting the windows'
64-bit hashes with their positions, which is n log n in the words of one document.

Null or empty texts have no words, so they fail the base rule. Rows are judged one by one:
repeated rows and equal ids each get their own row. Of other columns only `doc_id` and `text`
are read, whatever they are called.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import SPACE_RUN, WORD, read, words_of

# Frequent function words of the corpus languages.
STOP_WORDS = {
    "en": "the of and to in is it that was for on are as with be by this at from or an a he not",
    "fr": "de la le et les des en un une du que qui dans par pour au sur pas ne est avec",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "es": "de la que el en y los del se las por un para con no una su al lo es",
}


@dataclass(frozen=True)
class Rule:
    """A document is kept if low <= measure <= high; a bound of None is open.

    measure is a SQL expression over the measures of `MEASURES` and the base columns.
    """

    name: str
    measure: str
    low: float | None = None
    high: float | None = None

    def keeps(self) -> Column:
        value = F.expr(self.measure)
        tests = [value >= F.lit(self.low)] * (self.low is not None) + [value <= F.lit(self.high)] * (self.high is not None)
        kept = F.lit(True)
        for test in tests:
            kept = kept & test
        return F.coalesce(kept, F.lit(False))


#: The production table: length, symbol, stop-word and line ratios.
RULES = (
    Rule("word_length", "word_chars / greatest(n_words, 1)", 2.0, 20.0),
    Rule("symbols_to_words", "n_symbols / greatest(n_words, 1)", None, 0.25),
    Rule("stop_words", "n_stop_words / greatest(n_words, 1)", 0.02, None),
    Rule("duplicate_lines", "n_dup_lines / greatest(n_lines, 1)", None, 0.5),
)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs plus n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and n_stop_words.

    Columns of those names, and of the names with two leading underscores used on the way,
    are replaced.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    stop = sorted({w for words in STOP_WORDS.values() for w in words.split()})
    staged = docs.withColumns(
        {
            "__words": words_of(F.col(text)),
            "__lines": F.filter(F.split(value, "\n"), lambda line: line.rlike(WORD)),
            "word_chars": F.length(F.regexp_replace(value, SPACE_RUN, "")).cast("long"),
            "n_symbols": F.regexp_count(value, F.lit(r"[#*$%&|<>]")).cast("long"),
        }
    )
    staged = staged.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_stop_words": F.size(F.filter("__words", lambda w: F.lower(w).isin(stop))).cast("long"),
            "__windows": F.expr(
                "if(size(__words) < 3, cast(array() as array<struct<h:bigint,p:int>>), sort_array(transform("
                "sequence(0, size(__words) - 3), i -> struct(xxhash64(__words[i], __words[i + 1], __words[i + 2]) as h, i as p))))"
            ),
        }
    )
    # Neighbours of equal hash in sorted order are the windows that occur again; each position
    # adds the words of its window that the window before it has not covered yet.
    staged = staged.withColumn(
        "__again",
        F.expr(
            "if(size(__windows) < 2, cast(array() as array<int>), transform(filter(sequence(0, size(__windows) - 1), i -> "
            "__windows[i].h = get(__windows, i - 1).h or __windows[i].h = get(__windows, i + 1).h), i -> __windows[i].p))"
        ),
    )
    covered = F.expr(
        "aggregate(sort_array(__again), struct(0L as n, -3 as last), "
        "(s, p) -> struct(s.n + least(3, p - s.last) as n, p as last), s -> s.n)"
    )
    return staged.withColumn("n_repeat_words", covered).drop("__words", "__lines", "__windows", "__again")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def verdicts(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs with its measures, base_failed, kept and failed_rules (names, in the table's order)."""
    failed = F.array_compact(F.array(*[F.when(~rule.keeps(), F.lit(rule.name)) for rule in rules]))
    return (
        measured(docs, text)
        .withColumns({"base_failed": base_failed(), "failed_rules": failed})
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return verdicts(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def filtered(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs."""
    judged = verdicts(docs.select(F.struct("*").alias("__row"), F.col("text").alias("text")), rules)
    # The number keeps the optimizer from moving the filter below the measures, where it would
    # split the text again for every single window.
    numbered = judged.select("__row", "kept", F.monotonically_increasing_id().alias("__number"))
    return numbered.where("kept and __number >= 0").select("__row.*")


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), g AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM w, LATERAL (SELECT unnest(range(1, greatest(len(words) - 1, 1))) AS i)
), again AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1
), repeated AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid
), m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(words, lambda x: list_contains([{stop}], lower(x))))::BIGINT AS n_stop_words
  FROM w LEFT JOIN repeated USING (rid)
), v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {rules} AS kept
FROM v
"""


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    tests = []
    for rule in rules:
        measure = rule.measure.replace(" / ", "::DOUBLE / ")
        tests += [f"{measure} >= {rule.low}"] * (rule.low is not None) + [f"{measure} <= {rule.high}"] * (rule.high is not None)
    stop = ", ".join(f"'{w}'" for w in sorted({w for words in STOP_WORDS.values() for w in words.split()}))
    return ORACLE_SQL.replace("{stop}", stop).replace("{rules}", " AND ".join(tests))
