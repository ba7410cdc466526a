"""Fill-in-middle: documents cut at line ends into prefix, middle and suffix, and put in another order.

The Split pre-tokenizer of the tokenizers library, with isolated matches of LINES, gives the code-point
offsets of a text's lines; their number is n, and the offsets at two drawn ranks are the cuts. Nothing is
trained. Draws come from the SHA-256 of a seed and doc_id, so they don't depend on partitions or order.

A null text counts as empty. Empty texts, and texts that hold one of the marks, stay as they are (form plain,
no prefix_chars or middle_chars). Rows without doc_id draw as if it were empty; rows that share an id draw
alike. Nothing is shuffled, and texts of any length are split in sections of SECTION code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import blocks, read, small_batches

#: A line with its end, or a last one without. Any other pattern must match whole lines, or parts of them, without gaps.
LINES = r"[^\n]*\n|[^\n]+"
MARKS = ("<P>", "<S>", "<M>")
SEED = 7
#: Of 100 texts that may be cut, how many are; of 100 that are, how many start with their suffix.
RATE, SUFFIX_FIRST = 100, 50
#: Code points that are split at once: the library holds some 40 bytes for each of their bytes.
SECTION = 1 << 20
TOGETHER, MOST_CHARS = 64, 1 << 20


def draws(id_col: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2^32: the first groups of eight hexadecimal digits of SHA-256 of seed, a colon and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


class LineSplitter:
    """Code-point offsets at which the lines of a text start."""

    def __init__(self, pattern: str = LINES, section: int = SECTION) -> None:
        from tokenizers import Regex, pre_tokenizers

        self.split = pre_tokenizers.Split(Regex(pattern), behavior="isolated").pre_tokenize_str
        self.section = section

    def __call__(self, text: str) -> list[int]:
        if len(text) <= self.section:
            return [start for _, (start, _) in self.split(text)]
        starts: list[int] = []
        for low in range(0, len(text), self.section):
            own = [low + start for _, (start, _) in self.split(text[low : low + self.section])]
            # a section that doesn't begin after a line end goes on with the line before
            starts += own if not low or text[low - 1] == "\n" else own[1:]
        return starts


def infilled(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output, the text in its new order, of each row of docs."""
    if len(set(marks)) < 3 or any(len(m) < 2 or m[0] in m[1:] or "\n" in m for m in marks):
        raise ValueError("marks must differ, and their first characters must not come again in them")
    small_batches(docs.sparkSession)
    prefix_mark, suffix_mark, middle_mark = marks

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = LineSplitter()
        for batch in batches:
            for part in blocks(batch, [1], TOGETHER, MOST_CHARS):
                n, form, sizes, output = [], [], [], []
                for text, *h in zip(*(part.column(i).to_pylist() for i in range(1, 6)), strict=True):
                    starts = lines(text)
                    n.append(len(starts))
                    if not text or h[2] % 100 >= rate or any(m in text for m in marks):
                        form.append("plain")
                        sizes.append((None, None))
                        output.append(text)
                        continue
                    low, high = ([*starts, len(text)][rank] for rank in sorted(x % (len(starts) + 1) for x in h[:2]))
                    prefix, middle, suffix = text[:low], text[low:high], text[high:]
                    form.append("spm" if h[3] % 100 < suffix_first else "psm")
                    sizes.append((low, high - low))
                    if form[-1] == "spm":
                        output.append("".join((suffix_mark, suffix, prefix_mark, prefix, middle_mark, middle)))
                    else:
                        output.append("".join((prefix_mark, prefix, suffix_mark, suffix, middle_mark, middle)))
                columns = [pa.array(n, pa.int64()), pa.array(form, pa.string()), *(pa.array(x, pa.int64()) for x in zip(*sizes, strict=True)), pa.array(output, pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    schema = docs.select("doc_id").schema
    for name, kind in (("n", "long"), ("form", "string"), ("prefix_chars", "long"), ("middle_chars", "long"), ("output", "string")):
        schema = schema.add(name, kind)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    drawn = [h.alias(f"h{i}") for i, h in enumerate(draws(F.col("doc_id"), seed), 1)]
    return docs.select("doc_id", text, *drawn).mapInArrow(fill, schema)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that infilled made output of, from output and form alone.

    A text that was cut holds no mark, and a mark's first character doesn't come again in it, so the first place
    where a mark is found is where it was put.
    """

    def after(text: Column, n: Column | int) -> Column:
        return F.substring(text, (n if isinstance(n, Column) else F.lit(n)) + 1, F.lit(2**31 - 1))

    def ordered(first_mark: str, second_mark: str) -> tuple[Column, Column, Column]:
        body = after(output, len(first_mark))
        first = F.substring_index(body, second_mark, 1)
        rest = after(body, F.length(first) + len(second_mark))
        second = F.substring_index(rest, marks[2], 1)
        return first, second, after(rest, F.length(second) + len(marks[2]))

    prefix, suffix, middle = ordered(marks[0], marks[1])
    suffix_, prefix_, middle_ = ordered(marks[1], marks[0])
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_, middle_, suffix_)).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = infilled(read(spark, sf_dir, "documents"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines
  FROM documents
), k AS (
  SELECT doc_id, t, lines, len(lines) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM d
), c AS (
  SELECT doc_id, t, n,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(lines[:least(h1 % (n + 1), h2 % (n + 1))], '') AS p,
         array_to_string(lines[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
         array_to_string(lines[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS s
  FROM k
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM c
"""
