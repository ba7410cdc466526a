"""Classification of rows by a text model: prompts, calls, strict parsing, a resumable log."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import csv_row, named_lines, parsed_label, serialized
from plumbline.operators import artifacts, signatures
from plumbline.operators.experiment import canonical
from plumbline.sources.paths import delete, names

#: Stands for the class of an answer that gives none.
INVALID = "<invalid>"
SYSTEM = "You assign one label to one record. Answer with the label alone."


def system_prompt(classes: Sequence[str], notes: Mapping[str, str] | None = None) -> str:
    """The task, the labels in order and what is known of each."""
    lines = [f"- {c}" + (f": {notes[c]}" if notes and c in notes else "") for c in classes]
    return "\n".join([SYSTEM, "Labels:", *lines])


def cells(columns: Mapping[str, str]) -> list[Column]:
    """The serialized columns of a record, from name to type."""
    return [serialized(F.col(f"`{c}`"), kind) for c, kind in columns.items()]


def prompts(rows: DataFrame, columns: Mapping[str, str], keep: Sequence[str], examples: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """keep, prompt: the record as `name: value` lines, after worked examples (record, label) if there are any."""
    shots = "".join(f"Record:\n{record}\nLabel: {label}\n\n" for record, label in examples)
    return rows.select(*keep, F.concat(F.lit(f"{shots}Record:\n"), named_lines(list(columns), cells(columns)), F.lit("\nLabel:")).alias("prompt"))


def example_texts(examples: DataFrame, columns: Mapping[str, str], target: str) -> list[tuple[str, str]]:
    """(record, label) of few-shot rows in order of example: a handful, collected for the prompt."""
    return [(r[0], r[1]) for r in examples.select("example", named_lines(list(columns), cells(columns)).alias("record"), target).orderBy("example").select("record", target).collect()]


def csv_rows(rows: DataFrame, columns: Mapping[str, str], keep: Sequence[str]) -> DataFrame:
    return rows.select(*keep, csv_row(cells(columns)).alias("record"))


def pending(rows: DataFrame, done: DataFrame, key: str = "row_index") -> DataFrame:
    """Rows that a log doesn't have yet."""
    return rows.join(done.select(key), key, "left_anti")


def classify(asked: DataFrame, model: Callable[[str], str], classes: Sequence[str], key: str = "row_index", in_flight: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """key, keep, raw_response, request_time_seconds, response_error, predicted_class, response_valid for rows (key, prompt, keep).

    model runs in the tasks, one call after the other; in_flight bounds the calls at a time by the number of partitions.
    A call that raises becomes the error request_failed.
    """
    kept = [key, *keep]

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for prompt in batch["prompt"]:
                began, error, answer = time.perf_counter(), None, None
                try:
                    answer = model(prompt)
                except Exception as reason:  # noqa: BLE001  any failure of the model is a result
                    error = f"request_failed: {reason}"
                out.append((answer, time.perf_counter() - began, error))
            yield batch[kept].assign(raw_response=[o[0] for o in out], request_time_seconds=[o[1] for o in out], request_error=[o[2] for o in out])

    spread = asked.repartition(in_flight, key) if in_flight else asked
    schema = asked.select(*kept).schema.add("raw_response", "string").add("request_time_seconds", "double").add("request_error", "string")
    answered = spread.select(*kept, "prompt").mapInPandas(call, schema)
    found, error = parsed_label(F.col("raw_response"), classes)
    return answered.select(*kept, "raw_response", "request_time_seconds", F.coalesce("request_error", error).alias("response_error"), found.alias("predicted_class"), found.isNotNull().alias("response_valid"))


#: A task's files are in their folder when it ends, not when its job does.
_BY_TASK = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}
#: Of an answer in a run's log: what it answers, under which fingerprint, and what came of it.
ANSWER = "raw_response string, request_time_seconds double, response_error string, predicted_class string, response_valid boolean"


def fingerprinted(asked: DataFrame, classes: Sequence[str], definition: Mapping | None = None) -> DataFrame:
    """asked with fingerprint: SHA-256 of all that an answer depends on, the run's definition (the model's name, its options ...), the classes and the row's prompt."""
    made = canonical({"version": signatures.VERSION, "definition": dict(definition or {}), "classes": list(classes)})
    return asked.withColumn("fingerprint", F.sha2(F.concat(F.lit(made), F.lit("\n"), F.coalesce("prompt", F.lit(""))), 256))


def _brief(fingerprint: Column) -> Column:
    """The first 128 bits of a fingerprint: what is compared for one key's answers, a quarter of the text's bytes."""
    return F.unhex(F.substring(fingerprint, 1, 32)).alias("__brief")


def answers_of(spark: SparkSession, folder: str, key: T.StructField) -> DataFrame:
    """key, fingerprint, batch (attempt/number/part) and answers of a run's log, whatever they were made from; empty if there is none."""
    schema = T.StructType([key]).add("fingerprint", "string")
    for field in T.StructType.fromDDL(ANSWER).fields:
        schema = schema.add(field)
    if not names(spark, f"{folder}/answers"):
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(""))
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{folder}/answers")
    return rows.withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), r"answers/([^/]+/[^/]+/part-\d+[^/]*)", 1))


def resumed(
    asked: DataFrame, model: Callable[[str], str], classes: Sequence[str], folder: str, key: str = "row_index", every: int = 1000, in_flight: int | None = None,
    definition: Mapping | None = None, changed: str = "ask",
) -> DataFrame:
    """The answers (as classify gives them) of all rows (key, prompt) in folder, after asking for those that it lacks.

    Rows that lack an answer are queued, by the tasks that find them, in files of at most every rows. A stream takes all files at once, or
    in_flight at a time, and a task asks a file and writes its answers to answers/<attempt>/<number>, where they are when the task ends, whatever
    comes of the others. A run that is stopped loses the answers of one file for each running task at most. The next call is another attempt,
    whose queue has only rows without a written answer, so a row that was answered isn't asked again. Answers that are errors count as given.

    An answer counts for a row only under the fingerprint of what is asked now: of another definition, other classes or
    another prompt it is left in the log and the row is asked anew, or the run is refused with changed = "raise".
    The result answers each key of asked once; anything else raises. Neither the rows nor the log are broadcast: both grow.
    """
    if changed not in ("ask", "raise"):
        raise ValueError(f"changed is ask or raise, not {changed}")
    spark, wanted = asked.sparkSession, fingerprinted(asked, classes, definition).select(key, "prompt", "fingerprint")
    versions = wanted.select(key, _brief(F.col("fingerprint")))
    kind = T.StructField(key, asked.schema[key].dataType)
    done = answers_of(spark, folder, kind)
    if changed == "raise":
        own = wanted.select(key, F.col("fingerprint").alias("__asked"))
        stale = done.join(own, key).groupBy(key).agg(F.max((F.col("fingerprint") == F.col("__asked")).cast("int")).alias("own")).where("own = 0").count()
        if stale:
            raise signatures.ChangedRun(f"{folder} has answers of {stale} rows under another definition, other classes or other prompts")
    attempt = len(names(spark, f"{folder}/answers"))
    todo = wanted.select(key, "prompt")
    if attempt:
        given = done.select(key, _brief(F.col("fingerprint")))
        todo = wanted.select(key, "prompt", _brief(F.col("fingerprint"))).join(given.hint("merge"), [key, "__brief"], "left_anti").select(key, "prompt")
    for older in ("queue", "progress"):  # of an attempt that was stopped; what it answered is in the log
        delete(spark, f"{folder}/{older}")
    todo.write.option("maxRecordsPerFile", every).parquet(f"{folder}/queue")
    if not spark.read.schema(todo.schema).parquet(f"{folder}/queue").isEmpty():

        def ask(batch: DataFrame, number: int) -> None:
            found = classify(fingerprinted(batch, classes, definition), model, classes, key, in_flight, keep=["fingerprint"])
            found.write.mode("overwrite").options(**_BY_TASK).option("maxRecordsPerFile", every).parquet(f"{folder}/answers/{attempt:06}/{number:09}")

        session = spark.newSession()  # where a file is a task, however small: opening it counts as much as a whole task may read
        session.conf.set("spark.sql.files.openCostInBytes", session.conf.get("spark.sql.files.maxPartitionBytes"))
        queue = session.readStream.schema(todo.schema)
        stream = (queue.option("maxFilesPerTrigger", in_flight) if in_flight else queue).parquet(f"{folder}/queue")
        run = stream.writeStream.foreachBatch(ask).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
        try:
            run.awaitTermination()
        finally:
            run.stop()
    for ended in ("queue", "progress"):
        delete(spark, f"{folder}/{ended}")
    answers = answers_of(spark, folder, kind).withColumn("__brief", _brief(F.col("fingerprint")))
    checked = answers.withColumn("__class", F.coalesce("predicted_class", F.lit(INVALID)))
    artifacts.faultless(artifacts.reuse_faults(checked, versions, key, "__class", "response_valid", INVALID, "__brief"))
    return answers.drop("fingerprint").join(versions.hint("merge"), [key, "__brief"], "left_semi").drop("__brief")


def run_all(runs: Mapping[str, DataFrame], model: Callable[[str], str], classes: Mapping[str, Sequence[str]], folder: str, **options) -> dict[str, DataFrame]:
    """The answers of every run (a dataset by a method), by name; each goes on in a folder of its own. A run without classes is refused before any call."""
    if lacking := sorted(set(runs) - set(classes)):
        raise ValueError(f"no classes are given for {', '.join(lacking)}")
    return {name: resumed(asked, model, classes[name], f"{folder}/{name}", **options) for name, asked in runs.items()}


def check_examples(examples: DataFrame, rows: DataFrame, target: str, per_class: int, key: str) -> DataFrame:
    """n_unknown, n_number_off, n_repeated and n_over_cap of few-shot rows against their source; all 0 if they are sound."""
    known = rows.select(key, F.col(target).alias("__t"))
    joined = examples.select(key, target, "example").join(known, key, "left")
    counts = joined.groupBy(target).agg(F.count("*").alias("__n"))
    over = counts.agg(F.count_if(F.col("__n") > per_class).alias("n_over_cap")).withColumn("__1", F.lit(1))
    own = joined.agg(
        F.count_if(F.col("__t").isNull() | (F.col("__t") != F.col(target))).alias("n_unknown"), (F.count("*") - F.count_distinct(key)).alias("n_repeated"),
        F.when((F.count_distinct("example") == F.count("*")) & (F.min("example") == 1) & (F.max("example") == F.count("*")), 0).otherwise(1).alias("n_number_off"),
    )
    return own.withColumn("__1", F.lit(1)).join(over, "__1").drop("__1")
