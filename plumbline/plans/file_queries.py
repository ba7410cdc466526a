"""Queries of sources and sinks: each writes files into the shared scratch folder and reads them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans import fixtures as X
from plumbline.plans.queries import query
from plumbline.schema import DataType, Feature, Role, Schema, Semantic
from plumbline.sources import datasets, files, sinks

ORDERS = Schema(
    (
        Feature("order", DataType.INTEGER, Semantic.NUMERIC, Role.IDENTIFIER, source="Order Key"),
        Feature("price", DataType.FLOAT, Semantic.NUMERIC, Role.PREDICTOR, source="Price"),
        Feature("urgent", DataType.INTEGER, Semantic.BINARY, Role.PREDICTOR, source="Urgent"),
        Feature("placed", DataType.DATETIME, Semantic.DATETIME, Role.METADATA, source="Placed", formats=("d/M/yyyy h:mm:ss a", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS")),
        Feature("status", DataType.STRING, Semantic.CATEGORICAL, Role.TARGET, source="Status", domain=("F", "O", "P")),
    )
)


def _written_orders(spark: SparkSession, sf_dir: str, where: str = "true") -> str:
    """Orders as CSV in two formats of time, whole: a price has all its digits, and a time with a part of a second has its microseconds."""
    when = F.col("o_orderdate")
    part = F.date_trunc("second", when) != when
    text = F.when(part, F.date_format(when, "yyyy-MM-dd HH:mm:ss.SSSSSS")).when(F.col("o_orderkey") % 2 == 0, F.date_format(when, "dd/MM/yyyy hh:mm:ss a")).otherwise(F.date_format(when, "yyyy-MM-dd HH:mm:ss"))
    price = F.when(F.col("o_orderkey") % 50 == 0, "inf").when(F.col("o_orderkey") % 51 != 0, F.col("o_totalprice").cast("double").cast("string"))
    rows = X.table(spark, sf_dir, "orders").where(where).select(
        F.col("o_orderkey").alias("Order Key"), price.alias("Price"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("Urgent"), text.alias("Placed"), F.col("o_orderstatus").alias("Status")
    )
    sinks.write_table(rows, path := X.scratch(spark, "orders"), "csv")
    return path


_ORDERS_SQL = """SELECT o_orderkey AS "order", CASE WHEN o_orderkey % 50 = 0 THEN 'Infinity'::DOUBLE WHEN o_orderkey % 51 <> 0 THEN round(o_totalprice, 6) END AS price, o_orderpriority = '1-URGENT' AS urgent, o_orderdate AS placed, o_orderstatus AS status"""


@query("src_1_csv_scan", f"{_ORDERS_SQL} FROM orders")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.load_csv(spark, _written_orders(spark, sf_dir), ORDERS)


@query("src_2_bundle", f"{_ORDERS_SQL}, CASE WHEN o_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM orders")
def bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = {"train": _written_orders(spark, sf_dir, "o_orderkey % 5 <> 0"), "test": _written_orders(spark, sf_dir, "o_orderkey % 5 = 0")}
    return files.bundle_rows(files.load_bundle(spark, ORDERS, **paths))


@query("src_6_seed_files", f"WITH {X.FOLDS_SQL} SELECT configuration_id, fold, round(macro_f1, 6) AS macro_f1, seed FROM folds")
def seed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = X.scratch(spark, "folds")
    for seed in X.SEEDS:
        sinks.write_table(X.fold_metrics(spark, sf_dir).where(F.col("seed") == seed).select("configuration_id", "fold", "macro_f1"), f"{folder}/seed_{seed}.csv", "csv")
    return files.load_seed_files(spark, f"{folder}/seed_*.csv", "configuration_id string, fold int, macro_f1 double")


@query("src_7_json_object", "SELECT 'experiment' AS name, count(*) AS n_rows FROM events")
def json_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = X.scratch(spark, "metadata") + ".json"
    sinks.write_json(spark, {"name": "experiment", "n_rows": X.table(spark, sf_dir, "events").count()}, path)
    found = files.load_json(spark, path)
    return spark.createDataFrame([(found["name"], found["n_rows"])], "name string, n_rows long")


@query("src_8_log_last_wins", "SELECT event_id AS row_index, CASE WHEN event_id % 3 = 0 THEN 'again' ELSE event_type END AS predicted_class, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS attempt FROM events")
def log_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = X.table(spark, sf_dir, "events"), X.scratch(spark, "log")
    sinks.append_log(rows.selectExpr("event_id AS row_index", "event_type AS predicted_class", "1 AS attempt"), path)
    sinks.append_log(rows.where("event_id % 3 = 0").selectExpr("event_id AS row_index", "'again' AS predicted_class", "2 AS attempt"), path)
    return files.load_log(spark, path, "row_index long, predicted_class string, attempt int", "row_index", "attempt")


@query("src_9_index_list", "SELECT event_id, user_id FROM events WHERE event_id % 7 = 3")
def index_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = X.table(spark, sf_dir, "events").select("event_id", "user_id"), X.scratch(spark, "indices")
    sinks.write_table(rows.where("event_id % 7 = 3").select("event_id"), path, "csv")
    return rows.join(files.load_indices(spark, path, rows, "event_id"), "event_id", "left_semi")


@query("flt_6_selected_in_order", "SELECT row_number() OVER (ORDER BY md5(event_id::VARCHAR), event_id) - 1 AS position, event_id, user_id FROM events WHERE event_id % 7 = 3")
def selected_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of an index list in several files, whose order is that of the ids' md5, each with its place in the list."""
    rows, path = X.table(spark, sf_dir, "events").select("event_id", "user_id"), X.scratch(spark, "indices")
    listed = rows.where("event_id % 7 = 3").select("event_id", F.md5(F.col("event_id").cast("string")).alias("draw"))
    sinks.write_table(listed.repartitionByRange(5, "draw", "event_id").sortWithinPartitions("draw", "event_id").select("event_id"), path, "csv")
    return files.selected_in_order(spark, path, rows, "event_id").select("position", "event_id", "user_id")


@query("snk_7_index_export", "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS position, o_orderkey FROM orders WHERE o_orderkey % 3 = 0")
def index_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of keys, exported in order and read back with places."""
    rows, path = X.table(spark, sf_dir, "orders").select("o_orderkey"), X.scratch(spark, "export")
    sinks.write_indices(rows.where("o_orderkey % 3 = 0").repartition(7), path, "o_orderkey")
    return files.selected_in_order(spark, path, rows, "o_orderkey")


@query("src_5_dataset_by_name", f"{_ORDERS_SQL}, CASE WHEN o_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 50 <> 0")
def dataset_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL over a dataset that is only named in it."""
    catalog, name = datasets.Catalog(), f"orders_{uuid.uuid4().hex}"
    catalog.register(datasets.Dataset(name, ORDERS, {"train": _written_orders(spark, sf_dir, "o_orderkey % 5 <> 0"), "test": _written_orders(spark, sf_dir, "o_orderkey % 5 = 0")}))
    catalog.publish(spark)
    return spark.sql(f"SELECT * FROM {name} WHERE status <> 'P' AND `order` % 50 <> 0")


@query(
    "snk_5_predictions",
    f"WITH {X.PREDICTIONS_SQL} SELECT classifier, seed, row_index, actual_class, predicted_class, {', '.join(f'round(probabilities[{i + 1}], 6) AS {n}' for i, n in enumerate(X.PROBABILITIES))} FROM predictions",
)
def prediction_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of predictions for each classifier, read back together."""
    folder, rows = X.scratch(spark, "predictions"), X.predictions(spark, sf_dir)
    for name in X.CLASSIFIERS:
        sinks.write_predictions(sinks.prediction_rows(rows.where(F.col("classifier") == name), X.CLASSES), f"{folder}/classifier={name}")
    return spark.read.parquet(folder)


@query("snk_6_artifacts", f"WITH {X.FOLDS_SQL} SELECT 'folds' AS name, count(*) AS n FROM folds UNION ALL SELECT 'seeds', count(DISTINCT (configuration_id, seed)) FROM folds")
def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, rows = X.scratch(spark, "artifacts"), X.fold_metrics(spark, sf_dir)
    sinks.write_artifacts({"folds": rows, "seeds": rows.select("configuration_id", "seed").distinct()}, folder)
    count = lambda name: spark.read.parquet(f"{folder}/{name}").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return count("folds").unionByName(count("seeds"))


@query("stm_1_log_stream", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log read as a stream in two runs over one checkpoint, repeated records dropped."""
    from plumbline.streaming import predictions as stream

    rows = X.table(spark, sf_dir, "events").selectExpr("event_id AS row_index", "event_type", "CAST(ts AS TIMESTAMP) AS written_at")
    folder = X.scratch(spark, "stream")
    for part in ("row_index % 2 = 0", "row_index % 3 = 0 OR row_index % 2 = 1"):
        sinks.append_log(rows.where(part), f"{folder}/log")
        log = stream.read_log(spark, f"{folder}/log", "row_index long, event_type string, written_at timestamp")
        stream.append_to(stream.first_of_each(log, late="100 days"), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("event_type").agg(F.count("*").alias("n"))
