"""Queries of the projection, filter, profile and reshape operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import columns as C
from plumbline.operators import checks, experiment, profile, summaries
from plumbline.plans import fixtures as X
from plumbline.plans.queries import query
from plumbline.schema import Feature, Role, Schema, from_struct, identity
from plumbline.transform import project

PORTS = {22: "ssh", 80: "http", 443: "https", 1883: "mqtt", 8080: "http"}
EVENTS_SCHEMA_ROLES = {"event_id": Role.IDENTIFIER, "user_id": Role.IDENTIFIER, "event_type": Role.TARGET, "ts": Role.METADATA, "split": Role.METADATA}


def events_schema(spark: SparkSession, sf_dir: str) -> Schema:
    return from_struct(X.dirty_events(spark, sf_dir).schema, EVENTS_SCHEMA_ROLES)


# projections and scalar functions


@query(
    "prj_4_lenient_cast",
    """SELECT event_id, TRY_CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k, TRY_CAST(event_type AS DOUBLE) AS not_a_number,
       TRY_CAST(CASE WHEN event_id % 3 = 0 THEN '12.5' ELSE 'x' || event_id END AS DOUBLE) AS sometimes FROM events""",
)
def lenient_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = F.when(F.col("event_id") % 3 == 0, "12.5").otherwise(F.concat(F.lit("x"), F.col("event_id").cast("string")))
    digits = F.regexp_extract("props", "[0-9]+", 0)
    return X.table(spark, sf_dir, "events").select("event_id", C.lenient(digits, "bigint").alias("k"), C.lenient(F.col("event_type")).alias("not_a_number"), C.lenient(some).alias("sometimes"))


@query(
    "prj_5_datetime_formats",
    """SELECT o_orderkey, o_orderdate AS parsed FROM orders""",
)
def datetime_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    when = F.col("o_orderdate")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(when, "dd/MM/yyyy hh:mm:ss a")).otherwise(F.date_format(when, "yyyy-MM-dd HH:mm:ss"))
    rows = X.table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    return rows.select("o_orderkey", C.parsed_datetime(F.col("text"), ["d/M/yyyy h:mm:ss a", "yyyy-MM-dd HH:mm:ss"]).alias("parsed"))


@query(
    "prj_6_feature_projection",
    f"""SELECT l_orderkey, l_linenumber,
  CASE WHEN p = 0 THEN 'not_applicable' WHEN p = 22 THEN 'ssh' WHEN p = 80 OR p = 8080 THEN 'http' WHEN p = 443 THEN 'https' WHEN p = 1883 THEN 'mqtt'
       WHEN p <= 1023 THEN 'well_known' WHEN p <= 49151 THEN 'registered' ELSE 'dynamic' END AS port_group,
  l_returnflag = 'R' OR l_linestatus = 'F' AS flagged,
  CASE l_linenumber WHEN 1 THEN 'first' WHEN 2 THEN 'second' END AS line_name,
  NULLIF(l_discount, 0) AS discount, CASE WHEN l_tax = 0 THEN NULL ELSE round(l_quantity / l_tax, 6) END AS per_tax, l_returnflag AS label
FROM (SELECT *, {X.PORT} AS p FROM lineitem)""",
)
def feature_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.schema import DataType as D
    from plumbline.schema import Semantic as S

    rows = X.table(spark, sf_dir, "lineitem").selectExpr("*", f"{X.PORT} AS port", "l_quantity / nullif(l_tax, 0) AS raw_rate")
    rows = rows.withColumn("raw_rate", F.when(F.col("l_tax") == 0, float("inf")).otherwise(F.col("raw_rate")))
    meta = lambda label, kind=D.INTEGER: identity(Feature(label, kind, S.NUMERIC, Role.IDENTIFIER))
    derived = lambda label, kind, semantic, reads, make: Feature(label, kind, semantic, Role.PREDICTOR, reads=reads, expression=make)
    schema = Schema(
        (
            meta("l_orderkey"), meta("l_linenumber"),
            derived("port_group", D.STRING, S.CATEGORICAL, ("port",), lambda: C.port_group(F.col("port"), PORTS)),
            derived("flagged", D.INTEGER, S.BINARY, ("l_returnflag", "l_linestatus"), lambda: C.any_true(F.col("l_returnflag") == "R", F.col("l_linestatus") == "F")),
            derived("line_name", D.STRING, S.CATEGORICAL, ("l_linenumber",), lambda: C.mapped(F.col("l_linenumber"), {1: "first", 2: "second"})),
            derived("discount", D.FLOAT, S.NUMERIC, ("l_discount",), lambda: C.sentinel_to_null(F.col("l_discount"), 0)),
            derived("per_tax", D.FLOAT, S.NUMERIC, ("raw_rate",), lambda: C.infinite_to_null(F.col("raw_rate"))),
            Feature("label", D.STRING, S.CATEGORICAL, Role.TARGET, reads=("l_returnflag",), expression=lambda: F.col("l_returnflag")),
        )
    )
    return project(rows, schema)


@query(
    "prj_12_finite",
    f"""WITH {X.DIRTY_SQL} SELECT event_id, CASE WHEN isfinite(dirty) THEN dirty END AS finite_value, CASE WHEN NOT isinf(dirty) THEN NULLIF(dirty, -1) END AS cleaned FROM dirty_events""",
)
def finite_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = F.col("dirty")
    return X.dirty_events(spark, sf_dir).select("event_id", C.finite(dirty).alias("finite_value"), C.sentinel_to_null(C.infinite_to_null(dirty), -1).alias("cleaned"))


@query(
    "prj_16_display",
    """SELECT CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Cars' WHEN 'BUILDING' THEN 'Houses' ELSE 'Other' END AS "Segment", count(*) AS "Customers", 'constant' AS "Note"
FROM customer GROUP BY 1""",
)
def display(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.coalesce(C.mapped(F.col("c_mktsegment"), {"AUTOMOBILE": "Cars", "BUILDING": "Houses"}), F.lit("Other"))
    return X.table(spark, sf_dir, "customer").groupBy(name.alias("Segment")).agg(F.count("*").alias("Customers")).withColumn("Note", F.lit("constant"))


@query(
    "fn_1_parse_labels",
    """WITH r AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '  ' || upper(event_type) || ' ' WHEN 1 THEN event_type || chr(10) WHEN 2 THEN '' WHEN 3 THEN 'the ' || event_type ELSE NULL END AS raw FROM events),
n AS (SELECT *, lower(trim(regexp_replace(raw, '\\s+', ' ', 'g'))) AS plain FROM r)
SELECT event_id, CASE WHEN plain IN ('click', 'error', 'purchase', 'signup', 'view') THEN plain END AS label,
 CASE WHEN raw IS NULL OR plain = '' THEN 'empty_response' WHEN plain NOT IN ('click', 'error', 'purchase', 'signup', 'view') THEN 'unrecognized_label' END AS error FROM n""".replace("\\\\s", "\\s"),
)
def parse_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, at = F.col("event_type"), F.col("event_id") % 5
    raw = F.when(at == 0, F.concat(F.lit("  "), F.upper(kind), F.lit(" "))).when(at == 1, F.concat(kind, F.lit("\n"))).when(at == 2, "").when(at == 3, F.concat(F.lit("the "), kind))
    label, error = C.parsed_label(F.col("raw"), X.CLASSES)
    return X.table(spark, sf_dir, "events").select("event_id", raw.alias("raw")).select("event_id", label.alias("label"), error.alias("error"))


_NUMBER = "coalesce(CASE WHEN isfinite(dirty) THEN CAST(CAST(dirty AS DECIMAL(18, 2)) AS VARCHAR) END, 'NA')"


@query(
    "fn_2_serialized_scalars",
    f"""WITH {X.DIRTY_SQL} SELECT event_id, CASE WHEN isfinite(dirty) THEN printf('%.15g', dirty / 7) ELSE 'NA' END AS share, CASE WHEN isfinite(dirty) THEN printf('%.15g', dirty * 1e14::DOUBLE) ELSE 'NA' END AS large,
 user_id::VARCHAR AS number, CASE WHEN event_id % 3 = 0 THEN 'NA' WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END AS even, event_type || ' of ' || user_id AS text FROM dirty_events""",
)
def serialized_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of every kind, with missing and infinite numbers."""
    cells = {
        "share": (F.col("dirty") / 7, "double"), "large": (F.col("dirty") * F.lit(1e14), "double"), "number": (F.col("user_id"), "bigint"),
        "even": (F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 2 == 0), "boolean"), "text": (F.concat("event_type", F.lit("\n"), F.lit("of"), F.lit("\r\n"), F.col("user_id").cast("string")), "string"),
    }
    return X.dirty_events(spark, sf_dir).select("event_id", *(C.serialized(value, kind).alias(name) for name, (value, kind) in cells.items()))


@query(
    "fn_3_csv_rows",
    f"""WITH {X.DIRTY_SQL} SELECT event_id, {_NUMBER} || ',' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || ',' || chr(34) || event_type || ', ' || chr(34) || chr(34) || user_id || chr(34) || chr(34) || chr(34) AS record,
 'value: ' || {_NUMBER} || chr(10) || 'kind: ' || event_type AS lines FROM dirty_events""",
)
def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.coalesce(C.finite(F.col("dirty")).cast("decimal(18,2)").cast("string"), F.lit("NA"))
    text = F.concat("event_type", F.lit(', "'), F.col("user_id").cast("string"), F.lit('"'))
    cells = [number, C.serialized(F.col("event_id") % 2 == 0, "boolean"), C.serialized(text, "string")]
    return X.dirty_events(spark, sf_dir).select("event_id", C.csv_row(cells).alias("record"), C.named_lines(["value", "kind"], [number, F.col("event_type")]).alias("lines"))


@query(
    "fn_6_mean_std_round_trip",
    """SELECT n_nationkey, n_nationkey / 8.0::DOUBLE AS mean, n_regionkey / 4.0::DOUBLE AS std FROM nation""",
)
def mean_std_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = X.table(spark, sf_dir, "nation").select("n_nationkey", C.mean_std(F.col("n_nationkey") / F.lit(8.0), F.col("n_regionkey") / F.lit(4.0)).alias("t"))
    mean, std = C.parsed_mean_std(F.col("t"))
    return shown.select("n_nationkey", mean.alias("mean"), std.alias("std"))


@query(
    "fn_8_configuration_ids",
    """SELECT max_depth, sampler, substr(sha256('{"max_depth":' || coalesce(max_depth::VARCHAR, 'null') || ',"sampler":"' || sampler || '"}'), 1, 12) AS configuration_id
FROM (SELECT CASE WHEN p_size % 7 <> 0 THEN p_size END AS max_depth, p_type AS sampler FROM part)""",
)
def configuration_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the parts' sizes and types, some sizes missing, as options of a configuration."""
    rows = X.table(spark, sf_dir, "part").select(F.when(F.col("p_size") % 7 != 0, F.col("p_size")).alias("max_depth"), F.col("p_type").alias("sampler"))
    return experiment.configuration_ids(rows, ["sampler", "max_depth"])


@query(
    "fn_9_axis_transforms",
    """SELECT event_id, round(sqrt(value), 6) AS sqrt_value, round(cbrt(value), 6) AS cbrt_value, round(ln(1 + value), 6) AS log1p_value, round(value, 6) AS back FROM events""",
)
def axis_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value")
    made = {f"{name}_value": forward(value) for name, (forward, _) in C.TRANSFORMS.items() if name != "linear"}
    forward, back = C.TRANSFORMS["log1p"]
    return X.table(spark, sf_dir, "events").select("event_id", *[c.alias(n) for n, c in made.items()], back(forward(value)).alias("back"))


@query(
    "fn_14_guarded_ratio",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 0.0::DOUBLE ELSE round(o_totalprice / (o_orderkey % 4), 6) END AS ratio FROM orders""",
)
def guarded_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "orders").select("o_orderkey", C.ratio(F.col("o_totalprice"), F.col("o_orderkey") % 4).alias("ratio"))


# filters


@query("flt_1_conjunction", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "orders").where("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'").select("o_orderkey", "o_totalprice")


@query("flt_4_finite_rows", f"WITH {X.DIRTY_SQL} SELECT event_id, dirty FROM dirty_events WHERE isfinite(dirty)")
def finite_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.dirty_events(spark, sf_dir).where(C.finite(F.col("dirty")).isNotNull()).select("event_id", "dirty")


@query("flt_5_membership", "SELECT event_id FROM events WHERE event_type IN ('view', 'click') AND user_id IN (1, 2, 3, 5, 8)")
def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click") & F.col("user_id").isin(1, 2, 3, 5, 8)).select("event_id")


@query("flt_8_first_of_class", "SELECT event_type, min(event_id) AS event_id, arg_min(user_id, event_id) AS user_id FROM events GROUP BY 1")
def first_of_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.best_row(X.table(spark, sf_dir, "events").select("event_type", "event_id", "user_id"), ["event_type"], -F.col("event_id"))


# profiles


@query(
    "agg_1_overview",
    f"""WITH {X.DIRTY_SQL} SELECT split, count(*) AS n_rows, 7 AS n_columns, 2 AS predictor_columns, 1 AS target_columns, 2 AS identifier_columns, 2 AS metadata_columns, 'event_type' AS target FROM dirty_events GROUP BY 1""",
)
def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.overview(X.dirty_events(spark, sf_dir), events_schema(spark, sf_dir))


@query(
    "agg_2_target_distribution",
    """WITH l AS (SELECT CASE WHEN d.doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, coalesce(toxic::VARCHAR, '<missing>') AS category FROM documents d LEFT JOIN labels USING (doc_id))
SELECT split, category, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY split))::DOUBLE, 6) AS share FROM l GROUP BY 1, 2""",
)
def target_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.table(spark, sf_dir, "documents").select("doc_id").join(X.table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = rows.selectExpr("CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split", "toxic")
    return profile.target_distribution(rows, "toxic")


@query(
    "agg_3_inventory",
    """SELECT * FROM (VALUES (0, 'event_id', 'integer', 'numeric', 'identifier'), (1, 'user_id', 'integer', 'numeric', 'identifier'), (2, 'event_type', 'string', 'categorical', 'target'),
 (3, 'ts', 'datetime', 'datetime', 'metadata'), (4, 'value', 'float', 'numeric', 'predictor'), (5, 'dirty', 'float', 'numeric', 'predictor'), (6, 'split', 'string', 'categorical', 'metadata')) t(position, label, data_type, semantic, role)""",
)
def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.dataset_statistics(X.dirty_events(spark, sf_dir), events_schema(spark, sf_dir), percentiles=False)["inventory"].select("position", "label", "data_type", "semantic", "role")


def _quality(name: str, column: str, numeric: bool) -> str:
    infinite = f"count(*) FILTER (isinf({column}))" if numeric else "0"
    return f"SELECT split, '{name}' AS feature, count(*) FILTER ({column} IS NULL) AS n_missing, round((count(*) FILTER ({column} IS NULL)) / count(*)::DOUBLE, 6) AS missing_share, {infinite} AS n_infinite FROM dirty_events GROUP BY 1"


@query("agg_4_data_quality", f"WITH {X.DIRTY_SQL} " + " UNION ALL ".join(_quality(c, c, c in ("value", "dirty")) for c in ("event_id", "user_id", "event_type", "ts", "value", "dirty", "split")))
def data_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.dataset_statistics(X.dirty_events(spark, sf_dir), events_schema(spark, sf_dir), percentiles=False)["quality"]


@query(
    "agg_9_dataset_tables",
    f"""WITH {X.DIRTY_SQL} SELECT 'overview' AS part, split, NULL AS feature, NULL AS category, count(*) AS n, 7::DOUBLE AS value FROM dirty_events GROUP BY split
UNION ALL SELECT 'target', split, 'event_type', event_type, count(*), round(count(*) / (sum(count(*)) OVER (PARTITION BY split))::DOUBLE, 6) FROM dirty_events GROUP BY split, event_type
UNION ALL SELECT 'categorical', split, 'split', split, count(*), 1 FROM dirty_events GROUP BY split
UNION ALL SELECT 'datetime', split, 'ts', NULL, count(DISTINCT ts), round(epoch_us(max(ts)) / 1e6::DOUBLE, 6) FROM dirty_events GROUP BY split
"""
    + "".join(f"UNION ALL SELECT 'quality', split, '{c}', NULL, count(*) FILTER ({c} IS NULL), {'count(*) FILTER (isinf(dirty))' if c == 'dirty' else '0'} FROM dirty_events GROUP BY split\n" for c in ("event_id", "user_id", "event_type", "ts", "value", "dirty", "split"))
    + "".join(f"UNION ALL SELECT 'numeric', split, '{c}', NULL, count({c}), round(stddev_pop({c}), 6) FROM dirty_events WHERE isfinite({c}) GROUP BY split\n" for c in ("event_id", "user_id", "value", "dirty")),
)
def dataset_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each dataset table its counts and one more of its numbers, all cut from one scan."""
    found = profile.dataset_statistics(X.dirty_events(spark, sf_dir), events_schema(spark, sf_dir), percentiles=False)
    shown = {"overview": ("n_rows", "n_columns"), "target": ("n", "share"), "categorical": ("n", "share"), "datetime": ("n_distinct", "CAST(unix_micros(CAST(max AS TIMESTAMP)) AS DOUBLE) / 1e6D"), "quality": ("n_missing", "n_infinite"), "numeric": ("n", "std")}
    parts = []
    for name, (n, value) in shown.items():
        table = found[name].withColumn("feature", F.lit("event_type")) if name == "target" else found[name]
        texts = [F.col(c).alias(c) if c in table.columns else F.lit(None).cast("string").alias(c) for c in ("feature", "category")]
        parts.append(table.select(F.lit(name).alias("part"), "split", *texts, F.col(n).cast("long").alias("n"), F.expr(value).cast("double").alias("value")))
    return reduce(DataFrame.unionByName, parts)


def _profile(column: str, source: str, std: str = "stddev_pop") -> str:
    quantiles = ", ".join(f"round(quantile_cont({column}, {p}), 6) AS {n}" for n, p in profile.PERCENTILES.items())
    return f"SELECT split, '{column}' AS feature, count({column}) AS n, round(min({column}), 6) AS min, round(max({column}), 6) AS max, round(avg({column}), 6) AS mean, round({std}({column}), 6) AS std, {quantiles} FROM {source} WHERE isfinite({column}) GROUP BY 1"


@query("agg_5_numeric_profile", f"WITH {X.DIRTY_SQL} " + " UNION ALL ".join(_profile(c, "dirty_events") for c in ("value", "dirty")))
def numeric_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.numeric_profile(X.dirty_events(spark, sf_dir), ["split"], ["value", "dirty"])


@query(
    "agg_5_lineitem_profile",
    "WITH l AS (SELECT l_returnflag AS split, * FROM lineitem) " + " UNION ALL ".join(_profile(c, "l") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")),
)
def lineitem_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.table(spark, sf_dir, "lineitem").withColumn("split", F.col("l_returnflag"))
    return profile.numeric_profile(rows, ["split"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query(
    "agg_6_binary_counts",
    """WITH f AS (SELECT l_returnflag AS split, l_discount > 0.05 AS discounted, l_linestatus = 'F' AS done FROM lineitem),
u AS (SELECT split, 'discounted' AS feature, discounted::VARCHAR AS category FROM f UNION ALL SELECT split, 'done', done::VARCHAR FROM f)
SELECT split, feature, category, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY split, feature))::DOUBLE, 6) AS share FROM u GROUP BY 1, 2, 3""",
)
def binary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.table(spark, sf_dir, "lineitem").selectExpr("l_returnflag AS split", "l_discount > 0.05D AS discounted", "l_linestatus = 'F' AS done")
    return profile.value_counts(rows, ["split"], ["discounted", "done"])


@query(
    "agg_7_categorical_counts",
    """WITH u AS (SELECT 'o_orderstatus' AS feature, o_orderstatus AS category FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders)
SELECT feature, category, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY feature))::DOUBLE, 6) AS share FROM u GROUP BY 1, 2""",
)
def categorical_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.value_counts(X.table(spark, sf_dir, "orders"), [], ["o_orderstatus", "o_orderpriority"])


@query(
    "agg_8_datetime_profile",
    f"""WITH {X.DIRTY_SQL}, d AS (SELECT split, CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts END AS seen FROM dirty_events)
SELECT split, 'seen' AS feature, min(seen) AS min, max(seen) AS max, count(*) FILTER (seen IS NULL) AS n_missing, count(DISTINCT seen) AS n_distinct FROM d GROUP BY 1""",
)
def datetime_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.dirty_events(spark, sf_dir).withColumn("seen", F.when(F.col("event_id") % 11 != 0, F.col("ts")))
    return profile.datetime_profile(rows, ["split"], ["seen"])


@query(
    "agg_10_feature_statistics",
    f"""WITH {X.DIRTY_SQL}, s AS (SELECT count(*) FILTER (dirty IS NULL) AS missing, count(*) FILTER (isinf(dirty)) AS infinite FROM dirty_events),
f AS (SELECT round(stddev_samp(dirty), 6) AS std, {', '.join(f'round(quantile_cont(dirty, {p}), 6) AS {n}' for n, p in profile.PERCENTILES.items())} FROM dirty_events WHERE isfinite(dirty))
SELECT 'missing' AS statistic, missing::DOUBLE AS value FROM s UNION ALL SELECT 'infinite', infinite FROM s UNION ALL SELECT 'std', std FROM f
UNION ALL {' UNION ALL '.join(f"SELECT '{n}', {n} FROM f" for n in profile.PERCENTILES)}""",
)
def feature_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.feature_statistics(X.dirty_events(spark, sf_dir), "dirty").where("statistic <> 'range'")
    return found.select("statistic", F.col("value").cast("double").alias("value"))


@query(
    "agg_11_ordered_categories",
    """SELECT o_orderpriority AS category, count(*) AS n, row_number() OVER (ORDER BY CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '1-URGENT' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 4 END, o_orderpriority) AS position FROM orders GROUP BY 1""",
)
def ordered_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.ordered_categories(X.table(spark, sf_dir, "orders"), "o_orderpriority", ["5-LOW", "1-URGENT", "3-MEDIUM"])


@query(
    "agg_12_crosstab",
    """SELECT s AS o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS "1-URGENT", count(*) FILTER (o_orderpriority = '5-LOW') AS "5-LOW", count(*) FILTER (o_orderpriority = 'never') AS "never"
FROM (SELECT unnest(['O', 'F', 'P', 'X']) AS s) LEFT JOIN orders ON o_orderstatus = s GROUP BY 1""",
)
def crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.crosstab(X.table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority", ["O", "F", "P", "X"], ["1-URGENT", "5-LOW", "never"])


def _edges(forward: str, back: str, bins: int) -> str:
    return f"""WITH {X.DIRTY_SQL}, v AS (SELECT split, dirty + 2 AS v FROM dirty_events WHERE isfinite(dirty)), e AS (SELECT min(v) AS a, max(v) AS b FROM v),
t AS (SELECT a, b, {forward.format('a')} AS lo, {forward.format('b')} AS hi FROM e),
k AS (SELECT bin, CASE WHEN bin = 0 THEN a ELSE {back.format(f'(lo + (hi - lo) * bin / {bins})')} END AS low, CASE WHEN bin = {bins - 1} THEN b ELSE {back.format(f'(lo + (hi - lo) * (bin + 1) / {bins})')} END AS high FROM t, (SELECT unnest(range({bins}))::INT AS bin)),
c AS (SELECT split, least(floor(({forward.format('v')} - lo) / (hi - lo) * {bins}), {bins - 1})::INT AS bin, count(*) AS n FROM v, t GROUP BY 1, 2)"""


@query("agg_13_histogram_edges", _edges("sqrt({0})", "({0} * {0})", 12) + " SELECT bin, round(low, 6) AS low, round(high, 6) AS high FROM k")
def histogram_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.histogram_edges(X.dirty_events(spark, sf_dir).withColumn("v", F.col("dirty") + 2), "v", 12, "sqrt")


@query("agg_14_histogram", _edges("{0}", "{0}", 20) + " SELECT bin, round(low, 6) AS low, round(high, 6) AS high, coalesce(sum(n), 0)::BIGINT AS n FROM k LEFT JOIN c USING (bin) GROUP BY 1, 2, 3")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.histogram(X.dirty_events(spark, sf_dir).withColumn("v", F.col("dirty") + 2), "v", 20)


@query(
    "agg_15_stratified_histogram",
    _edges("ln(1 + {0})", "(exp({0}) - 1)", 10) + " SELECT s.split, bin, round(low, 6) AS low, round(high, 6) AS high, coalesce(n, 0)::BIGINT AS n FROM k CROSS JOIN (SELECT DISTINCT split FROM v) s LEFT JOIN c USING (split, bin)",
)
def stratified_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.histogram(X.dirty_events(spark, sf_dir).withColumn("v", F.col("dirty") + 2), "v", 10, "log1p", ["split"])


@query(
    "agg_16_box_statistics",
    f"""WITH {X.DIRTY_SQL}, b AS (SELECT event_type, dirty AS v FROM dirty_events WHERE isfinite(dirty) UNION ALL SELECT '<all>', dirty FROM dirty_events WHERE isfinite(dirty)),
q AS (SELECT event_type, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM b GROUP BY 1)
SELECT event_type, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, count(*) AS n, min(v) FILTER (v >= q1 - 1.5 * (q3 - q1)) AS whisker_low, max(v) FILTER (v <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
 count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS n_outside FROM b JOIN q USING (event_type) GROUP BY event_type, q.q1, q.median, q.q3""",
)
def box_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.box_statistics(X.dirty_events(spark, sf_dir), "dirty", "event_type")


@query(
    "agg_18_quantile_ticks",
    " UNION ".join(f"SELECT round(quantile_cont(sqrt(value), {p}), 6) AS tick FROM events" for p in (0.25, 0.5, 0.75)),
)
def quantile_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.quantile_ticks(X.dirty_events(spark, sf_dir), "value", "sqrt")


@query(
    "agg_19_duplicate_rows",
    """WITH r AS (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 10 = 0), d AS (SELECT DISTINCT * FROM r)
SELECT (SELECT count(*) FROM r) AS n_rows, (SELECT count(*) FROM d) AS n_distinct, (SELECT count(*) FROM r) - (SELECT count(*) FROM d) AS n_duplicates""",
)
def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of lineitem, with a tenth of the orders twice."""
    rows = X.table(spark, sf_dir, "lineitem")
    return profile.duplicate_rows(rows.unionByName(rows.where("l_orderkey % 10 = 0")))


# reshaping, sets and order


@query(
    "rsh_1_pivot",
    """SELECT o_orderpriority, round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 6) AS "O", round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 6) AS "F" FROM orders GROUP BY 1""",
)
def pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = X.table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.sum("o_totalprice").alias("v"))
    return summaries.pivoted(sums, ["o_orderpriority"], "o_orderstatus", ["O", "F"], "v")


@query("rsh_2_melt", "SELECT l_orderkey, l_linenumber, l_partkey, 'l_tax' AS feature, l_tax AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'l_discount', l_discount FROM lineitem")
def melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.melted(X.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"], ["l_tax", "l_discount"], "feature", "value")


@query(
    "rsh_3_one_hot",
    """SELECT c_custkey, c_mktsegment, (c_mktsegment = 'BUILDING')::INT AS "c_mktsegment_BUILDING", (c_mktsegment = 'FURNITURE')::INT AS "c_mktsegment_FURNITURE" FROM customer""",
)
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.one_hot(X.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", ["BUILDING", "FURNITURE"])


@query("set_1_union_all", "SELECT s_nationkey AS nation, 'supplier' AS kind FROM supplier UNION ALL SELECT c_nationkey, 'customer' FROM customer")
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = X.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("kind"))
    return one.unionByName(X.table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nation")))


@query("set_2_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("set_3_difference", "SELECT DISTINCT c_nationkey AS nation FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey % 2 = 0")
def difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = X.table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_nationkey").alias("nation"))
    return X.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).subtract(some)


@query("srt_1_ranking", "SELECT s_suppkey, round(s_acctbal, 6) AS s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 10")
def ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(10)


@query(
    "srt_2_domain_order",
    "SELECT r_name, row_number() OVER (ORDER BY CASE r_name WHEN 'EUROPE' THEN 1 WHEN 'ASIA' THEN 2 ELSE 3 END, r_name) AS position FROM region",
)
def domain_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.by_domain(X.table(spark, sf_dir, "region").select("r_name"), "r_name", ["EUROPE", "ASIA"], "r_name")


@query(
    "srt_2_customers_by_segment",
    """SELECT c_custkey, c_mktsegment, (row_number() OVER (ORDER BY CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 3 END, c_acctbal DESC, c_custkey))::INT AS position FROM customer""",
)
def customers_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers in the order of a domain that lacks some segments, then by what they own."""
    rows = X.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return summaries.by_domain(rows, "c_mktsegment", ["MACHINERY", "BUILDING"], F.desc("c_acctbal"), "c_custkey").drop("c_acctbal")


@query("chk_2_outside_domain", "SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def outside_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.outside_domain(X.table(spark, sf_dir, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"])


@query("chk_3_repeated_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.repeated_keys(X.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "chk_5_ranges",
    f"""WITH {X.DIRTY_SQL} SELECT count(*) FILTER (dirty IS NULL OR NOT isfinite(dirty) OR NOT dirty BETWEEN 0 AND 400) AS n_outside, count(*) FILTER (dirty IS NULL) AS n_null, count(*) FILTER (dirty < 0) AS n_negative,
 count(*) FILTER (isfinite(dirty) AND dirty <> floor(dirty)) AS n_not_whole FROM dirty_events""",
)
def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.dirty_events(spark, sf_dir)
    return rows.agg(
        checks.out_of_range("dirty", 0, 400).alias("n_outside"), F.count_if(F.col("dirty").isNull()).alias("n_null"), F.count_if(F.col("dirty") < 0).alias("n_negative"), checks.not_whole("dirty").alias("n_not_whole")
    )
