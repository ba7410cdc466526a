"""Lists in order, datasets by name, digests that stream, draws in chunks, ticks of nonlinear axes, dataset tables in one scan."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import axes
from plumbline.operators import profile, reporting, sampling, summaries
from plumbline.plans import fixtures as X
from plumbline.plans import profile_queries, report_queries
from plumbline.plans.file_queries import ORDERS, _written_orders
from plumbline.plans.queries import QUERIES
from plumbline.sources import files
from plumbline.sources.datasets import Catalog, Dataset

SMALL = "/root/testdata/sf0.001"


def test_lines_of_several_files_and_splits_are_numbered(spark, tmp_path):
    for n, count in enumerate((700, 1, 300)):
        (tmp_path / f"part-{n}.csv").write_text("row_index\n" + "".join(f"{(i * 7919 + n) % 100_003}\n" for i in range(count)))
    expected = [(i * 7919 + n) % 100_003 for n, count in enumerate((700, 1, 300)) for i in range(count)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (old, "900"):  # several splits of a file
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            listed = spark.read.schema("row_index long").option("header", True).csv(f"file://{tmp_path}")
            assert size == old or listed.rdd.getNumPartitions() > 4
            assert [r["row_index"] for r in files.numbered_lines(listed).orderBy("position").collect()] == expected
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_a_list_is_selected_in_its_order(spark, tmp_path):
    (tmp_path / "list.csv").write_text("row_index\n7\n2\n9.0\n0\n")
    rows = spark.range(10).selectExpr("id AS row_index", "id * 10 AS v")
    found = files.selected_in_order(spark, f"file://{tmp_path}/list.csv", rows)
    assert [(r["row_index"], r["v"]) for r in found.orderBy("position").collect()] == [(7, 70), (2, 20), (9, 90), (0, 0)]
    with pytest.raises(ValueError, match="1 indices are not available"):
        files.selected_in_order(spark, f"file://{tmp_path}/list.csv", rows.where("row_index <> 9"))


def test_datasets_have_one_definition(spark):
    path = _written_orders(spark, SMALL)
    catalog, one = Catalog(), Dataset("Orders_2", ORDERS, {"train": path})
    catalog.register(one)
    catalog.register(one)
    assert catalog.names() == ["orders_2"] and catalog["ORDERS_2"] is one
    with pytest.raises(ValueError, match="something else"):
        catalog.register(Dataset("orders_2", ORDERS, {"test": path}))
    with pytest.raises(ValueError, match="view's name"):
        catalog.register(Dataset("a b", ORDERS, {"test": path}))
    with pytest.raises(KeyError, match="no dataset x; there are orders_2"):
        catalog.frame(spark, "x")
    assert catalog.publish(spark) == ["orders_2", "orders_2_train"]
    assert spark.sql("SELECT count(*) FROM orders_2_train WHERE price > 0").first()[0] > 0 and spark.table("orders_2").columns[-1] == "split"


@pytest.mark.parametrize("keys", [[], ["g"], ["g", "id"]])
def test_digests_of_ids_stream(spark, keys):
    rows = [(g, i, (i * 7919) % 30_011) for g in (None, "a", "b") for i in range(40)] + [("a", 3, None), ("c", 1, -5)]
    frame = spark.createDataFrame([(g, i % 3, v) for g, i, v in rows], "g string, id long, v long").repartition(5)
    frame = frame.withColumnRenamed("id", "id")
    groups = {}
    for g, i, v in ((r["g"], r["id"], r["v"]) for r in frame.collect()):
        if v is not None:
            groups.setdefault(tuple({"g": g, "id": i}[k] for k in keys), []).append(v)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (old, "7"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            found = {tuple(r[k] for k in keys): r["digest"] for r in summaries.id_digest(frame, "v", keys).collect()}
            assert found == {k: hashlib.sha256("".join(f"{v}\n" for v in sorted(vs)).encode()).hexdigest() for k, vs in groups.items()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_no_row_holds_a_group(spark):
    plan = summaries.id_digest(spark.range(10), "id")._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "MapInArrow" in plan


def test_draws_come_in_chunks(spark, monkeypatch):
    rows = spark.range(500).selectExpr("id", "CASE WHEN id < 7 THEN 'few' WHEN id < 60 THEN 'some' ELSE 'many' END AS kind")
    expected = sorted(map(tuple, sampling.oversampled(rows, "kind", 3, "id").collect()))
    monkeypatch.setattr(sampling, "CHUNK", 10)
    monkeypatch.setattr(sampling, "BROADCAST_CLASSES", 1)
    found = sorted(map(tuple, sampling.oversampled(rows, "kind", 3, "id").collect()))
    assert found == expected and len(found) == 3 * 440
    copies = sampling.oversampled(rows, "kind", 3, "id").where("kind = 'few' AND copy > 0").agg(F.count("*"), F.count_distinct("copy"), F.max("copy")).first()
    assert tuple(copies) == (433, 433, 433)


def plain_ticks(low, high, transform, quantiles, least):
    """Ticks by the rule in words, one step after the other, all distances measured again each time."""
    forward, back = axes.FORWARD_AND_BACK[transform]
    a, b = forward(low), forward(high)
    if b <= a:
        return [low, high]
    decades = [forward(10.0**p) for p in range(-20, 20) if low <= 10.0**p <= high] if low >= 0 else []
    even = [a + (b - a) * i / ((least + 2) * 4 - 1) for i in range(1, (least + 2) * 4 - 1)]
    for share in (0.6, 0.45, 0.3, 0.15, 0.0):
        apart, ticks = (b - a) / (least + 1) * share, []
        for d in decades:
            if min(abs(d - t) for t in [*ticks, a, b]) >= apart:
                ticks.append(d)
        for pool in ([forward(q) for q in quantiles if a < forward(q) < b], even):
            while len(ticks) < least:
                ranked = sorted({(-min(abs(c - t) for t in [*ticks, a, b]), c) for c in pool if c not in ticks})
                if not ranked or -ranked[0][0] < apart:
                    break
                ticks.append(ranked[0][1])
        if len(ticks) >= least:
            break
    return [back(t) for t in [a, *sorted({t for t in ticks if a < t < b}), b]]


@settings(max_examples=200, deadline=None)
@given(st.floats(0, 1e7), st.floats(0, 1e9), st.lists(st.floats(0, 1), min_size=3, max_size=3), st.sampled_from(["sqrt", "cbrt", "log1p", "linear"]), st.integers(1, 7))
def test_nonlinear_ticks_are_those_of_the_plain_version(low, width, shares, transform, least):
    quantiles = sorted(low + width * s for s in shares)
    found = axes.nonlinear_ticks(low, low + width, transform, quantiles, least)
    assert found == pytest.approx(plain_ticks(low, low + width, transform, quantiles, least), rel=1e-9, abs=1e-9)
    assert found == sorted(found) and found[0] == pytest.approx(low, rel=1e-9, abs=1e-9)


def test_negative_ranges_and_large_ones():
    assert axes.nonlinear_ticks(0, 1e6, "log1p") == pytest.approx([0, 10, 100, 1e3, 1e4, 1e5, 1e6], rel=1e-9) or len(axes.nonlinear_ticks(0, 1e6, "log1p")) >= 7
    cubes = axes.nonlinear_ticks(-8, 27, "cbrt")
    assert len(cubes) >= 7 and cubes[0] == pytest.approx(-8) and cubes[-1] == pytest.approx(27)
    assert axes.nonlinear_ticks(5, 5, "sqrt") == [5, 5]


def test_ticks_of_the_query(spark):
    found = {}
    for r in report_queries.nonlinear_ticks(spark, SMALL).orderBy("id", "place").collect():
        found.setdefault(r["id"], []).append(r["tick"])
    values = {}
    for r in X.table(spark, SMALL, "lineitem").select("l_suppkey", "l_extendedprice").collect():
        values.setdefault(r[0], []).append(r[1])
    assert found.keys() == values.keys()
    for key, own in values.items():
        own.sort()
        at = lambda p, own=own: own[math.floor(p * (len(own) - 1))] + (own[math.ceil(p * (len(own) - 1))] - own[math.floor(p * (len(own) - 1))]) * (p * (len(own) - 1) % 1)
        assert found[key] == pytest.approx(plain_ticks(own[0], own[-1], "log1p", [at(p) for p in (0.25, 0.5, 0.75)], 5), rel=1e-9)


def test_ticks_of_the_query_are_of_suppliers_parts_and_users(spark):
    found = {}
    for r in QUERIES["fn_11_nonlinear_ticks"](spark, SMALL).orderBy("kind", "id", "place").collect():
        found.setdefault((r["kind"], r["id"]), []).append(r["tick"])
    values = {}
    for kind, table, key, value in (("supplier", "lineitem", "l_suppkey", "l_extendedprice"), ("part", "lineitem", "l_partkey", "l_extendedprice"), ("user", "events", "user_id", "value")):
        for r in X.table(spark, SMALL, table).select(key, value).collect():
            values.setdefault((kind, r[0]), []).append(r[1])
    assert found.keys() == values.keys() and {kind for kind, _ in found} == {"supplier", "part", "user"}
    for group, own in values.items():
        quartiles = np.quantile(own, [0.25, 0.5, 0.75]).tolist()
        assert found[group] == pytest.approx(plain_ticks(min(own), max(own), "log1p", quartiles, 5), rel=1e-6, abs=1e-6)


def test_tables_of_a_dataset_come_from_one_scan(spark):
    rows, schema = X.dirty_events(spark, SMALL), profile_queries.events_schema(spark, SMALL)
    found = profile.dataset_statistics(rows, schema, percentiles=False)
    for name, table in found.items():
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "events.parquet" not in plan and (name == "inventory" or "cells-" in plan), name
    scans = profile.dataset_cells(rows, schema)._jdf.queryExecution().executedPlan().toString()
    assert scans.count("FileScan") == 1
    whole = profile.dataset_statistics(rows, schema)["numeric"]
    alone = profile.numeric_profile(rows, ["split"], ["event_id", "user_id", "value", "dirty"])
    key = lambda r: (r["split"], r["feature"])
    mine, theirs = ({key(r): r for r in t.select(alone.columns).collect()} for t in (whole, alone))
    assert mine.keys() == theirs.keys() and all(mine[k][2:] == pytest.approx(theirs[k][2:]) for k in mine)


def test_features_that_classifiers_lack(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"), ("b", "z")], "classifier string, original_feature string")
    assert [tuple(r) for r in reporting.feature_differences(rows).collect()] == [("z", 1, "a")]
    assert reporting.feature_differences(rows.where("original_feature <> 'z'")).collect() == []
