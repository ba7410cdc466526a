import json
from datetime import datetime

import pytest

from plumbline.plans import file_queries
from plumbline.plans.file_queries import ORDERS
from plumbline.schema import DataType, Feature, Role, Schema, Semantic, from_struct, identity
from plumbline.sources import files, sinks
from plumbline.transform import project

HEADER = "Order Key,Price,Urgent,Placed,Status"


def written(tmp_path, text):
    path = tmp_path / "orders.csv"
    path.write_text(text)
    return str(path)


def test_strict_csv(spark, tmp_path):
    rows = files.load_csv(spark, written(tmp_path, f"{HEADER}\n1,inf,1,2/3/2022 1:02:03 PM,F\n2,-inf,0,2022-03-02 13:02:03,O\n3,NaN,,,\n4,,true,,P\n"), ORDERS).collect()
    assert [r["price"] for r in rows][:2] == [float("inf"), float("-inf")] and rows[2]["price"] != rows[2]["price"] and rows[3]["price"] is None
    assert [r["urgent"] for r in rows] == [True, False, None, True] and rows[0]["placed"] == rows[1]["placed"] and rows[2]["status"] is None


@pytest.mark.parametrize(
    ("header", "why"),
    [
        ("Order Key,Price,Urgent,Placed", "missing columns: Status"),
        (HEADER + ",More", "unexpected columns: More"),
        (HEADER + ",Price", "repeated columns: Price"),
        ("Price,Order Key,Urgent,Placed,Status", "column 0 is Price, not Order Key"),
    ],
)
def test_headers(spark, tmp_path, header, why):
    with pytest.raises(files.UnreadableCsv, match=why):
        files.load_csv(spark, written(tmp_path, header + "\n"), ORDERS)


@pytest.mark.parametrize("row", ["x,1,1,,F", "1.5,1,1,,F", "1,abc,1,,F", "1,1,maybe,,F", "1,1,1,soon,F", "1,1,1,,Z"])
def test_bad_cells_raise(spark, tmp_path, row):
    with pytest.raises(Exception, match="."):
        files.load_csv(spark, written(tmp_path, f"{HEADER}\n{row}\n"), ORDERS).collect()


@pytest.mark.parametrize("query", [file_queries.csv_scan, file_queries.bundle])
def test_prices_and_times_are_written_whole(spark, tmp_path, query):
    """Prices of more than two places, very large ones, and times with parts of a second come back as they were."""
    rows = [(k, [0.125, 1e17 + 64, 7.5, -0.0004, None][k % 5], when, "1-URGENT", "O") for k in range(1, 21) for when in [datetime(2001, 8, 1, 12 * (k % 2), 0, k % 3, (k % 4) * 250_001)]]
    spark.createDataFrame(rows, "o_orderkey long, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    found = {r["order"]: (r["price"], r["placed"]) for r in query(spark, str(tmp_path)).collect()}
    assert found == {k: (price, when) for k, price, when, *_ in rows}


def test_missing_file(spark, tmp_path):
    with pytest.raises(files.UnreadableCsv):
        files.load_csv(spark, str(tmp_path / "nowhere.csv"), ORDERS)


def test_logs(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"row_index": 1, "v": "a", "n": 1}\n\n{"row_index": 1, "v": "b", "n": 2}\n{"row_index": 2, "v": null, "n": 1}\n')
    rows = files.load_log(spark, str(path), "row_index long, v string, n int", "row_index", "n").collect()
    assert {r["row_index"]: r["v"] for r in rows} == {1: "b", 2: None}
    path.write_text("{broken\n")
    with pytest.raises(Exception, match="."):
        files.load_log(spark, str(path), "row_index long, v string, n int", "row_index", "n").collect()


@pytest.mark.parametrize(("text", "why"), [("1\n1\n", "repeated"), ("1.5\n", "not whole"), ("x\n", "missing or not numeric"), ("9\n", "not available"), ("", "rows")])
def test_index_lists(spark, tmp_path, text, why):
    path = tmp_path / "index.csv"
    path.write_text("row_index\n" + text)
    with pytest.raises(ValueError, match=why):
        files.load_indices(spark, str(path), spark.range(5).withColumnRenamed("id", "row_index"))


def test_json_sink(spark, tmp_path):
    path = f"file://{tmp_path}/deep.json"
    sinks.write_json(spark, {"b": 1, "a": [1, 2]}, path)
    sinks.write_json(spark, {"b": 2, "a": [1, 2]}, path)
    assert list(json.loads((tmp_path / "deep.json").read_text())) == ["a", "b"] and files.load_json(spark, path)["b"] == 2


def feature(label="x", kind=DataType.FLOAT, semantic=Semantic.NUMERIC, role=Role.PREDICTOR, **more):
    return Feature(label, kind, semantic, role, **more)


@pytest.mark.parametrize(
    "bad",
    [
        {"label": " "}, {"kind": DataType.DATETIME}, {"formats": ("yyyy",)}, {"kind": DataType.STRING}, {"semantic": Semantic.DATETIME}, {"domain": ("a",)},
        {"kind": DataType.STRING, "semantic": Semantic.CATEGORICAL, "domain": ("a", "a")}, {"expression": lambda: None},
    ],
)
def test_bad_features(bad):
    with pytest.raises(ValueError, match="."):
        feature(**bad)


def test_schemas(spark):
    target = feature("y", DataType.STRING, Semantic.CATEGORICAL, Role.TARGET, domain=("a", "b"))
    schema = Schema((feature(), target))
    assert schema.target is target and schema.labels == ("x", "y") and schema.struct["y"].metadata["domain"] == ["a", "b"]
    with pytest.raises(KeyError):
        schema.feature("z")
    for features in ((), (feature(),), (target, target), (target, feature("z", DataType.STRING, Semantic.CATEGORICAL, Role.TARGET))):
        with pytest.raises(ValueError, match="."):
            Schema(features)
    rows = spark.createDataFrame([(1.0, "a")], "x double, y string")
    assert project(rows, Schema(tuple(map(identity, schema.features)))).schema["y"].metadata["role"] == "target"
    with pytest.raises(ValueError, match="missing: y"):
        project(rows.drop("y"), Schema(tuple(map(identity, schema.features))))
    with pytest.raises(TypeError):
        from_struct(spark.createDataFrame([([1],)], "a array<int>").schema, {"a": Role.TARGET})
