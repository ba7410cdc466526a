import pytest
from pyspark.sql import functions as F

from plumbline.functions import axes
from plumbline.functions import columns as C


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_finite_and_missing(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1.5,), (inf,), (-inf,), (nan,), (None,), (-1.0,)]
    assert values(spark, rows, "v double", C.finite(F.col("v"))) == [1.5, None, None, None, None, -1.0]
    assert values(spark, rows, "v double", C.infinite(F.col("v"))) == [False, True, True, False, False, False]
    assert values(spark, rows, "v double", C.missing(F.col("v"), True)) == [False, False, False, True, True, False]
    assert values(spark, rows, "v double", C.sentinel_to_null(F.col("v"), -1))[-1] is None
    kept = values(spark, rows, "v double", C.infinite_to_null(F.col("v")))
    assert kept[:3] == [1.5, None, None] and kept[3] != kept[3]


def test_ports(spark):
    named = {22: "ssh", 40000: "own"}
    got = values(spark, [(p,) for p in (0, 22, 23, 1023, 1024, 40000, 49151, 49152, 65535, None, -4)], "p int", C.port_group(F.col("p"), named))
    assert got == ["not_applicable", "ssh", "well_known", "well_known", "registered", "own", "registered", "dynamic", "dynamic", None, "well_known"]
    with pytest.raises(Exception, match="port out of range"):
        values(spark, [(65536,)], "p int", C.port_group(F.col("p"), named))


def test_three_valued_or_and_codes(spark):
    rows = [(True, None), (None, False), (None, None), (False, False)]
    assert values(spark, rows, "a boolean, b boolean", C.any_true(F.col("a"), F.col("b"))) == [True, None, None, False]
    assert values(spark, [(0,), (6,), (99,), (None,)], "c int", C.mapped(F.col("c"), {0: "hop", 6: "tcp"})) == ["hop", "tcp", None, None]


def test_datetimes(spark):
    formats = ["d/M/yyyy h:mm:ss a", "yyyy-MM-dd HH:mm:ss"]
    got = values(spark, [("2/3/2022 1:02:03 PM",), ("2022-03-02 13:02:03",), (None,)], "t string", C.parsed_datetime(F.col("t"), formats))
    assert got[0] == got[1] and got[0].hour == 13 and got[2] is None
    with pytest.raises(Exception, match="unparsable datetime: soon"):
        values(spark, [("soon",)], "t string", C.parsed_datetime(F.col("t"), formats))
    assert values(spark, [("soon",)], "t string", C.parsed_datetime(F.col("t"), formats, strict=False)) == [None]


def test_class_index_and_domain_order(spark):
    assert values(spark, [("b",), ("a",)], "l string", C.class_index(F.col("l"), ["a", "b"])) == [1, 0]
    for bad in ("x", None):
        with pytest.raises(Exception, match="unknown class|NULL"):
            assert None not in values(spark, [(bad,), ("a",)], "l string", C.class_index(F.col("l"), ["a", "b"]))
    assert values(spark, [("b",), ("z",), ("a",)], "l string", C.domain_order(F.col("l"), ["b", "a"])) == [1, 3, 2]


def test_serialisation(spark):
    assert values(spark, [(1.5,), (float("inf"),), (None,)], "v double", C.serialized(F.col("v"), "double")) == ["1.5", "NA", "NA"]
    assert values(spark, [("a\r\nb",), (None,)], "v string", C.serialized(F.col("v"), "string")) == ["a b", "NA"]
    assert values(spark, [('a"b', "c,d", "e")], "x string, y string, z string", C.csv_row([F.col(c) for c in "xyz"])) == ['"a""b","c,d",e']
    shown = values(spark, [(0.5, 0.25)], "m double, s double", C.mean_std(F.col("m"), F.col("s")))
    assert shown == ["0.50000 ± 0.25000"]


def test_axes():
    assert axes.nice_step(0, 100) == 25.0 and axes.nice_step(3, 3) == 1.0
    assert axes.inner_ticks(0.1, 0.5, 0.1) == pytest.approx([0.1, 0.2, 0.3, 0.4, 0.5])
    assert axes.decade_ticks(0.5, 2000) == [1.0, 10.0, 100.0, 1000.0] and axes.decade_ticks(-3, -1) == []
    assert axes.spaced([0, 1, 50, 100], float, 0, 100) == [0, 50, 100]
    low, high = axes.metric_bounds([0.95, 0.99])
    assert 0.9 < low < 0.95 and high <= 1.0
