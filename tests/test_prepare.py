"""Preprocessing takes a bounded number of categories to the driver."""

import pytest

from plumbline.operators import prepare


def test_categories_and_classes_up_to_the_bound(spark):
    rows = spark.createDataFrame([(1.0, "b"), (3.0, "a"), (None, "b"), (2.0, None)], "x double, c string")
    fitted = prepare.fit(rows, ["x"], ["c"], most=2)
    assert fitted.medians == {"x": 2.0} and fitted.modes == {"c": "b"} and fitted.categories == {"c": ("a", "b")}
    assert prepare.classes_of(rows, "c", most=2) == ["a", "b"]


def test_more_raise(spark):
    rows = spark.createDataFrame([(str(i % 3),) for i in range(9)], "c string")
    with pytest.raises(ValueError, match="more than 2 categories"):
        prepare.fit(rows, [], ["c"], most=2)
    with pytest.raises(ValueError, match="more than 2 classes"):
        prepare.classes_of(rows, "c", most=2)
