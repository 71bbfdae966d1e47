import pytest
from pyspark.sql import functions as F

from tabulens.functions import text


def values(spark, cells, build):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(build(F.col("v"))).collect()]


def test_numbers(spark):
    cells = ["1,610", "89,17,000", "-12.5", "+7", ".5", " 3 ", "1,2,3", "1e3", "5%", "$4", "", None, "12,34"]
    assert values(spark, cells, text.to_number) == [1610.0, 8917000.0, -12.5, 7.0, 0.5, 3.0, None, None, None, None, None, None, None]


def test_generic_numbers(spark):
    assert values(spark, ["1e3", "inf", "-Infinity", "1,610", "0x1A", "1_000", "NaN", "1d"], text.to_number_generic) == [1000.0, float("inf"), float("-inf"), None, None, None, None, None]


def test_booleans(spark):
    assert values(spark, ["Yes", " n ", "TRUE", "0", "maybe", None], text.to_boolean) == [True, False, True, False, None, None]


def test_strip_takes_all_python_white_space(spark):
    cells = [f"{c}x {c}" for c in "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 　"]
    assert values(spark, cells, text.strip) == [c.strip() for c in cells]


def test_null_words_and_blanks(spark):
    assert values(spark, ["NA", " n/a ", "", "x", None], text.null_words_out) == [None, None, None, "x", None]
    assert values(spark, ["  ", "x", ""], text.blanks_out) == [None, "x", None]


def test_title(spark):
    cells = ["they're a-b", "éCOLE x1y", ""]
    assert values(spark, cells, text.title) == [c.title() for c in cells]


@pytest.mark.parametrize(
    ("cell", "day_first", "day"),
    [("2024-02-01", None, "2024-02-01"), ("01/02/2024", None, "2024-01-02"), ("01/02/2024", True, "2024-02-01"), ("14/01/2025", None, "2025-01-14"), ("01/14/2025", True, "2025-01-14"), ("3 mar 2024", None, "2024-03-03"), ("March 3, 2024", None, "2024-03-03"), ("now", None, None), ("12:30", None, None), ("2025", None, None), ("2024-13-01", None, None)],
)
def test_dates(spark, cell, day_first, day):
    assert values(spark, [cell], lambda c: F.date_format(text.to_timestamp(c, day_first), "yyyy-MM-dd")) == [day]


def test_zones_become_utc(spark):
    got = values(spark, ["2024-01-01T00:00:00+00:00", "2024-01-01T00:00:00+05:30"], lambda c: text.iso(text.to_timestamp(c)))
    assert got == ["2024-01-01T00:00:00Z", "2023-12-31T18:30:00Z"]


def test_signatures(spark):
    assert values(spark, ["2024-01-02", "1/2/24", "2 Jan 2024", "x"], text.date_signature) == ["iso_date", "numeric_date", "named_date", None]
    assert values(spark, ["3 kg", "4 lbs", "5", "x"], text.unit_signature) == ["unit:kg", "unit:lbs", "unit:none", None]


def test_percent_currency_strict(spark):
    assert values(spark, ["5%", "+1.5 %", "%"], text.is_percentage) == [True, True, False]
    assert values(spark, ["$1,200.5", "€ 3", "3$"], text.is_currency) == [True, True, False]
    assert values(spark, ["$1,200.5", "5%", "x%"], text.is_strict_float) == [True, True, False]


def test_log(spark):
    df = spark.createDataFrame([(1.0,), (-2.0,), (None,)], "v double")
    assert [r[0] for r in df.select(text.log_transform(F.col("v"))).collect()] == [0.0, -2.0, None]
