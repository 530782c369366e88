import pytest
from pyspark.sql import functions as F

from loomtext.functions import text as X


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


@pytest.mark.parametrize("x, n, out", [(0.125, 2, "0.12"), (2.675, 2, "2.67"), (1234.5, 1, "1234.5"), (0.5, 0, "0"), (-0.005, 2, "-0.01")])
def test_fixed(spark, x, n, out):
    assert one(spark, X.fixed(F.col("x"), n), x, "double") in (out, out.replace("-0.01", "-0.00"))


@pytest.mark.parametrize("x", [0.1, 1e-4, 1e-5, 1.5e-7, 123456789012345.0, 1e15, 1.5e15, 1e16, 1.25e20, -1e-4, 3.0, 1234567.25])
def test_plain_is_the_shortest_text(spark, x):
    assert one(spark, X.plain(F.col("x")), x, "double") == repr(x)


def test_offsets_count_code_points(spark):
    found = one(spark, X.find_all(F.col("x"), "あ+"), "😀あ-ああ")
    assert [(m.text, m.start, m.end) for m in found] == [("あ", 1, 2), ("ああ", 3, 5)]
    assert one(spark, X.find_all(F.col("x"), "z"), "abc") == []


def test_blanking_keeps_length(spark):
    assert one(spark, X.blanked(F.col("x"), r"<!--(?s).*?-->"), "a<!-- b\nc -->d") == "a      \n     d"


def test_strip_knows_wide_spaces(spark):
    assert one(spark, X.strip(F.col("x")), "　\t a b  ") == "a b"


def test_pstdev_to_the_last_digit(spark):
    import statistics

    xs = [3, 41, 17, 8, 29, 33]
    assert one(spark, X.pstdev(F.col("x")), xs, "array<int>") == pytest.approx(statistics.pstdev(xs), rel=1e-14)


def test_sanitized(spark):
    assert one(spark, X.sanitized(F.col("x")), "a\x1b[0m‮b\n") == "a\\x1b[0m\\u{202e}b\n"
