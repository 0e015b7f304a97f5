from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from eventlens.functions.text import basename, camel_words, ellipsis, series_label


def col_values(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {dtype}")
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_basename_edge_paths(spark):
    got = col_values(spark, ["/a/b.txt", "b.txt", "/a/b/", "", None], basename)
    assert got == ["b.txt", "b.txt", "/a/b/", "", None]


def test_ellipsis_at_thirty(spark):
    thirty, longer = "x" * 30, "y" * 31
    got = col_values(spark, [thirty, longer, None], ellipsis)
    assert got == [thirty, "y" * 30 + "...", None]


def test_camel_words(spark):
    got = col_values(spark, ["InProgress", "Completed", "aBC", "lower"], camel_words)
    assert got == ["In Progress", "Completed", "a B C", "lower"]


def test_series_label_strings_and_numbers(spark):
    got = col_values(spark, [None, "", "Unknown", "x"], lambda c: series_label(c, StringType()))
    assert got == ["Unknown", "Unknown", "Unknown", "x"]
    got = col_values(spark, [None, 0, 7], lambda c: series_label(c, IntegerType()), "int")
    assert got == ["Unknown", "0", "7"]
