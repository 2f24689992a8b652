import math

from pyspark.sql import functions as F

from semafold.operators import logic

VALUES = [(1, 2), (2, 2), (3, 2), (None, 2), (1, None), (None, None)]


def evaluated(spark, of, rows, kind="int"):
    frame = spark.createDataFrame(rows, f"a {kind}, b {kind}")
    return [r[0] for r in frame.select(of(F.col("a"), F.col("b"))).collect()]


def test_comparisons_take_nulls(spark):
    want = {
        logic.eq: [False, True, False, False, False, True],
        logic.ne: [True, False, True, True, True, False],
        logic.gt: [False, False, True, False, False, False],
        logic.ge: [False, True, True, False, False, False],
        logic.lt: [True, False, False, False, False, False],
        logic.le: [True, True, False, False, False, False],
    }
    for of, expected in want.items():
        assert evaluated(spark, of, VALUES) == expected, of.__name__


def test_and_or_settle_on_the_left(spark):
    rows = [(False, None), (True, None), (None, False), (None, True), (True, True), (True, False), (False, True), (False, False)]
    assert evaluated(spark, logic.and_, rows, "boolean") == [False, None, None, None, True, False, False, False]
    assert evaluated(spark, logic.or_, rows, "boolean") == [None, True, None, None, True, True, True, False]


def test_arithmetic_gives_null_for_errors(spark):
    assert evaluated(spark, logic.add, [(2147483647, 1), (1, 1), (None, 1)]) == [None, 2, None]
    assert evaluated(spark, logic.divide, [(1, 0), (4, 2)]) == [None, 2.0]
    plus, nan, minus, null = evaluated(spark, logic.divide_doubles, [(1.0, 0.0), (0.0, 0.0), (-1.0, 0.0), (None, 0.0)], "double")
    assert plus == math.inf and math.isnan(nan) and minus == -math.inf and null is None


def test_when(spark):
    frame = spark.createDataFrame([("a",), ("b",), (None,)], "s string")
    got = frame.select(logic.when_value(F.col("s"), [(F.lit("a"), F.lit(1)), (F.lit(None).cast("string"), F.lit(9))])).collect()
    assert [r[0] for r in got] == [1, None, 9]
