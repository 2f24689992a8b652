from datetime import datetime

from pyspark.sql import functions as F

from semafold.functions import coerce, strings
from semafold.functions import collections as c
from semafold.sources import readers


def one(spark, column):
    return spark.range(1).select(column.alias("r")).first()["r"]


def test_strings(spark):
    title = F.lit("Mr. Jimmy")
    assert one(spark, strings.left(title, F.lit(3))) == "Mr."
    assert one(spark, strings.left(title, F.lit(-1))) is None
    assert one(spark, strings.left(title, F.lit(100))) == "Mr. Jimmy"
    assert one(spark, strings.right(title, F.lit(4))) == "Jimmy"
    assert one(spark, strings.right(title, F.lit(10))) is None
    assert one(spark, strings.mid(title, F.lit(0), F.lit(3))) == "Mr."
    assert one(spark, strings.mid(title, F.lit(3), F.lit(99))) is None
    assert one(spark, strings.concat(F.lit("Jimmy"), F.lit(" "), F.lit(None))) == "Jimmy "
    assert one(spark, strings.trim(F.lit(" \t x  \n"))) == "x"
    assert one(spark, strings.index_of(title, F.lit("z"))) == -1
    assert one(spark, strings.replace(F.lit("a.b"), F.lit("."), F.lit("-"))) == "a-b"


def array(*values):
    return F.array(*[F.lit(v).cast("int") for v in values]) if values else F.expr("cast(array() as array<int>)")


def same(x):
    return x


def test_collections(spark):
    assert one(spark, c.total(array(1, None, 2), same)) == 3.0
    assert one(spark, c.total(array(), same)) == 0.0
    assert one(spark, c.greatest(array(), same)) == 0.0
    assert one(spark, c.greatest(array(None, -5), same)) == 0.0
    assert one(spark, c.greatest(array(-7, None, -5), same)) == -5.0
    assert one(spark, c.least(array(None, 5), same)) == 0.0
    assert one(spark, c.filter_all(array(1, None, 3), lambda x: x > 1)) is None
    assert one(spark, c.filter_all(array(1, 2, 3), lambda x: x > 1)) == [2, 3]
    assert one(spark, c.single(array(1, 2), lambda x: x > 1)) == 2
    assert one(spark, c.single(array(2, 3), lambda x: x > 1)) is None
    assert one(spark, c.get_at_index(array(1, 2), F.lit("1"))) == 2
    assert one(spark, c.get_at_index(array(1, 2), F.lit(-1))) is None
    assert one(spark, c.last(array())) is None
    assert one(spark, c.reduce(array(4, 5, 6), lambda a, b: a * 10 + b)) == 456
    assert one(spark, c.reduce(array(), lambda a, b: a + b)) is None
    assert one(spark, c.any_of(F.lit(True), F.lit(None).cast("boolean"))) is None
    assert one(spark, c.none_of(F.lit(False), F.lit(False))) is True


def test_coercion(spark):
    assert one(spark, coerce.number(F.lit("1,000"))) == 1000.0
    assert one(spark, coerce.number(F.lit("1.5E3"))) == 1500.0
    assert one(spark, coerce.number(F.lit(""))) is None
    assert one(spark, coerce.instant(F.lit("03.02.2001"), ["yyyy/MM/dd", "dd.MM.yyyy"])) == datetime(2001, 2, 3)
    assert one(spark, coerce.instant(F.lit("2001-02-03T04:05:06Z"), ["dd.MM.yyyy"])).minute == 5
    assert one(spark, coerce.enum(F.lit("male"), {"Male": "male", "Female": "female"})) == "Male"
    assert one(spark, coerce.enum(F.lit("other"), {"Male": "male"})) is None


def test_formats(spark, tmp_path):
    text = F.lit('{"a": {"b": 5}, "one": ["x"], "two": ["x", "y"]}')
    assert one(spark, readers.json_path(text, "$.a.b", "int")) == 5
    assert one(spark, readers.json_path(text, "/one")) == "x"
    assert one(spark, readers.json_path(text, "$.two")) == '["x","y"]'
    assert one(spark, readers.json_path(text, "$.none")) is None
    assert one(spark, readers.csv_column(F.lit("a||c"), 2, delimiter="|")) is None
    (tmp_path / "f.csv").write_text("some words\n\nid,name\n1,a\n2,b\n")
    assert sorted(tuple(r) for r in readers.read_csv_after(spark, str(tmp_path), "id,name", "id int, name string").collect()) == [(1, "a"), (2, "b")]
