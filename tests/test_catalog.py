import pytest
from pyspark.sql import functions as F

from semafold.operators import policy
from semafold.operators.joins import lookup, lookup_each
from semafold.plans.catalog import Catalog, Model, Unanswered
from semafold.sources import sinks


@pytest.fixture
def films(spark):
    films = spark.createDataFrame([(1, "A", 7), (2, "B", 8), (3, "C", None)], "id int, title string, director int")
    directors = spark.createDataFrame([(7, "Dee", 70)], "id int, name string, country int")
    countries = spark.createDataFrame([(70, "NZ")], "id int, name string")
    return Catalog([
        Model("Film", films, {"id": "FilmId", "title": "Title", "director": "DirectorId"}, "FilmId", unique=True),
        Model("Director", directors, {"id": "DirectorId", "name": "DirectorName", "country": "CountryId"}, "DirectorId", unique=True),
        Model("Country", countries, {"id": "CountryId", "name": "CountryName"}, "CountryId", unique=True),
    ])


def test_types_are_looked_up_in_chains_and_rows_stay(films):
    got = films.find("Film").project({"t": "Title", "who": {"name": "DirectorName", "from": "CountryName"}, "x": "Unknown"}).orderBy("t").collect()
    assert [(r.t, r.who["name"], r.who["from"], r.x) for r in got] == [("A", "Dee", "NZ", None), ("B", None, None, None), ("C", None, None, None)]


def test_criteria_need_one_column(films):
    assert films.find("Film").where("Title", "==", "B").frame.count() == 1
    with pytest.raises(ValueError):
        films.find("Film").where("CountryName", "==", "NZ")
    with pytest.raises(KeyError):
        films.find("Actor")


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    spark.range(10).select(F.col("id"), F.lit("x").alias("a"), F.lit("y").alias("b")).write.parquet(str(tmp_path / "t"))
    rows = Catalog([Model("T", spark.read.parquet(str(tmp_path / "t")), {"id": "Id", "a": "A", "b": "B"}, "Id")]).find("T")
    plan = rows.where("Id", "==", 3).project({"a": "A"})._jdf.queryExecution().toString()
    assert "EqualTo(id,3)" in plan and "ReadSchema: struct<id:bigint,a:string>" in plan


def test_subtypes_and_ambiguity(spark):
    a = Model("NZ", spark.createDataFrame([(1, "x")], "i int, n string"), {"i": "PersonId", "n": "Name"})
    b = Model("AU", spark.createDataFrame([(2, "y")], "k int, m string"), {"k": "PersonId", "m": "Name"})
    both = Catalog([a, b]).inherits("NZ", "Person").inherits("AU", "Person")
    assert sorted(map(tuple, both.find("Person").frame.collect())) == [(1, "x"), (2, "y")]
    assert both.find("Person", first_source=True).frame.count() == 1
    pair = Catalog([Model("P", a.frame, {"i": "N", "n": "N"})])
    assert pair.find("P").project({"n": "N"}).first().n is None


def test_strict_projections_raise(films):
    rows = films.find("Film")
    assert rows.project({"t": "Title", "c": "CountryName"}, strict=True).count() == 3
    with pytest.raises(Unanswered):
        rows.project({"t": "Title", "x": "Titel"}, strict=True)
    twice = Catalog([Model("P", rows.frame, {"id": "N", "director": "N"})]).find("P")
    with pytest.raises(Unanswered):
        twice.project({"n": "N"}, strict=True)
    assert twice.project({"n": "N"}).dtypes == [("n", "int")]  # null of the type's kind


def test_an_ambiguous_key_is_no_key(spark, films):
    two = spark.createDataFrame([(7, 8)], "main int, second int")
    rows = films.add(Model("Pair", two, {"main": "DirectorId", "second": "DirectorId"})).find("Pair")
    assert rows.project({"n": "DirectorName"}).first().n is None


def test_rows_stay_where_a_key_repeats(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "k int, v string")
    c = Catalog([Model("L", left, {"k": "K"}), Model("R", right, {"k": "K", "v": "V"}, "K")])
    assert sorted(map(tuple, c.find("L").project({"k": "K", "v": "V"}).collect())) == [(1, "a"), (2, "c")]


def test_sources_that_can_answer(spark):
    a = spark.createDataFrame([(1, "x", 5), (2, "y", 6)], "i int, n string, s int")
    b = spark.createDataFrame([(3, "x")], "k int, m string")
    c = Catalog([Model("A", a, {"i": "Id", "n": "Name", "s": "Size"}), Model("B", b, {"k": "Id", "m": "Name"}, operators=frozenset({"=="}))]).inherits("A", "P").inherits("B", "P")
    assert sorted(map(tuple, c.find("P").frame.select("Id", "Size").collect())) == [(1, 5), (2, 6), (3, None)]
    assert sorted(r.Id for r in c.find("P", where=[("Name", "==", "x")]).frame.collect()) == [1, 3]
    assert [r.i for r in c.find("P", where=[("Size", ">", 5)]).frame.collect()] == [2]  # B has no size
    assert [r.i for r in c.find("P", where=[("Name", "!=", "x")]).frame.collect()] == [2]  # B can't filter by !=
    with pytest.raises(KeyError):
        c.find("B", where=[("Name", "!=", "x")])


def test_composite_and_computed_keys(spark):
    left = spark.createDataFrame([(1, 1, "10"), (1, 2, "20"), (2, 1, "x")], "o int, l int, code string")
    right = spark.createDataFrame([(1, 2, "b"), (2, 1, "c")], "o int, l int, v string")
    codes = spark.createDataFrame([(10, "ten")], "n int, w string")
    c = Catalog([Model("L", left, {"o": "Order", "l": "Line", "code": "Code"}), Model("R", right, {"o": "Order", "l": "Line", "v": "V"}, ("Order", "Line")), Model("W", codes, {"n": "Number", "w": "Word"}, "Number")])
    c.expression("Number", ("Code",), lambda x: x.try_cast("int"))
    got = c.find("L").project({"o": "Order", "l": "Line", "v": "V", "w": "Word"}).collect()
    assert sorted(map(tuple, got), key=str) == [(1, 1, None, "ten"), (1, 2, "b", None), (2, 1, "c", None)]
    assert Catalog(c.models[1:]).add(Model("O", left, {"o": "Order"})).find("O").project({"v": "V"}).first().v is None  # one of two keys


def test_closed_types_and_formats(spark, films):
    rows = films.find("Film")
    assert rows.frame.select(rows.build("Film").alias("x")).first().x.title == "A"
    films.close("Film").declare_format("Base", "csv").inherits("Film", "Base")
    assert rows.frame.select(rows.build("Film").alias("x")).first().x is None
    assert films.format_of("Film") == "csv" and films.format_of("Country") is None


def test_first_match_and_arrays(spark):
    left = spark.createDataFrame([(1, [2, 9, 1]), (2, [])], "k int, ids array<int>")
    right = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, "c", 1)], "k int, v string, o int")
    assert sorted((r.k, r.v) for r in lookup(left.select("k"), right, {"k": "k"}, order=["o"]).select(left["k"], "v").collect()) == [(1, "a"), (2, "c")]
    names = spark.createDataFrame([(1, "one"), (2, "two")], "i int, n string")
    got = {r.k: [x.n for x in r.rows] for r in lookup_each(left, "ids", names, "i", "k", "rows").collect()}
    assert got == {1: ["two", "one"], 2: []}


def test_policies(spark):
    df = spark.createDataFrame([("d1", 5), ("d2", 6)], "desk string, amount int")
    assert [r.amount for r in policy.filter_fields(df, ["amount"], unless=F.col("desk") == "d1").collect()] == [5, None]
    assert [tuple(r) for r in policy.filter_all(df).distinct().collect()] == [(None, None)]
    assert {r.desk for r in policy.mask(df, ["desk"]).collect()} == {"******"}


def test_upsert_and_view(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string")
    assert sorted(map(tuple, sinks.upsert(now, new, "k").collect())) == [(1, "a"), (2, "B"), (3, "c")]
    sinks.recreate_behind_view(now, "v_now")
    assert sinks.recreate_behind_view(new, "v_now").count() == spark.table("v_now").count() == 2
    assert sinks.ddl(now, "t", "k") == "CREATE TABLE IF NOT EXISTS t (k INTEGER, v VARCHAR, PRIMARY KEY (k))"
