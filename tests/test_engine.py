"""Errors, plans and library functions without a query of their own."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.database import Database
from tessera.functions import geo as g
from tessera.functions import jsonpath, textsearch, udfs
from tessera.operators import relational as rel
from tessera.plans import patterns
from tessera.plans.parser import SqlError, parse_query
from tessera.sources import copy as cp
from tessera.sources import parquet
from tessera.types import common_type


@pytest.fixture(scope="module")
def db(spark):
    return Database.over(spark, "/root/testdata/sf0.001")


@pytest.mark.parametrize(
    ("text", "state"),
    [
        ("select 1 +", "42601"), ("selec 1", "42601"), ("select nosuch(1)", "42883"), ("select $1", "42P02"), ("select 'a'::nosuch", "42704"),
        ("with a as (select 1), a as (select 2) select * from a", "42712"), ("select distinct on (n_name) n_name from nation order by n_regionkey, n_name", "42P10"),
        ("insert into nosuch values (1)", "42P01"), ("fetch from nosuch", "34000"), ("execute nosuch", "26000"), ("select min(true)", "42883"), ("select 1 limit -1", "2201W"),
    ],
)
def test_errors(db, text, state):
    with pytest.raises(SqlError) as e:
        db.sql(text)
    assert e.value.state == state


def test_failed_insert_changes_nothing(spark):
    db = Database(spark)
    db.sql("create table t (a int unique)")
    db.sql("insert into t values (1)")
    with pytest.raises(SqlError):
        db.sql("insert into t values (2), (1)")
    assert [r.a for r in db.sql("select a from t").collect()] == [1]
    db.sql("create table p (k int) partition by range (k)")
    db.sql("create table p1 partition of p for values from (0) to (10)")
    with pytest.raises(SqlError) as e:
        db.sql("insert into p values (5), (50)")
    assert e.value.state == "23514" and db.sql("select k from p").count() == 0
    db.sql("insert into p values (5), (7)")
    db.sql("update p set k = 6 where k = 5")
    assert sorted(r.k for r in db.sql("select k from p1").collect()) == [6, 7]


def test_division_errors(db):
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        db.sql("select n_nationkey / 0 from nation").collect()


def test_pushdown_and_pruning(db):
    plan = db.explain("select l_orderkey from lineitem where l_quantity > 49")
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,49" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
    assert "BroadcastNestedLoopJoin" not in db.explain("select count(*) from lineitem, part where (p_partkey = l_partkey and p_size < 3) or (p_partkey = l_partkey and p_size > 40)")


def test_explain_show_settings(db):
    assert db.sql("explain select 1").count() > 3
    db.sql("set datestyle = 'ISO'")
    assert db.sql("show datestyle").first()[0] == "ISO"


def test_raise_and_notices(spark):
    db = Database(spark)
    db.sql("create function f(n int) returns int language plpgsql as $$ begin if n > 2 then raise exception 'too big: %', n; end if; <<outer>> loop loop n := n + 1; exit outer when n > 5; end loop; end loop; return n; end $$")
    assert db.call("f", 1) == 6
    with pytest.raises(SqlError, match="too big: 3"):
        db.call("f", 3)


def test_sequences(spark):
    db = Database(spark)
    db.sql("create sequence s")
    with pytest.raises(SqlError):
        db.currval("s")
    assert [db.nextval("s"), db.nextval("s"), db.setval("s", 10), db.nextval("s")] == [1, 2, 10, 11]
    db.sql("create table t (id serial, v text)")
    db.sql("insert into t (v) values ('a')")
    db.sql("insert into t (v) values ('b')")
    assert sorted((r.id, r.v) for r in db.sql("select * from t").collect()) == [(1, "a"), (2, "b")]


def test_generated_virtual_and_alter(spark):
    db = Database(spark)
    db.sql("create table t (a int, s int generated always as (a * 2) stored, v text generated always as (a || 'x') virtual)")
    db.sql("insert into t (a) values (1), (2)")
    assert sorted(map(tuple, db.sql("select a, s, v from t").collect())) == [(1, 2, "1x"), (2, 4, "2x")]
    db.sql("alter table t add constraint u unique (a)")
    with pytest.raises(SqlError):
        db.sql("insert into t (a) values (2)")
    with pytest.raises(SqlError) as e:
        db.sql("insert into t (a, s) values (3, 1)")
    assert e.value.state == "428C9"


def test_copy_into_table(spark, tmp_path):
    (tmp_path / "x.txt").write_text("1\ta\\tb\n2\t\\N\n\\.\n")
    (tmp_path / "x.csv").write_text('a,b\n1,"x, ""y"""\n2,\n3,""\n')
    db = Database(spark)
    db.sql("create table t (a int, b text, c int default 7)")
    assert db.copy("t", str(tmp_path / "x.txt"), cp.CopyOptions(columns=("a", "b"))) == 2
    assert db.copy("t", str(tmp_path / "x.csv"), cp.CopyOptions(format="csv", header=True, columns=("a", "b"))) == 3
    got = sorted((r.a, r.b or "", r.b is None, r.c) for r in db.sql("select * from t").collect())
    assert got == [(1, "a\tb", False, 7), (1, 'x, "y"', False, 7), (2, "", True, 7), (2, "", True, 7), (3, "", False, 7)]
    with pytest.raises(cp.CopyError):
        cp.CopyOptions(format="xml").check()
    (tmp_path / "bad.txt").write_text("1\n")
    with pytest.raises(Exception, match="COPY line"):
        db.copy("t", str(tmp_path / "bad.txt"), cp.CopyOptions(columns=("a", "b")))


def test_parquet_round_trip(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("k"))
    parquet.write(df, str(tmp_path / "t"), ["k", "id"])
    assert parquet.scan(spark, str(tmp_path / "t"), ["id"], F.col("k") == 1).count() == 33
    assert parquet.append([df, df.withColumn("more", F.lit(1))]).columns == ["id", "k"]


def test_operators(spark):
    a, b = spark.range(3).toDF("k"), spark.createDataFrame([(2.5,), (None,)], "k double")
    assert rel.union([a, b]).schema[0].dataType.simpleString() == "double"
    assert rel.not_in(a, "k", b.select(F.col("k").cast("long").alias("v"))).count() == 0
    assert rel.generate_series(spark, 5, 1, -2).count() == 3
    assert rel.lockstep(spark.range(1), x=F.array(F.lit(1), F.lit(2)), y=F.array(F.lit(3))).collect()[1].y is None
    assert common_type("int", "decimal(5,2)") == "decimal(22,2)"
    with pytest.raises(TypeError):
        common_type("int", "string")


def test_patterns():
    assert patterns.parse_interval("1 year 2 mons -3 days 04:05:06.7") == (14, -3, 14706700000)
    assert patterns.parse_interval("P1Y2M3DT4H") == (14, 3, 14400000000)
    assert patterns.parse_interval("1.5 months ago") == (-1, -15, 0)
    assert patterns.parse_interval("3", ("day",)) == (0, 3, 0)
    assert patterns.java(r"[[:alpha:]]\mx") == r"[\p{Alpha}]\b(?=\w)x"
    with pytest.raises(ValueError):
        patterns.parse_interval("3 parsecs")
    assert parse_query("select 1 -- c\n /* d */")["kind"] == "query"


DOC = {"a": [1, 2, {"b": "xyz"}], "n": None, "s": "hello", "t": True, "deep": {"x": {"y": 5}}}


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("$.a[0]", [1]), ("$.a[0 to 1]", [1, 2]), ("$.a[last].b", ["xyz"]), ("$.a[*] ? (@ > 1)", [2]), ("$.deep.**.y", [5]), ("$.deep.**{2}", [5]), ("$.*.x", [{"y": 5}]), ("strict $.deep.x.y", [5]),
        ("$.a.size()", [3]), ("$.s.type()", ["string"]), ("-$.a[1]", [-2]), ("$.a[0] + $.a[1] * 3", [7]), ('$.s ? (@ like_regex "^HE" flag "i")', ["hello"]), ('$.s ? (@ starts with "he")', ["hello"]), ("$ ? (exists(@.n)).t", [True]),
        ("$.missing", []), ("$.a[*] ? ((@ > 1) is unknown)", [{"b": "xyz"}]), ("$.a[*].b ? (@ == \"xyz\" && !(@ == \"q\"))", ["xyz"]), ("$.deep.keyvalue().key", ["x"]), ("(7.5).floor()", [7]), ("$.t == true", [True]),
    ],
)
def test_jsonpath(path, want):
    assert jsonpath.query(DOC, path) == want


def test_jsonpath_errors():
    with pytest.raises(jsonpath.JsonPathError):
        jsonpath.query(DOC, "strict $.missing")
    assert jsonpath.query(DOC, "strict $.missing", silent=True) == []
    with pytest.raises(jsonpath.JsonPathError):
        jsonpath.query(DOC, "$.a[")
    assert jsonpath.query({"v": 3}, "$.v > $lo", {"lo": 2}) == [True]
    assert udfs.jsonb_canonical('{"bb": 1, "a": 2, "a": 3.0}') == '{"a": 3, "bb": 1}'


def test_text_templates():
    t = dt.datetime(2024, 3, 5, 0, 5, 6, 7000)
    assert udfs.to_char_time(t, "HH12:MI am Q J IW") == "12:05 am 1 2460375 10"
    assert udfs.to_char_number("-1234.567", "9,999.99") == "-1,234.57"
    assert udfs.to_char_number("5", "999PR") == "   5 "
    assert udfs.to_char_number("12345", "999") == " ###"
    assert udfs.to_number("-1,234.5", "9G999D9") == "-1234.5"
    assert udfs.inet_op("<<", "10.1.2.3", "10.0.0.0/8") == "t" and udfs.inet_op("+", "10.0.0.255", "1") == "10.0.1.0" and udfs.inet_op("&", "10.1.2.3", "255.255.0.0") == "10.1.0.0"
    with pytest.raises(ValueError, match="too few"):
        udfs.fmt("%s %s", ["a"])


def test_text_search_queries():
    assert textsearch.show(textsearch.parse_query("a & (b | !c)")) == "'a' & ( 'b' | !'c' )"
    assert textsearch.query_tree("a & !b") == "'a'" and textsearch.query_tree("!a") == "T"
    assert textsearch.phrase("a", "b", 3) == "'a' <3> 'b'" and textsearch.n_nodes("a & b | c") == 5
    with pytest.raises(ValueError):
        textsearch.parse_query("a &")


def test_vectors(spark):
    v = textsearch.vector("a:1A b:2 c:3B")
    row = spark.range(1).select(
        textsearch.to_array(textsearch.keep_weights(v, ["A", "B"])).alias("k"), textsearch.matches(textsearch.concat(v, textsearch.vector("d:1")), "c <-> d").alias("joined"),
        textsearch.matches(textsearch.set_weight(v, "C", ["b"]), "b:C").alias("w"), textsearch.length(textsearch.strip(v)).alias("n"),
    ).first()
    assert tuple(row) == (["a", "c"], True, True, 3)


def test_geometry(spark):
    square = g.polygon(F.array(g.point(0, 0), g.point(0, 2), g.point(2, 2), g.point(2, 0)))
    inner = g.polygon(F.array(g.point(0.5, 0.5), g.point(0.5, 1), g.point(1, 1)))
    row = spark.range(1).select(
        g.polygon_contains(square, inner).alias("a"), g.polygon_contains(inner, square).alias("b"), g.polygon_overlaps(square, inner).alias("c"), g.circle_contains(g.circle(g.point(0, 0), 3), g.circle(g.point(1, 0), 1)).alias("d"),
        g.line_distance(g.line(g.point(0, 0), g.point(1, 0)), g.line(g.point(0, 3), g.point(1, 3))).alias("e"), g.lseg_distance(g.lseg(g.point(0, 0), g.point(1, 0)), g.lseg(g.point(0, 2), g.point(5, 2))).alias("f"),
        g.path_contains_point(g.path(square["points"]), g.point(1, 1)).alias("h"), g.point_box_distance(g.point(5, 1), g.box(g.point(0, 0), g.point(2, 2))).alias("i"), g.n_points(g.circle_polygon(g.circle(g.point(0, 0), 1))).alias("j"),
        g.lseg_parallel(g.lseg(g.point(0, 0), g.point(1, 1)), g.lseg(g.point(5, 5), g.point(7, 7))).alias("k"), g.point_div(g.point(1, 0), g.point(0, 1))["y"].alias("l"),
    ).first()
    assert tuple(row) == (True, False, True, True, 3.0, 2.0, True, 3.0, 12, True, -1.0)
