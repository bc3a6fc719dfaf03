"""The queries over whole tables: rows that an id bound would leave out, by plain Python."""

import pandas as pd
import pytest

from tessera import queries as registered

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLE = registered.queries(), registered.oracle_sql()


def table(name):
    return pd.read_parquet(f"{FOLDER}/{name}.parquet")


def rows(spark, name):
    return sorted(map(tuple, QUERIES[name](spark, FOLDER).collect()), key=str)


@pytest.mark.parametrize("name, of, key", [
    ("expr_case", "lineitem", ["l_orderkey", "l_linenumber"]), ("expr_like", "part", ["p_partkey"]), ("join_lateral", "customer", ["c_custkey"]),
    ("win_ranking", "orders", ["o_orderkey"]), ("win_frame_rows", "orders", ["o_orderkey"]), ("win_lag_lead", "orders", ["o_orderkey"]),
])
def test_every_row_is_read(spark, name, of, key):
    got = QUERIES[name](spark, FOLDER).select(*key).collect()
    assert sorted(map(tuple, got)) == sorted(table(of)[key].itertuples(index=False, name=None))


def test_joins_and_sets_of_whole_tables(spark):
    c, s, p = table("customer").c_nationkey.tolist(), table("supplier").s_nationkey.tolist(), table("part").p_size.tolist()
    full = [(x, y) for x in c for y in s if x == y] + [(x, None) for x in c if x not in s] + [(None, y) for y in s if y not in c]
    assert rows(spark, "join_full") == sorted(full, key=str)
    assert rows(spark, "join_theta") == [(sum(x < y for x in p for y in p),)]
    nations = set(table("nation").n_nationkey)
    assert rows(spark, "set_intersect_except") == sorted([(k,) for k in nations & set(c)] + [(k,) for k in nations - set(c)], key=str)


def test_correlated_over_whole_lineitem(spark):
    li = table("lineitem")
    mean = li.groupby("l_partkey").l_quantity.mean()
    want = [(r.l_orderkey, r.l_linenumber) for r in li.itertuples() if r.l_quantity > 1.5 * mean[r.l_partkey]]
    assert rows(spark, "sub_correlated_agg") == sorted(want, key=str)


def test_as_of_over_all_events(spark):
    events = list(table("events").sort_values("ts").itertuples())
    want = []
    for e in (e for e in events if e.event_type == "purchase"):
        before = [o.event_id for o in events if o.event_type != "purchase" and o.user_id == e.user_id and o.ts <= e.ts]
        want.append((e.event_id, before[-1] if before else None))
    assert rows(spark, "df_as_of") == sorted(want, key=str)


def test_sql_functions_over_whole_lineitem(spark):
    got = QUERIES["fn_sql_function"](spark, FOLDER).select("l_orderkey", "l_linenumber", "d").collect()
    assert sorted(map(tuple, got)) == sorted((r.l_orderkey, r.l_linenumber, (r.l_linenumber + 5) // 3) for r in table("lineitem").itertuples())


@pytest.mark.parametrize("name, of, key", [("fn_text_case", "part", "p_partkey"), *((f"fn_time_{x}", "events", "event_id") for x in ("extract", "extract_seconds", "trunc", "bin"))])
def test_functions_read_every_row(spark, name, of, key):
    assert sorted(r[key] for r in QUERIES[name](spark, FOLDER).select(key).collect()) == sorted(table(of)[key])


def test_text_bound_is_gone():
    """sf0.001 has no part beyond the bound."""
    assert "p_partkey <" not in ORACLE["fn_text_case"]


@pytest.mark.parametrize("op", ["<", "<=", ">", ">="])
def test_counts_by_order_make_no_pairs(spark, op):
    """NULLs, values of one side only, either order of the sides, and values in several ranges."""
    import operator

    from tessera.database import Database

    test = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}[op]
    db = Database.over(spark, FOLDER, [])
    x, y = [None if i % 11 == 0 else i * 7 % 401 for i in range(600)], [None if i % 13 == 0 else i * 5 % 307 - 20 for i in range(500)]
    spark.createDataFrame([(v,) for v in x], "x int").createOrReplaceTempView("order_left")
    spark.createDataFrame([(v,) for v in y], "y int").createOrReplaceTempView("order_right")
    want = sum(test(v, w) for v in x if v is not None for w in y if w is not None)
    text = f"select count(*) as n from order_left join order_right on x {op} y"
    assert [tuple(r) for r in db.query(text).collect()] == [(want,)]
    assert [tuple(r) for r in db.query(f"select count(*) as n from order_right b, order_left a where a.x {op} b.y").collect()] == [(want,)]
    assert [tuple(r) for r in db.query(text.replace("order_left", "(select x from order_left where x < 0) l")).collect()] == [(0,)]
    assert "NestedLoop" not in db.query(text)._jdf.queryExecution().toString()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert [tuple(r) for r in db.query(text).collect()] == [(want,)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("text", [
    "select a.k as ak, b.k as bk, v, w from full_left a full join full_right b on a.k = b.k",
    "select a.k as ak, b.k as bk, v, w from full_right b full join full_left a on a.k = b.k and v <> w",
    "select a.k as ak, b.k as bk, v, w from full_left a full join full_right b on a.k = b.k where coalesce(v, 0) < 7",
    "select a.k as ak, b.k as bk, v, w from full_left a full join (select k, w from full_right where w < 0) b on a.k = b.k",
])
def test_full_join_streams_its_pairs(spark, text):
    """NULL keys, rows of one side only, and an empty side; the plan holds no full join."""
    import duckdb

    from tessera.database import Database

    db, con = Database.over(spark, FOLDER, []), duckdb.connect()
    for name, n, m, v in (("full_left", 60, 7, "v"), ("full_right", 50, 9, "w")):
        df = pd.DataFrame({"k": pd.array([None if i % 10 == 0 else i % m + (m == 9) for i in range(n)], "Int32"), v: pd.array([i % 12 for i in range(n)], "Int32")})
        spark.createDataFrame([tuple(None if x is pd.NA else int(x) for x in r) for r in df.itertuples(index=False)], f"k int, {v} int").createOrReplaceTempView(name)
        con.register(name, df)
    got = db.query(text)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(con.execute(text).fetchall(), key=str)
    assert "FullOuter" not in got._jdf.queryExecution().toString()


def test_salted_join_does_not_broadcast_its_copies(spark):
    from tessera.operators import relational as rel

    left = spark.range(2000).selectExpr("if(id % 2 = 0, 7, id % 50) as k", "id as v")
    right = spark.range(60).selectExpr("id as k", "id * 3 as w").unionAll(spark.range(5).selectExpr("7L as k", "-1L as w"))
    got = rel.salted_join(left, right, "k", 4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" not in plan
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right, "k").collect()))
