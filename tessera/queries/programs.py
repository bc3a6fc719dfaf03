"""Statements that act (tables, constraints, routines, cursors, COPY, streams) and DataFrame operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..database import Database
from ..operators import relational as rel
from ..plans.parser import SqlError
from ..sources import copy as cp
from ..streaming import windows


def _outcomes(spark: SparkSession, db: Database, *steps: str) -> DataFrame:
    """What each statement says: its command tag, or its SQLSTATE."""
    out = []
    for i, s in enumerate(steps):
        try:
            r = db.sql(s)
            out.append((i, r.first()[0] if r.columns == ["command"] else str(r.count())))
        except SqlError as e:
            out.append((i, e.state))
    return spark.createDataFrame(out, "step int, outcome string")


def dml_update_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database.over(spark, sf_dir)
    db.sql("create table c as select c_custkey, c_nationkey, c_acctbal, c_mktsegment from customer")
    db.sql("update c set c_acctbal = c_acctbal * 2, c_mktsegment = upper(c_mktsegment) || '!' where c_nationkey = 3")
    db.sql("delete from c where c_acctbal < 0")
    db.sql("insert into c select c_custkey + 1000000, c_nationkey, 0.0, 'NEW' from customer where c_nationkey = 5")
    return db.sql("select c_custkey, c_nationkey, round(c_acctbal, 4) as c_acctbal, c_mktsegment from c")


def dml_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark)
    db.sql("create table foo (id int, name text default 'none', twice int generated always as (id * 2) stored)")
    return db.sql("insert into foo (id) values (1), (2), (3) returning id, name, twice + 1 as t1")


def dml_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(
        spark, Database(spark),
        "create table t (id int primary key, code int unique, need text not null, amount int default 3 check (amount > 0), v varchar(3))",
        "insert into t values (1, 10, 'a', 5, 'abc')", "insert into t values (1, 11, 'b', 5, null)", "insert into t values (2, 10, 'b', 5, null)",
        "insert into t values (2, 12, null, 5, null)", "insert into t values (2, 12, 'b', -1, null)", "insert into t values (2, 12, 'b', 1, 'abcd')",
        "insert into t (id, code, need) values (2, null, 'c'), (3, null, 'd')", "update t set id = 1 where id = 2", "select * from t", "truncate t", "select * from t", "drop table t",
    )


def dml_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database.over(spark, sf_dir)
    db.sql("create table sales (id bigint, sold date, amount double precision) partition by range (sold)")
    db.sql("create table sales_early partition of sales for values from (minvalue) to ('1995-01-01')")
    db.sql("create table sales_late partition of sales for values from ('1995-01-01') to (maxvalue)")
    db.sql("insert into sales select o_orderkey, o_orderdate::date, o_totalprice from orders")
    return db.sql("select 'early' as part, count(*) as n, min(sold) as lo, max(sold) as hi from sales_early union all select 'late', count(*), min(sold), max(sold) from sales_late union all select 'all', count(*), min(sold), max(sold) from sales")


def dml_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark)
    db.sql("create table parent (a int check (a > 0), b text)")
    db.sql("create table child (c int) inherits (parent)")
    db.sql("insert into parent values (1, 'p')")
    db.sql("insert into child values (2, 'c', 9)")
    return db.sql("select a, b from parent")


def dml_transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark)
    db.sql("create table t (a int)")
    db.sql("insert into t values (1)")
    db.sql("begin")
    db.sql("insert into t values (2)")
    db.sql("rollback")
    db.sql("begin")
    db.sql("insert into t values (3)")
    db.sql("commit")
    return db.sql("select a from t")


def ddl_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark)
    db.sql("create type mood as enum ('sad', 'ok', 'happy')")
    db.sql("create table person (name text, m mood)")
    db.sql("insert into person values ('a', 'happy'), ('b', 'sad'), ('c', 'ok')")
    return db.sql("select name, m from person").select("name", "m", db.enum_rank("mood", "m").cast("int").alias("place"))


def ddl_view_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database.over(spark, sf_dir)
    db.sql("create sequence s start with 5 increment by 10")
    db.sql("create view v(region, n) as select n_regionkey, count(*) from nation group by n_regionkey")
    a, b = db.nextval("s"), db.nextval("s")
    return db.sql("select region, n from v").withColumn("a", F.lit(a)).withColumn("b", F.lit(b)).withColumn("c", F.lit(db.currval("s")))


def fn_sql_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database.over(spark, sf_dir)
    db.sql("create function taxed(price double precision, rate double precision) returns double precision language sql strict as 'select price * (1 + rate)'")
    db.sql("create function third(int) returns int return $1 / 3")
    return db.sql("select l_orderkey, l_linenumber, round(taxed(l_extendedprice, l_tax), 4) as t, third(l_linenumber + 5) as d, taxed(null, 1) is null as n from lineitem")


def expr_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of a query: numbers, text, a date and a NULL."""
    db = Database.over(spark, sf_dir, ["orders"])
    return db.query(
        "select o_orderkey, $3 || o_orderstatus as s, coalesce($4, o_custkey) + $1 as c from orders where o_totalprice > $2 and o_orderdate >= $5::date", [7, 250000.5, "is ", None, "1995-06-01"]
    )


def dml_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence as a default, over all rows of a query: each row gets a number of its own, none is left out."""
    db = Database.over(spark, sf_dir, ["customer"])
    db.sql("create table c (id bigserial primary key, k int not null)")
    db.sql("insert into c (k) values (-1), (-2)")
    db.sql("insert into c (k) select c_custkey from customer")
    db.sql("create sequence s start 100 increment 10")
    db.sql("select nextval('s') as n")
    numbered = db.sql("select nextval('s') as n, id, k from c")
    return spark.createDataFrame(
        [("rows", numbered.count()), ("ids", numbered.select("id").distinct().count()), ("least", numbered.agg(F.min("id")).first()[0]), ("most", numbered.agg(F.max("id")).first()[0])]
        + [("numbers", numbered.select("n").distinct().count()), ("from", numbered.agg(F.min("n")).first()[0]), ("to", numbered.agg(F.max("n")).first()[0]), ("last", db.currval("s"))],
        "what string, n bigint",
    )


def copy_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COPY with a header line in each file: the first line goes, whatever it says, and a row like it stays."""
    db = Database.over(spark, sf_dir, ["nation"])
    lines = db.query("select n_nationkey || E'\\t' || n_name as value from nation")
    head = spark.createDataFrame([("k\tname",)], "value string")
    folder = f"{db.folder}/headed"
    for i in range(3):
        part = lines.where(F.crc32("value") % 3 == i).unionAll(spark.createDataFrame([(f"{-i - 1}\tname",)], "value string"))
        ordered = head.withColumn("o", F.lit(0)).unionAll(part.withColumn("o", F.lit(1))).repartition(1).sortWithinPartitions("o")
        ordered.select("value").write.mode("append").text(folder)
    db.sql("create table t (k int, name text)")
    db.sql(f"copy t from '{folder}' with (header match)")
    db.sql(f"copy t (k, name) from stdin (format csv, header, delimiter ';')", ["other;words\n-9;\"a;b\"\n"])
    return db.sql("select k, name from t")


def prog_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database.over(spark, sf_dir)
    db.sql("prepare p (int, text) as select n_nationkey, n_name, $2 || n_name as x from nation where n_regionkey = $1")
    return db.sql("execute p(2, 'in ')")


def prog_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database.over(spark, sf_dir)
    db.sql("declare c cursor for select n_nationkey, n_name from nation order by n_nationkey")
    first, second = db.sql("fetch 3 from c"), db.sql("fetch forward 2 from c")
    back = db.sql("fetch backward 2 from c")
    return first.withColumn("step", F.lit(1)).unionAll(second.withColumn("step", F.lit(2))).unionAll(back.withColumn("step", F.lit(3)))


def prog_plpgsql(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database.over(spark, sf_dir)
    db.sql(
        """create function collatz(n int) returns int language plpgsql as $$
        declare steps int := 0; x int := n;
        begin
          while x <> 1 loop
            if x % 2 = 0 then x := x / 2; else x := 3 * x + 1; end if;
            steps := steps + 1;
            exit when steps > 500;
          end loop;
          return steps;
        end $$"""
    )
    db.sql(
        """create function total(lo int, hi int) returns int language plpgsql as $$
        declare s int := 0; c int;
        begin
          for i in lo..hi loop
            continue when i % 2 = 1;
            s := s + i;
          end loop;
          select count(*) into c from region;
          return s + c;
        end $$"""
    )
    return spark.createDataFrame([("collatz", int(db.call("collatz", 6))), ("total", int(db.call("total", 1, 10)))], "name string, value int")


def copy_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows through COPY's text format: written out, read back."""
    db = Database.over(spark, sf_dir)
    df = db.query("select n_nationkey, case when n_nationkey % 3 = 0 then null when n_nationkey % 3 = 1 then E'tab\\there' else E'back\\\\slash\\nline' end as v, n_name from nation")
    path = f"{db.folder}/copy"
    cp.copy_to(df, path)
    return cp.copy_from(spark, path, df.schema)


def copy_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database.over(spark, sf_dir)
    df = db.query("select n_nationkey, case when n_nationkey % 3 = 0 then null when n_nationkey % 3 = 1 then 'a,\"b\"' else '' end as v from nation")
    path = f"{db.folder}/csv"
    cp.copy_to(df, path, cp.CopyOptions(format="csv", header=True))
    schema = ST.StructType([*df.schema.fields, ST.StructField("extra", ST.IntegerType())])
    return cp.copy_from(spark, path, schema, cp.CopyOptions(format="csv", header=True, columns=("n_nationkey", "v"), defaults={"extra": 7}))


def df_not_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, supplier = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "supplier"))
    return rel.not_in(nation.select("n_nationkey"), "n_nationkey", supplier.where("s_acctbal > 5000").select("s_nationkey"))


def df_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the user's last event of another type up to then, over all events."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type <> 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("last_id"))
    return rel.as_of(left, right, "ts", ["user_id"]).select("event_id", F.col("r_last_id").alias("last_id"))


def df_salted_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, part = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "part"))
    joined = rel.salted_join(li.select(F.col("l_partkey").alias("k"), "l_quantity"), part.select(F.col("p_partkey").alias("k"), "p_size"), "k", 4)
    return joined.groupBy("p_size").agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"))


def df_distinct_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return rel.distinct_on(li, ["l_partkey"], [rel.order("l_extendedprice", desc=True), rel.order("l_orderkey"), rel.order("l_linenumber")])


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.drain(spark, windows.tumbling(windows.read_events(spark, f"{sf_dir}/events.parquet")))
    return out.select("bucket", "event_type", "n", F.round("total", 4).alias("total"))


def stream_running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.drain(spark, windows.running_totals(windows.read_events(spark, f"{sf_dir}/events.parquet")), "update")
    return out.groupBy("user_id").agg(F.max("n").alias("n"))


ALL = (
    expr_params, dml_sequence, copy_header,
    dml_update_delete, dml_returning, dml_constraints, dml_partitions, dml_inheritance, dml_transaction, ddl_enum, ddl_view_sequence, fn_sql_function, prog_prepared, prog_cursor, prog_plpgsql,
    copy_text, copy_csv, df_not_in, df_as_of, df_salted_join, df_distinct_on, stream_tumbling, stream_running_totals,
)

ORACLE = {
    "expr_params": "select o_orderkey, 'is ' || o_orderstatus as s, o_custkey + 7 as c from orders where o_totalprice > 250000.5 and o_orderdate >= date '1995-06-01'",
    "dml_sequence": """with n as (select count(*) + 2 as n from customer) select * from (select 'rows' as what, n from n union all select 'ids', n from n union all select 'least', 1 union all select 'most', n from n
        union all select 'numbers', n from n union all select 'from', 110 union all select 'to', 100 + 10 * n from n union all select 'last', 100 + 10 * n from n)""",
    "copy_header": "select n_nationkey as k, n_name as name from nation union all select * from (values (-1, 'name'), (-2, 'name'), (-3, 'name'), (-9, 'a;b'))",
    "dml_update_delete": """with u as (select c_custkey, c_nationkey, case when c_nationkey = 3 then c_acctbal * 2 else c_acctbal end as c_acctbal, case when c_nationkey = 3 then upper(c_mktsegment) || '!' else c_mktsegment end as c_mktsegment from customer)
        select c_custkey, c_nationkey, round(c_acctbal, 4) as c_acctbal, c_mktsegment from u where c_acctbal >= 0 union all select c_custkey + 1000000, c_nationkey, 0.0, 'NEW' from customer where c_nationkey = 5""",
    "dml_returning": "select i as id, 'none' as name, 2 * i + 1 as t1 from (values (1), (2), (3)) t(i)",
    "dml_constraints": "select * from (values " + ", ".join(f"({i}, '{s}')" for i, s in enumerate(["CREATE TABLE", "INSERT 0 1", "23505", "23505", "23502", "23514", "22001", "INSERT 0 2", "23505", "3", "TRUNCATE TABLE", "0", "DROP TABLE"])) + ") t(step, outcome)",
    "dml_partitions": """with s as (select o_orderdate::date as d from orders) select 'early' as part, count(*) as n, min(d) as lo, max(d) as hi from s where d < date '1995-01-01' union all
        select 'late', count(*), min(d), max(d) from s where d >= date '1995-01-01' union all select 'all', count(*), min(d), max(d) from s""",
    "dml_inheritance": "select * from (values (1, 'p'), (2, 'c')) t(a, b)",
    "dml_transaction": "select * from (values (1), (3)) t(a)",
    "ddl_enum": "select * from (values ('a', 'happy', 3), ('b', 'sad', 1), ('c', 'ok', 2)) t(name, m, place)",
    "ddl_view_sequence": "select n_regionkey as region, count(*) as n, 5 as a, 15 as b, 15 as c from nation group by n_regionkey",
    "fn_sql_function": "select l_orderkey, l_linenumber, round(l_extendedprice * (1 + l_tax), 4) as t, (l_linenumber + 5) // 3 as d, true as n from lineitem",
    "prog_prepared": "select n_nationkey, n_name, 'in ' || n_name as x from nation where n_regionkey = 2",
    "prog_cursor": "select n_nationkey, n_name, 1 as step from nation where n_nationkey < 3 union all select n_nationkey, n_name, 2 from nation where n_nationkey in (3, 4) union all select n_nationkey, n_name, 3 from nation where n_nationkey in (3, 2)",
    "prog_plpgsql": "select * from (values ('collatz', 8), ('total', 35)) t(name, value)",
    "copy_text": "select n_nationkey, case when n_nationkey % 3 = 0 then null when n_nationkey % 3 = 1 then 'tab' || chr(9) || 'here' else 'back' || chr(92) || 'slash' || chr(10) || 'line' end as v, n_name from nation",
    "copy_csv": "select n_nationkey, case when n_nationkey % 3 = 0 then null when n_nationkey % 3 = 1 then 'a,\"b\"' else '' end as v, 7 as extra from nation",
    "df_not_in": "select n_nationkey from nation where n_nationkey not in (select s_nationkey from supplier where s_acctbal > 5000)",
    "df_as_of": """with r as (select user_id, ts, max(event_id) as last_id from events where event_type <> 'purchase' group by user_id, ts)
        select l.event_id, r.last_id from (select event_id, user_id, ts from events where event_type = 'purchase') l asof left join r on l.user_id = r.user_id and l.ts >= r.ts""",
    "df_salted_join": "select p_size, sum(l_quantity) as q, count(*) as n from lineitem join part on l_partkey = p_partkey group by p_size",
    "df_distinct_on": "select distinct on (l_partkey) l_partkey, l_orderkey, l_linenumber, l_extendedprice from lineitem order by l_partkey, l_extendedprice desc, l_orderkey, l_linenumber",
    "stream_tumbling": "select cast(date_trunc('hour', ts) as timestamp) as bucket, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "stream_running_totals": "select user_id, count(*) as n from events group by user_id",
}


def queries() -> dict:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict:
    return dict(ORACLE)
