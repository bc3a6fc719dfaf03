"""Types that Spark lacks, sequences, JSON paths and errors through the engine's own session settings."""

import pytest

from tessera.database import Database
from tessera.plans.parser import SqlError
from tessera.session import SETTINGS


@pytest.fixture(scope="module")
def db(spark):
    """A session with the settings of session.create, which differ from those of the other tests."""
    own = spark.newSession()
    for k, v in SETTINGS.items():
        if k.startswith("spark.sql."):
            own.conf.set(k, v)
    yield Database(own)


def one(db, text, *args):
    return tuple(db.sql(text, *args).first())


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("select interval '1 month' > interval '29 days', interval '30 days' = interval '1 month', interval '1 day' < '25 hours'", (True, True, True)),
        ("select interval '1 mon 2 days' * 2, interval '1 day' / 2, - interval '1 day', interval '1 hour' + interval '30 minutes'", ("2 mons 4 days", "12:00:00", "-1 days", "01:30:00")),
        ("select make_interval(1, 2, 0, 3, 4, 5, 6.5), justify_days(interval '35 days'), justify_interval(interval '1 mon -1 hour')", ("1 year 2 mons 3 days 04:05:06.5", "1 mon 5 days", "29 days 23:00:00")),
        ("select age(timestamp '2024-03-01', timestamp '2023-01-15'), timestamp '2024-03-01' - timestamp '2024-02-01 12:00'", ("1 year 1 mon 17 days", "28 days 12:00:00")),
        ("select '12:00'::time + interval '1 hour', time '00:30' - interval '1 hour', time '10:30' - time '08:00', make_time(8, 15, 23.5)", ("13:00:00", "23:30:00", "02:30:00", "08:15:23.5")),
        ("select time '10:00' between '09:00' and '11:00', time '10:00' in ('10:00', '12:00'), '10:00' < time '09:00', null::time is null", (True, True, False, True)),
        ("select extract(epoch from interval '1 day 2 hours')::int, date_part('hour', time '10:30')::int, extract(month from interval '1 year 3 mons')::int", (93600, 10, 3)),
        ("select '$12.34'::money, '$1,000.50'::money * 2, '-$3'::money, '($3)'::money, cash_words('$21.01'::money), '$10'::money / '$4'::money", ("$12.34", "$2,001.00", "-$3.00", "-$3.00", "Twenty one dollars and one cent", 2.5)),
        ("select inet '192.168.1.5/24' << cidr '192.168.0.0/16', inet '10.0.0.255' + 1, abbrev(cidr '10.1.0.0/16'), host(inet '10.1.2.3/8'), network(inet '10.1.2.3/8')", (True, "10.0.1.0", "10.1/16", "10.1.2.3", "10.0.0.0/8")),
        ("select inet_same_family(inet '1.2.3.4', inet '::1'), inet_merge(inet '192.168.1.5/24', inet '192.168.2.5/24'), inet '1.2.3.4' < inet '1.2.3.10', ~ inet '0.0.0.255'", (False, "192.168.0.0/22", True, "255.255.255.0")),
        ("select macaddr '08-00-2B-01-02-03', trunc(macaddr '08:00:2b:01:02:03'), '08:00:2b:01:02:03'::macaddr::macaddr8, macaddr8_set7bit('00:34:56:ab:cd:ef'::macaddr8)", ("08:00:2b:01:02:03", "08:00:2b:00:00:00", "08:00:2b:ff:fe:01:02:03", "02:34:56:ff:fe:ab:cd:ef")),
        ("select pg_lsn '16/B374D848', ('0/10'::pg_lsn - '0/1'::pg_lsn)::int, '0/10'::pg_lsn + 16", ("16/B374D848", 15, "0/20")),
        ("select point '(1,2)', lseg '[(0,0),(1,1)]', box '(0,0),(2,1)', path '[(0,0),(1.5,1)]', polygon '((0,0),(1,1))', circle '<(1,2),3>', line '{1,-1,0}'", ("(1,2)", "[(0,0),(1,1)]", "(2,1),(0,0)", "[(0,0),(1.5,1)]", "((0,0),(1,1))", "<(1,2),3>", "{1,-1,0}")),
        ("select lseg '[(0,0),(2,0)]' ## lseg '[(1,1),(1,3)]', line '{0,-1,5}' ## lseg '[(0,0),(3,1)]', lseg '[(5,5),(6,9)]' ## box '(0,0),(2,2)', point '(5,1)' ## box '(0,0),(2,2)'", ("(1,1)", "(3,1)", "(2,2)", "(2,1)")),
        ("select circle '<(0,0),1>' |>> circle '<(0,-5),1>', polygon '((0,0),(0,1),(1,1))' &<| polygon '((0,0),(0,2),(2,2))', path '((0,0),(1,0))' = path '((5,5),(9,9))', path '[(0,0),(2,0)]' * point '(0,1)'", (True, True, True, "[(0,0),(0,2)]")),
        ("select 'fat:2A cat:3'::tsvector @@ 'cat & fat'::tsquery, 'a b'::tsvector || 'c'::tsvector, 'a'::tsquery && 'b'::tsquery, !! 'a'::tsquery, 'a:1 b:2'::tsvector @@ ('a'::tsquery <-> 'b'::tsquery)", (True, "'a' 'b' 'c'", "'a' & 'b'", "!'a'", True)),
        ("select numnode('a & b'::tsquery), querytree('a & !b'::tsquery), strip('a:1'::tsvector), length('a:1 b'::tsvector), setweight('a:1'::tsvector, 'A'), tsquery_phrase('a'::tsquery, 'b'::tsquery, 2)", (3, "'a'", "'a'", 2, "'a':1A", "'a' <2> 'b'")),
        ("""select '{"a":[1,2,3]}'::jsonb @? '$.a[*] ? (@ > 2)', '{"a":1}'::jsonb @@ '$.a > 0', jsonb_path_exists('{"a":1}', '$.a ? (@ > $x)', '{"x":0}'), jsonb_path_match('{"a":1}', 'strict $.b > 0', '{}', true)""", (True, True, True, None)),
        ("select date_bin(interval '15 minutes', timestamp '2024-01-15 10:20', timestamp '2001-01-01')::text, extract(second from timestamp '2024-01-15 10:20:30.5')::float8, extract(epoch from timestamp '1970-01-02')::int", ("2024-01-15 10:15:00", 30.5, 86400)),
        ("select current_database(), pg_typeof(time '10:00'), format_type(23, null), pg_encoding_to_char(6), pg_char_to_encoding('utf-8'), uuid_extract_version(uuidv7())", ("tessera", "time without time zone", "integer", "UTF8", 6, 7)),
        ("select '12345678901234567890123456789012345'::numeric::text, '1.5'::numeric::float8, numeric '-0.25'::float8", ("12345678901234567890123456789012345.000", 1.5, -0.25)),
        ("select 'abc' ^@ 'ab', 'a' || time '10:00', concat(interval '1 day', 'x')", (True, "a10:00:00", "1 dayx")),
    ],
)
def test_values(db, text, want):
    got = one(db, text)
    assert got == want or [str(x) for x in got] == [str(x) for x in want]


@pytest.mark.parametrize(
    ("text", "state"),
    [("select length('a', 'b')", "42883"), ("select left('abc', 1, 2)", "42883"), ("select jsonb_path_exists('{}', '$', '{}', true, 1)", "42883"), ("select '25:00'::time", "22P02"), ("select point 'x'", "22P02"),
     ("select time '10:00' * 2", "42883"), ("select sum(time '10:00')", "42883"), ("select nextval('nosuch')", "42P01"), ("select 'NaN'::numeric", "0A000"), ("select 'x'::numeric", "22P02"), ("select current_setting('nosuch')", "42704"), ("select 'a'::tsvector @@ 'a &'::tsquery", "22P02")],
)
def test_errors(db, text, state):
    with pytest.raises(SqlError) as e:
        db.sql(text).collect()
    assert e.value.state == state


def test_columns_and_sequences(db):
    db.sql("create table t (id serial, tm time, p point, m money default '$3', i interval)")
    db.sql("insert into t (tm, p, i) values ('10:00', '(1,2)', '1 day'), ('09:00:01.5', '(3,4)', '2 mons'), (null, null, '30 hours')")
    assert [tuple(r) for r in db.sql("select id, tm, p, m, i from t order by i desc").collect()] == [(2, "09:00:01.5", "(3,4)", "$3.00", "2 mons"), (3, None, None, "$3.00", "30:00:00"), (1, "10:00:00", "(1,2)", "$3.00", "1 day")]
    assert one(db, "select sum(m), max(i), min(tm), sum(i), avg(interval '1 day') from t") == ("$9.00", "2 mons", "09:00:01.5", "2 mons 1 day 30:00:00", "1 day")
    assert sorted(r.id for r in db.sql("insert into t (tm) select null from generate_series(1, 4) returning id").collect()) == [4, 5, 6, 7]
    assert one(db, "update t set tm = tm + interval '1 hour' where p <-> point '(0,0)' < 3 returning tm") == ("11:00:00",)
    db.sql("create sequence s start 5 increment 10")
    assert one(db, "select nextval('s')") == (5,)
    assert sorted(r.n for r in db.sql("select nextval('s') as n, id from t").collect()) == list(range(15, 85, 10))
    assert one(db, "select currval('s'), lastval(), setval('s', 100)") == (75, 75, 100) and one(db, "select nextval('s')") == (110,)
    with pytest.raises(SqlError):
        db.sql("select nextval('s') + id from t")


def test_rows_are_appended_and_old_folders_vacuumed(db):
    db.sql("create table a (k int primary key, v text)")
    db.sql("insert into a values (1, 'x'), (2, 'y')")
    db.sql("insert into a values (3, 'z')")
    t = db.tables["a"]
    assert len(t.paths) == 2
    for text, state in (("insert into a values (2, 'again')", "23505"), ("insert into a values (9, 'p'), (9, 'q')", "23505"), ("insert into a values (null, 'n')", "23502")):
        with pytest.raises(SqlError) as e:
            db.sql(text)
        assert e.value.state == state and len(t.paths) == 2
    assert one(db, "update a set v = v || '!' where k > 1 returning k") in ((2,), (3,)) and len(t.paths) == 1
    assert [r.k for r in db.sql("delete from a where v = 'x' returning k").collect()] == [1]
    db.sql("vacuum")
    assert sorted(map(tuple, db.sql("select * from a").collect())) == [(2, "y!"), (3, "z!")]


def test_copy_statement(db, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.txt").write_text(f"k\tv\nk\tv\n{i}\tx\n")
    db.sql("create table c (k text, v text)")
    assert db.sql(f"copy c from '{tmp_path}' (header match)").first()[0] == "COPY 6"
    assert sorted(map(tuple, db.sql("select * from c").collect())) == [("0", "x"), ("1", "x"), ("2", "x")] + [("k", "v")] * 3
    (tmp_path / "3.txt").write_text("other\tnames\n")
    with pytest.raises(Exception, match="header"):
        db.sql(f"copy c from '{tmp_path}' (header match)")
    assert db.sql("copy c from stdin (format csv, delimiter ';', null '-')", ['a;"b;c"\nd;-\n']).first()[0] == "COPY 2"
    assert one(db, "select count(*), count(v) from c") == (8, 7)


def test_cursor_moves(db):
    db.sql("declare c cursor for select g from generate_series(1, 10) as t(g) order by g")
    fetch = lambda text: [r.g for r in db.sql(text).collect()]
    assert fetch("fetch 3 from c") == [1, 2, 3] and fetch("fetch backward 2 from c") == [2, 1] and fetch("fetch forward 2 from c") == [2, 3]
    assert db.sql("move all from c").first()[0] == "MOVE 7" and fetch("fetch 1 from c") == [] and fetch("fetch backward 2 from c") == [10, 9]


def test_catalog_rows(db):
    assert one(db, "select message, sql_error_code from pg_input_error_info('abc', 'integer') e") == ('invalid input syntax for type integer: "abc"', "22P02")
    assert one(db, "select message from pg_input_error_info('12', 'integer') e") == (None,)
    assert one(db, "select name from pg_available_extensions() e") == ("plpgsql",)


def test_ipv4_addresses_need_no_objects(monkeypatch):
    """The short way for IPv4 says what ipaddress says, edges and errors too."""
    from tessera.functions import udfs, values

    texts = ["0.0.0.0", "255.255.255.255", "10.0.0.0/8", "10.1.2.3/0", "1.2.3.4/31", "10.0.0.1", "01.2.3.4", "::1", "fe80::1/64"]

    def said(f, *args):
        try:
            return f(*args)
        except ValueError as e:
            return type(e), str(e)

    def all_of_them():
        one = [said(udfs.inet, w, x) for x in texts for w in ("host", "network", "text", "abbrev", "netmask")]
        one += [said(f, x) for x in texts for f in (values.inet_key, values.abbreviated)] + [said(udfs.inet_set, x, n, k) for x in texts for n in (-1, 0, 24, 32, 33) for k in (True, False)]
        one += [said(udfs.inet_op, op, x, n) for x in texts for op in "+-" for n in ("1", "-1", "300", "x")]
        return one + [said(udfs.inet_op, op, x, y) for x in texts for y in texts for op in ("<<", "<<=", ">>", ">>=", "&&", "&", "|", "-")]

    assert values.v4("10.1.2.3/8") == (0x0A010203, 8) and values.v4("01.2.3.4") is None and values.v4("1.2.3.4/33") is None
    short = all_of_them()
    monkeypatch.setattr(values, "v4", lambda text: None)
    assert short == all_of_them()


@pytest.mark.parametrize("name", ["type_inet", "geo_sql_segments", "geo_sql_polygons"])
def test_costly_rows_are_dealt_out(spark, name):
    """A small table is one part; its rows are not one task's where each costs much."""
    from tessera import queries as registered

    got = registered.queries()[name](spark, "/root/testdata/sf0.001")
    assert got.rdd.getNumPartitions() > 1
