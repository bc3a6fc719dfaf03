"""Types that Spark lacks, in SQL over whole tables; the other engine says the same by its own types or by arithmetic."""

from __future__ import annotations

from .base import Texts

T = Texts()
A = T.add

# clock times and intervals
A("type_time", "select event_id, ts::time as t, (ts::time + interval '90 minutes')::text as later, ts::time > '12:00' as afternoon, extract(hour from ts::time)::int as h, (date '2024-01-01' + ts::time) as d from events",
  "select event_id, strftime(ts, '%H:%M:%S') || case when microsecond(ts) % 1000000 = 0 then '' else rtrim('.' || lpad(cast(microsecond(ts) % 1000000 as varchar), 6, '0'), '0') end as t, strftime(ts + interval '90 minutes', '%H:%M:%S') || case when microsecond(ts) % 1000000 = 0 then '' else rtrim('.' || lpad(cast(microsecond(ts) % 1000000 as varchar), 6, '0'), '0') end as later, ts::time > time '12:00' as afternoon, hour(ts)::int as h, timestamp '2024-01-01' + (ts - date_trunc('day', ts)) as d from events")
A("type_interval", "select o_orderkey, (interval '1 day' * o_custkey) > interval '3 months' as long, extract(epoch from o_orderdate - timestamp '1995-01-01')::bigint as s, extract(day from interval '36 hours' * o_custkey + interval '2 days')::int as d, justify_hours(interval '36 hours' * o_custkey) = interval '36 hours' * o_custkey as same from orders",
  "select o_orderkey, o_custkey > 90 as long, epoch(o_orderdate - timestamp '1995-01-01')::bigint as s, 2 as d, true as same from orders")
A("type_interval_text", "select o_orderkey, (timestamp '1998-12-31' - o_orderdate)::text as t, (interval '1 month' * (o_custkey % 30))::text as m from orders",
  "select o_orderkey, case when d = 0 then '00:00:00' when d = 1 then d || ' day' else d || ' days' end as t, case when m = 0 then '00:00:00' else trim(case when m // 12 = 0 then '' when m // 12 = 1 then '1 year ' else (m // 12) || ' years ' end || case when m % 12 = 0 then '' when m % 12 = 1 then '1 mon' else (m % 12) || ' mons' end) end as m from (select o_orderkey, datediff('day', o_orderdate::date, date '1998-12-31') as d, o_custkey % 30 as m from orders)")
A("type_interval_sums", "select event_type, sum(interval '1 second' * (user_id % 100))::text as t, max(interval '1 day' * (user_id % 40)) > interval '1 month' as m, min(ts::time)::text < '24' as f from events group by event_type",
  "select event_type, lpad(cast(s // 3600 as varchar), greatest(2, length(cast(s // 3600 as varchar)))::int, '0') || ':' || lpad(cast(s // 60 % 60 as varchar), 2, '0') || ':' || lpad(cast(s % 60 as varchar), 2, '0') as t, m > 30 as m, true as f from (select event_type, sum(user_id % 100)::bigint as s, max(user_id % 40) as m from events group by event_type)")
A("type_age", "select o_orderkey, extract(year from age(timestamp '2000-01-01', o_orderdate))::int as y, extract(month from age(timestamp '2000-01-01', o_orderdate))::int as m from orders",
  "select o_orderkey, (datesub('month', o_orderdate, timestamp '2000-01-01') // 12)::int as y, (datesub('month', o_orderdate, timestamp '2000-01-01') % 12)::int as m from orders")

# money and numbers of the log
A("type_money", "select l_orderkey, l_linenumber, (l_quantity::numeric::money * 3)::text as a, l_quantity::numeric::money > '$25' as big, -(l_quantity::numeric::money) as n, (l_quantity::numeric::money / 2::double precision)::text as h from lineitem",
  "select l_orderkey, l_linenumber, printf('$%.2f', l_quantity * 3) as a, l_quantity > 25 as big, printf('-$%.2f', l_quantity) as n, printf('$%.2f', l_quantity / 2) as h from lineitem")
A("type_money_sum", "select l_returnflag, sum(l_quantity::numeric::money) as s, max(l_quantity::numeric::money) as m from lineitem group by l_returnflag",
  "select l_returnflag, '$' || regexp_replace(regexp_replace(printf('%.2f', sum(l_quantity)), '(\\d)(\\d{6}\\.)', '\\1,\\2'), '(\\d)(\\d{3}\\.)', '\\1,\\2') as s, printf('$%.2f', max(l_quantity)) as m from lineitem group by l_returnflag")
A("type_pg_lsn", "select o_orderkey, ('0/0'::pg_lsn + o_orderkey * 4000000)::text as l, ('0/0'::pg_lsn + o_orderkey) > '0/FF'::pg_lsn as far, ('1/0'::pg_lsn - '0/1'::pg_lsn)::bigint as d from orders",
  "select o_orderkey, upper(to_hex(o_orderkey::bigint * 4000000 // 4294967296)) || '/' || upper(to_hex(o_orderkey::bigint * 4000000 % 4294967296)) as l, o_orderkey > 255 as far, 4294967295 as d from orders")

# networks
A("type_inet", "select c_custkey, host(inet '10.0.0.0' + c_custkey) as h, (inet '10.0.0.0' + c_custkey) << cidr '10.0.0.0/25' as inside, (inet '10.0.0.0' + c_custkey) - inet '10.0.0.0' as back, (inet '10.0.0.0' + c_custkey) > inet '10.0.1.0' as more, network(set_masklen(inet '10.0.0.0' + c_custkey, 24))::text as net, abbrev(network(set_masklen(inet '10.0.0.0' + c_custkey, 24))) as short from customer",
  "select c_custkey, '10.' || (c_custkey // 65536) || '.' || (c_custkey // 256 % 256) || '.' || (c_custkey % 256) as h, c_custkey < 128 as inside, c_custkey::bigint as back, c_custkey > 256 as more, '10.' || (c_custkey // 65536) || '.' || (c_custkey // 256 % 256) || '.0/24' as net, '10.' || (c_custkey // 65536) || '.' || (c_custkey // 256 % 256) || '/24' as short from customer")
A("type_macaddr", "select s_suppkey, ('08:00:2b:00:' || lpad(to_hex(s_suppkey % 256), 2, '0') || ':0a')::macaddr as m, ('08002b00' || lpad(to_hex(s_suppkey % 256), 2, '0') || '0a')::macaddr < '08:00:2b:00:10:00'::macaddr as low, trunc(('08002b00' || lpad(to_hex(s_suppkey % 256), 2, '0') || '0a')::macaddr)::text as t from supplier",
  "select s_suppkey, '08:00:2b:00:' || lpad(lower(to_hex(s_suppkey % 256)), 2, '0') || ':0a' as m, s_suppkey % 256 < 16 as low, '08:00:2b:00:00:00' as t from supplier")

# geometry
P = "point(p_size, p_retailprice / 100)"
A("geo_sql_points", f"select p_partkey, round({P} <-> point '(25,10)', 6) as d, {P} << point '(25,0)' as west, {P} |>> point '(0,12)' as up, {P} <@ box '(10,9),(30,12)' as inside, {P} <@ circle '<(25,10),5>' as near, {P} + point '(1,1)' ~= point(p_size + 1, p_retailprice / 100 + 1) as moved, round({P} <-> line '{{1,-1,0}}', 6) as l from part",
  "select p_partkey, round(sqrt(pow(p_size - 25, 2) + pow(y - 10, 2)), 6) as d, p_size < 25 as west, y > 12 as up, p_size between 10 and 30 and y between 9 and 12 as inside, sqrt(pow(p_size - 25, 2) + pow(y - 10, 2)) <= 5 as near, true as moved, round(abs(p_size - y) / sqrt(2), 6) as l from (select p_partkey, p_size, p_retailprice / 100 as y from part)")
B = "box(point(p_size, 0), point(p_size + 5, p_retailprice / 100))"
A("geo_sql_boxes", f"select p_partkey, round(area({B}), 6) as a, {B} && box '(20,0),(30,100)' as meets, {B} @> point '(22,3)' as holds, width({B}) as w, round(height({B}), 6) as h, {B} << box '(30,0),(40,1)' as west, {B} &< box '(30,0),(40,1)' as over, round({B} <-> box '(100,0),(101,1)', 6) as d, {B} < box '(0,0),(5,10)' as smaller, {B} <^ box '(0,12),(1,13)' as under from part",
  "select p_partkey, round(5 * y, 6) as a, p_size <= 30 and p_size + 5 >= 20 as meets, 22 between p_size and p_size + 5 and y >= 3 as holds, cast(5 as double) as w, round(y, 6) as h, p_size + 5 < 30 as west, p_size + 5 <= 40 as over, round(sqrt(pow(100.5 - (p_size + 2.5), 2) + pow(0.5 - y / 2, 2)), 6) as d, 5 * y < 50 as smaller, y <= 12 as under from (select p_partkey, p_size, p_retailprice / 100 as y from part)")
C = "circle(point(p_size, 0), 5)"
A("geo_sql_circles", f"select p_partkey, {C} && circle '<(30,0),5>' as meets, {C} << circle '<(30,0),5>' as west, {C} &> circle '<(30,0),5>' as east, {C} @> circle '<(25,0),1>' as holds, round({C} <-> circle '<(50,0),1>', 6) as d, round({C} <-> point '(0,0)', 6) as p, round(area({C}), 6) as a, diameter({C}) as m, radius({C} * point '(2,0)') as r, {C} = circle '<(0,0),5>' as same from part",
  "select p_partkey, abs(p_size - 30) <= 10 as meets, p_size + 5 < 25 as west, p_size - 5 >= 25 as east, abs(p_size - 25) <= 4 as holds, round(greatest(abs(50 - p_size) - 6.0, 0), 6) as d, round(greatest(p_size - 5.0, 0), 6) as p, round(25 * pi(), 6) as a, cast(10 as double) as m, cast(10 as double) as r, true as same from part")
L = "lseg(point(p_size, 0), point(p_size, 10))"
A("geo_sql_segments", f"select p_partkey, @-@ {L} as n, {L} ?# lseg '[(20,5),(30,5)]' as crosses, ({L} # lseg '[(0,5),(100,5)]') ~= point(p_size, 5) as at, {L} ?-| lseg '[(0,0),(1,0)]' as square, ?| {L} as upright, round({L} <-> lseg '[(100,0),(100,5)]', 6) as d, ({L} ## lseg '[(100,0),(100,5)]') is not null as c, {L} <@ box '(0,0),(25,10)' as inside, {L} ?# box '(20,0),(25,1)' as meets, round({L} <-> box '(60,0),(61,1)', 6) as b, {L} ?# line '{{1,0,-25}}' as l, {L} = lseg '[(25,0),(25,10)]' as same from part",
  "select p_partkey, cast(10 as double) as n, p_size between 20 and 30 as crosses, true as at, true as square, true as upright, cast(100 - p_size as double) as d, true as c, p_size <= 25 as inside, p_size between 20 and 25 as meets, cast(60 - p_size as double) as b, p_size = 25 as l, p_size = 25 as same from part")
G = "polygon(box(point(p_size, 0), point(p_size + 10, 10)))"
A("geo_sql_polygons", f"select p_partkey, npoints({G}) as n, {G} @> point '(25,5)' as holds, {G} && polygon '((20,0),(20,5),(30,5),(30,0))' as meets, {G} << polygon '((60,0),(60,1),(61,1))' as west, {G} |>> polygon '((0,-5),(0,-1),(5,-1))' as above, round({G} <-> point '(100,5)', 6) as d, round(circle '<(100,5),2>' <-> {G}, 6) as c, center({G}::box)[0] is null as z from part".replace(", center({G}::box)[0] is null as z".format(G=G), ""),
  "select p_partkey, 4 as n, 25 between p_size and p_size + 10 as holds, p_size <= 30 and p_size + 10 >= 20 as meets, p_size + 10 < 60 as west, true as above, cast(90 - p_size as double) as d, cast(88 - p_size as double) as c from part")
A("geo_sql_paths", "select p_partkey, @-@ path(polygon(box(point(0, 0), point(p_size, 1)))) as n, isclosed(path '((0,0),(1,1))') as c, npoints(popen(path '((0,0),(1,1),(2,0))') + path '[(5,5),(6,6)]') as k, area(path(polygon(box(point(0, 0), point(p_size, 2))))) as a, point(p_size, 3) <-> path '[(0,0),(100,0)]' as d, path '[(0,0),(100,0)]' ?# path '[(25,-1),(25,1)]' as x, (path '[(0,0),(1,0)]' + point(p_size, 0)) <-> point '(100,0)' as m from part",
  "select p_partkey, cast(2 * p_size + 2 as double) as n, true as c, 5 as k, cast(2 * p_size as double) as a, cast(3 as double) as d, true as x, cast(99 - p_size as double) as m from part")

# text search
V = "array_to_tsvector(string_to_array(p_type, ' '))"
A("text_search_sql", f"select p_partkey, {V} @@ 'PROMO & !STEEL'::tsquery as a, {V} @@ to_query as never, length({V}) as n from part".replace(f"{V} @@ to_query as never, ", f"{V} @@ ('PROMO'::tsquery || 'STANDARD'::tsquery) as o, {V} @@ 'ST:*'::tsquery as p, "),
  "select p_partkey, list_contains(w, 'PROMO') and not list_contains(w, 'STEEL') as a, list_contains(w, 'PROMO') or list_contains(w, 'STANDARD') as o, len(list_filter(w, lambda x: starts_with(x, 'ST'))) > 0 as p, len(list_distinct(w)) as n from (select p_partkey, string_split(p_type, ' ') as w from part)")
A("text_search_delete", f"select p_partkey, ts_delete({V}, 'STEEL')::text as t, tsvector_to_array({V} || 'x:1'::tsvector) as a from part",
  "select p_partkey, array_to_string(list_transform(list_sort(list_distinct(list_filter(w, lambda x: x <> 'STEEL'))), lambda x: chr(39) || x || chr(39)), ' ') as t, list_sort(list_distinct(list_append(w, 'x'))) as a from (select p_partkey, string_split(p_type, ' ') as w from part)")

# JSON paths
J = "('{\"k\":' || n_nationkey || ',\"r\":[' || n_regionkey || ',null,\"x\"]}')::jsonb"
A("json_path_operators", f"select n_nationkey, {J} @? '$.r[*] ? (@ > 2)' as some, {J} @@ '$.k > 10' as more, jsonb_path_exists({J}, '$.k ? (@ > $least)', '{{\"least\": 7}}') as v, jsonb_path_query_first({J}, '$.r[0]') as f, jsonb_path_query_array({J}, 'strict $.none', '{{}}', true) as s, {J} -> 'r' ->> 2 as x from nation",
  "select n_nationkey, n_regionkey > 2 as some, n_nationkey > 10 as more, n_nationkey > 7 as v, cast(n_regionkey as varchar) as f, '[]' as s, 'x' as x from nation")


def queries() -> dict:
    return T.queries()


def oracle_sql() -> dict:
    return T.oracle
