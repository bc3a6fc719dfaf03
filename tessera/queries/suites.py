"""Analytical suites: decision-support shapes on the order tables, web-log shapes on the event tables."""

from __future__ import annotations

from .base import Texts

T = Texts()
A = T.add

A("q1", """select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice), 2) as sum_base, round(sum(l_extendedprice * (1 - l_discount)), 4) as sum_disc,
round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 6) as sum_charge, round(avg(l_quantity), 6) as avg_qty, round(avg(l_extendedprice), 4) as avg_price, round(avg(l_discount), 6) as avg_disc, count(*) as n
from lineitem where l_shipdate <= date '1998-12-01' - interval '90' day group by l_returnflag, l_linestatus order by l_returnflag, l_linestatus""")
A("q2", """select s_suppkey, s_name, n_name, p_partkey, round(v.price, 6) as price from part join (select l_partkey, l_suppkey, min(l_extendedprice / l_quantity) as price from lineitem group by l_partkey, l_suppkey) v on p_partkey = v.l_partkey
join supplier on s_suppkey = v.l_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
where p_size < 15 and v.price = (select min(l2.l_extendedprice / l2.l_quantity) from lineitem l2 where l2.l_partkey = p_partkey)""")
A("q3", """select l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue, o_orderdate from customer, orders, lineitem
where c_mktsegment = 'BUILDING' and c_custkey = o_custkey and l_orderkey = o_orderkey and o_orderdate < date '1995-03-15' and l_shipdate > date '1995-03-15'
group by l_orderkey, o_orderdate order by revenue desc, o_orderdate, l_orderkey limit 10""")
A("q4", """select o_orderpriority, count(*) as order_count from orders where o_orderdate >= date '1993-07-01' and o_orderdate < date '1993-07-01' + interval '3' month
and exists (select * from lineitem where l_orderkey = o_orderkey and l_shipdate > o_orderdate) group by o_orderpriority order by o_orderpriority""")
A("q5", """select n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue from customer, orders, lineitem, supplier, nation, region
where c_custkey = o_custkey and l_orderkey = o_orderkey and l_suppkey = s_suppkey and c_nationkey = s_nationkey and s_nationkey = n_nationkey and n_regionkey = r_regionkey
and o_orderdate >= date '1994-01-01' and o_orderdate < date '1996-01-01' group by n_name order by revenue desc""")
A("q6", """select round(sum(l_extendedprice * l_discount), 4) as revenue from lineitem where l_shipdate >= date '1994-01-01' and l_shipdate < date '1994-01-01' + interval '1' year
and l_discount between 0.05 and 0.07 and l_quantity < 24""")
A("q7", """select supp_nation, cust_nation, l_year, round(sum(volume), 4) as revenue from (select n1.n_name as supp_nation, n2.n_name as cust_nation, extract(year from l_shipdate)::int as l_year, l_extendedprice * (1 - l_discount) as volume
from supplier, lineitem, orders, customer, nation n1, nation n2 where s_suppkey = l_suppkey and o_orderkey = l_orderkey and c_custkey = o_custkey and s_nationkey = n1.n_nationkey and c_nationkey = n2.n_nationkey
and n1.n_regionkey = 1 and n2.n_regionkey = 2) shipping group by supp_nation, cust_nation, l_year""")
A("q8", """select o_year, round(sum(case when nation = 'NATION_3' then volume else 0 end) / sum(volume), 6) as mkt_share from (select extract(year from o_orderdate)::int as o_year, l_extendedprice * (1 - l_discount) as volume, n2.n_name as nation
from part, supplier, lineitem, orders, customer, nation n1, nation n2, region where p_partkey = l_partkey and s_suppkey = l_suppkey and l_orderkey = o_orderkey and o_custkey = c_custkey and c_nationkey = n1.n_nationkey and n1.n_regionkey = r_regionkey and s_nationkey = n2.n_nationkey) t group by o_year""")
A("q9", """select nation, o_year, round(sum(amount), 4) as sum_profit from (select n_name as nation, extract(year from o_orderdate)::int as o_year, l_extendedprice * (1 - l_discount) - p_retailprice * l_quantity / 10 as amount
from part, supplier, lineitem, orders, nation where s_suppkey = l_suppkey and p_partkey = l_partkey and o_orderkey = l_orderkey and s_nationkey = n_nationkey and p_name like '%a%') profit group by nation, o_year""")
A("q10", """select c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue, c_acctbal, n_name from customer, orders, lineitem, nation
where c_custkey = o_custkey and l_orderkey = o_orderkey and o_orderdate >= date '1993-10-01' and o_orderdate < date '1994-01-01' and l_returnflag = 'R' and c_nationkey = n_nationkey
group by c_custkey, c_name, c_acctbal, n_name order by revenue desc, c_custkey limit 20""")
A("q11", """select l_partkey, round(sum(l_extendedprice), 2) as value from lineitem, supplier, nation where l_suppkey = s_suppkey and s_nationkey = n_nationkey and n_regionkey = 1
group by l_partkey having sum(l_extendedprice) > (select sum(l_extendedprice) * 0.002 from lineitem, supplier, nation where l_suppkey = s_suppkey and s_nationkey = n_nationkey and n_regionkey = 1)""")
A("q12", """select l_linestatus, sum(case when o_orderpriority like '1%' or o_orderpriority like '2%' then 1 else 0 end)::bigint as high, sum(case when o_orderpriority not like '1%' and o_orderpriority not like '2%' then 1 else 0 end)::bigint as low
from orders, lineitem where o_orderkey = l_orderkey and l_shipdate >= date '1994-01-01' and l_shipdate < date '1995-01-01' group by l_linestatus""")
A("q13", """select c_count, count(*) as custdist from (select c_custkey, count(o_orderkey) as c_count from customer left outer join orders on c_custkey = o_custkey and o_orderpriority not like '%URGENT%' group by c_custkey) c_orders group by c_count""")
A("q14", """select round(100.00 * sum(case when p_type like 'PROMO%' then l_extendedprice * (1 - l_discount) else 0 end) / sum(l_extendedprice * (1 - l_discount)), 6) as promo from lineitem, part
where l_partkey = p_partkey and l_shipdate >= date '1995-09-01' and l_shipdate < date '1995-12-01'""")
A("q15", """with revenue as (select l_suppkey as supplier_no, round(sum(l_extendedprice * (1 - l_discount)), 4) as total from lineitem where l_shipdate >= date '1996-01-01' and l_shipdate < date '1996-04-01' group by l_suppkey)
select s_suppkey, s_name, total from supplier, revenue where s_suppkey = supplier_no and total = (select max(total) from revenue)""")
A("q16", """select p_brand, p_type, p_size, count(distinct l_suppkey) as supplier_cnt from lineitem, part where p_partkey = l_partkey and p_brand <> 'Brand#45' and p_size in (1, 4, 7, 14, 23, 45, 19, 3, 36, 9)
and l_suppkey not in (select s_suppkey from supplier where s_acctbal < 0) group by p_brand, p_type, p_size""")
A("q17", """select round(sum(l_extendedprice) / 7.0, 2) as avg_yearly from lineitem, part where p_partkey = l_partkey and p_size < 20 and l_quantity < (select 0.4 * avg(l_quantity) from lineitem where l_partkey = p_partkey)""")
A("q18", """select c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, sum(l_quantity) as q from customer, orders, lineitem where o_orderkey in (select l_orderkey from lineitem group by l_orderkey having sum(l_quantity) > 200)
and c_custkey = o_custkey and o_orderkey = l_orderkey group by c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice order by o_totalprice desc, o_orderkey limit 100""")
A("q19", """select round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue from lineitem, part where (p_partkey = l_partkey and p_size between 1 and 15 and l_quantity >= 1 and l_quantity <= 11)
or (p_partkey = l_partkey and p_size between 10 and 30 and l_quantity >= 10 and l_quantity <= 20) or (p_partkey = l_partkey and p_size between 25 and 50 and l_quantity >= 20 and l_quantity <= 30)""")
A("q20", """select s_name, s_suppkey from supplier, nation where s_suppkey in (select l_suppkey from lineitem where l_partkey in (select p_partkey from part where p_name like '%b%')
group by l_partkey, l_suppkey having sum(l_quantity) > 40) and s_nationkey = n_nationkey""")
A("q21", """select s_name, count(*) as numwait from supplier, lineitem l1, orders, nation where s_suppkey = l1.l_suppkey and o_orderkey = l1.l_orderkey and o_orderstatus = 'F' and l1.l_returnflag = 'R'
and exists (select * from lineitem l2 where l2.l_orderkey = l1.l_orderkey and l2.l_suppkey <> l1.l_suppkey) and not exists (select * from lineitem l3 where l3.l_orderkey = l1.l_orderkey and l3.l_suppkey <> l1.l_suppkey and l3.l_returnflag = 'R')
and s_nationkey = n_nationkey group by s_name order by numwait desc, s_name limit 100""")
A("q22", """select c_nationkey, count(*) as numcust, round(sum(c_acctbal), 2) as total from customer where c_nationkey in (13, 17, 18, 23, 3, 5, 7) and c_acctbal > (select avg(c_acctbal) from customer where c_acctbal > 0.00)
and not exists (select * from orders where o_custkey = c_custkey and o_totalprice > 300000) group by c_nationkey""")

# web-log shapes
A("log_count", "select count(*) as n from events")
A("log_filter_count", "select count(*) as n from events where user_id <> 0 and event_type <> ''")
A("log_sum_avg", "select round(sum(value), 2) as s, count(*) as n, round(avg(user_id)::double precision, 4) as a from events")
A("log_distinct_users", "select count(distinct user_id) as n from events")
A("log_min_max", "select min(ts) as lo, max(ts) as hi from events")
A("log_top_types", "select event_type, count(*) as n, count(distinct user_id) as u from events group by event_type order by n desc, event_type limit 10")
A("log_top_users", "select user_id, event_type, count(*) as n from events group by user_id, event_type order by n desc, user_id, event_type limit 10")
A("log_point_lookup", "select user_id, value from events where user_id = 7")
A("log_like_count", "select count(*) as n from pages where url like '%example.org%'")
A("log_like_group", "select lang, min(text) as first_text, count(*) as n from documents where text like '%the%' group by lang")
A("log_host", "select regexp_replace(url, '^https?://(?:www\\.)?([^/]+)/.*$', '\\1') as host, count(*) as n, round(avg(length(url))::double precision, 4) as l from pages group by host having count(*) > 2",
  "select regexp_replace(url, '^https?://(?:www\\.)?([^/]+)/.*$', '\\1') as host, count(*) as n, round(avg(length(url)), 4) as l from pages group by host having count(*) > 2")
A("log_many_sums", "select " + ", ".join(f"round(sum(value + {k}), 2) as s{k}" for k in range(30)) + " from events")
A("log_group_expressions", "select user_id, user_id - 1 as a, user_id - 2 as b, count(*) as n from events group by user_id, user_id - 1, user_id - 2 order by n desc, user_id limit 10")
A("log_minutes", "select date_trunc('hour', ts) as m, count(*) as n from events where ts >= timestamp '2020-01-01' group by date_trunc('hour', ts)")
A("log_case_group", "select case when value > 50 then 'big' else 'small' end as size, event_type, count(*) as n from events group by 1, 2")
A("log_offset", "select user_id, count(*) as n from events group by user_id order by n desc, user_id limit 10 offset 5")

# the rest of the log's shapes: events with the page that their user looks at
HITS = "with hits as (select e.*, coalesce(p.url, '') as url, coalesce(p.page_id, -1) as page from events e left join pages p on p.page_id = e.user_id) "
A("log_avg_user", "select avg(user_id)::double precision as a from events", "select avg(user_id) as a from events")
A("log_distinct_props", "select count(distinct props) as n from events")
A("log_types_filtered", "select event_type, count(*) as n from events where event_type <> 'error' group by event_type order by count(*) desc, event_type")
A("log_types_users", "select event_type, count(distinct user_id) as u from events group by event_type order by u desc, event_type limit 10")
A("log_types_many", "select event_type, round(sum(value), 2) as s, count(*) as c, round(avg(value), 4) as a, count(distinct user_id) as u from events group by event_type order by c desc, event_type limit 10")
A("log_props_users", "select props, count(distinct user_id) as u from events where props <> '' group by props order by u desc, props limit 10")
A("log_type_props_users", "select event_type, props, count(distinct user_id) as u from events where props <> '' group by event_type, props order by u desc, event_type, props limit 10")
A("log_props", "select props, count(*) as c from events where props <> '' group by props order by c desc, props limit 10")
A("log_type_props", "select event_type, props, count(*) as c from events where props <> '' group by event_type, props order by c desc, event_type, props limit 10")
A("log_users", "select user_id, count(*) as n from events group by user_id order by count(*) desc, user_id limit 10")
A("log_any_ten", "select count(*) as n from (select user_id, props, count(*) as c from events group by user_id, props limit 10) t")
A("log_user_minutes", "select user_id, extract(minute from ts)::int as m, props, count(*) as n from events group by user_id, m, props order by count(*) desc, user_id, m, props limit 10",
  "select user_id, extract(minute from ts)::int as m, props, count(*) as n from events group by all order by n desc, user_id, m, props limit 10")
A("log_like_min", HITS + "select event_type, min(url) as u, count(*) as c from hits where url like '%example.org%' and props <> '' group by event_type order by c desc, event_type limit 10")
A("log_like_not_like", "select count(*) as c, min(url) as u, count(distinct url) as d from pages where html like '%error%' and url not like '%.com%'")
A("log_like_rows", HITS + "select event_id, ts, user_id, event_type, value, url from hits where url like '%example.org%' order by ts, event_id limit 10")
A("log_by_time", "select props from (select props, ts, event_id from events where props <> '' order by ts, event_id limit 10) t")
A("log_by_props", "select props from events where props <> '' order by props limit 10")
A("log_by_time_props", "select ts, props from events where props <> '' order by ts, props limit 10")
A("log_url_lengths", HITS + "select event_type, round(avg(length(url))::double precision, 4) as l, count(*) as c from hits where url <> '' group by event_type having count(*) > 10 order by l desc, event_type limit 25",
  HITS + "select event_type, round(avg(length(url)), 4) as l, count(*) as c from hits where url <> '' group by event_type having count(*) > 10 order by l desc, event_type limit 25")
A("log_type_user_sums", "select event_type, user_id, count(*) as c, round(sum(value), 2) as s, round(avg(value), 4) as a from events where props <> '' group by event_type, user_id order by c desc, event_type, user_id limit 10")
A("log_event_sums", "select event_id, user_id, count(*) as c, round(sum(value), 2) as s, round(avg(value), 4) as a from events where props <> '' group by event_id, user_id order by c desc, event_id limit 10")
A("log_event_sums_all", "select event_id, user_id, count(*) as c, round(sum(value), 2) as s, round(avg(value), 4) as a from events group by event_id, user_id order by c desc, event_id limit 10")
A("log_urls", HITS + "select url, count(*) as c from hits group by url order by c desc, url limit 10")
A("log_constant_urls", HITS + "select 1 as one, url, count(*) as c from hits group by 1, url order by c desc, url limit 10")
A("log_page_views", HITS + "select url, count(*) as views from hits where page >= 0 and ts >= timestamp '2024-01-01' and ts <= timestamp '2024-01-31' and value > 0 and event_type <> 'error' and url <> '' group by url order by views desc, url limit 10")
A("log_page_views_offset", HITS + "select url, count(*) as views from hits where ts >= timestamp '2024-01-01' and event_type in ('view', 'click', 'purchase') group by url order by views desc, url limit 10 offset 5")
A("log_sources", HITS + "select event_type, case when value < 5 then url else '' end as src, url as dst, count(*) as views from hits where ts >= timestamp '2024-01-01' group by event_type, src, dst order by views desc, event_type, src, dst limit 10 offset 10")
A("log_days", HITS + "select page, ts::date as d, count(*) as views from hits where event_type in ('view', 'click') group by page, ts::date order by views desc, page, d limit 10 offset 10",
  HITS + "select page, ts::date as d, count(*) as views from hits where event_type in ('view', 'click') group by page, ts::date order by views desc, page, d limit 10 offset 10")
A("log_minutes_offset", "select date_trunc('minute', ts) as m, count(*) as views from events where ts >= timestamp '2024-01-01' and ts < timestamp '2024-01-15' and value > 1 group by date_trunc('minute', ts) order by date_trunc('minute', ts) limit 10 offset 100")


def queries() -> dict:
    return T.queries()


def oracle_sql() -> dict:
    return T.oracle
