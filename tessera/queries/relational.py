"""Scans, expressions, joins, aggregates, windows, sorting, set operations, subqueries, table functions."""

from __future__ import annotations

from .base import Texts

T = Texts()
A = T.add

# scans and sources
A("scan_project", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity > 45 and l_returnflag = 'R'")
A("scan_range_filter", "select o_orderkey, o_totalprice from orders where o_orderdate >= timestamp '1995-01-01' and o_orderdate < timestamp '1995-04-01'")
A("scan_values", "select column1 as k, column2 as v from (values (1, 'a'), (2, 'b'), (3, null)) t(column1, column2)")
A("scan_table", "table region", "select * from region")
A("select_from_less", "select 1 + 1 as two, 'a' || 'b' as ab, null::int as n")
A("derived_table", "select k, n from (select c_nationkey, count(*) from customer group by c_nationkey) t(k, n) where n > 2")
A("cte_chain", "with a as (select c_nationkey as k, count(*) as n from customer group by c_nationkey), b(k, n) as (select k, n from a where n > 5) select b.k, b.n, n_name from b join nation on n_nationkey = b.k")
A("cte_shadows_table", "with nation as (select 1 as n_nationkey) select count(*) as n from nation")

# expressions
A("expr_three_valued", "select v, v > 1 as gt, (v > 1) is true as t, (v > 1) is not true as nt, (v > 1) is unknown as u, (v > 1) or true as o, (v > 1) and false as a from (values (1), (2), (null)) t(v)")
A("expr_between_in", "select n_nationkey, n_nationkey between 3 and 7 as b, n_nationkey not between 3 and 7 as nb, n_nationkey in (1, 2, 3) as i, n_nationkey not in (1, 2) as ni from nation")
A("expr_in_nulls", "select v, v in (1, null) as i, v not in (1, null) as ni from (values (1), (2), (null)) t(v)")
A("expr_distinct_from", "select a, b, a is distinct from b as d, a is not distinct from b as nd from (values (1, 1), (1, 2), (1, null), (null, null)) t(a, b)")
A("expr_row_comparison", "select count(*) as n from lineitem where (l_returnflag, l_linestatus) = ('R', 'F')")
A("expr_case", "select l_orderkey, l_linenumber, case when l_quantity < 10 then 'low' when l_quantity < 30 then 'mid' else 'high' end as band, case l_returnflag when 'R' then 1 when 'A' then 2 end as code from lineitem")
A("expr_case_lazy", "select v, case when v = 0 then 0 else 10 / v end as q from (values (0), (2), (5)) t(v)", "select v, case when v = 0 then 0 else 10 // v end as q from (values (0), (2), (5)) t(v)")
A("expr_coalesce_nullif", "select a, b, coalesce(a, b, 0) as c, nullif(a, 1) as n, greatest(a, b) as g, least(a, b) as l from (values (1, 2), (null, 3), (4, null)) t(a, b)")
A("expr_cast", "select cast('12' as int) as i, '3.5'::double precision as d, 7::text as t, '2024-02-29'::date as dt, 2.5::double precision::int as h, 3.5::double precision::int as h2, cast(12.345 as numeric(6, 2))::double precision as n, 'yes'::boolean as b, 'abcdef'::varchar(3) as v",
  "select cast('12' as int) as i, cast('3.5' as double) as d, '7' as t, date '2024-02-29' as dt, cast(2 as int) as h, cast(4 as int) as h2, cast(12.35 as double) as n, true as b, 'abc' as v")
A("expr_like", "select p_partkey, p_name like '%a%' as a, p_name ilike '%A%' as b, p_name not like 'p%' as c, p_type like '_%' as d from part")
A("expr_similar", "select v, v similar to '(foo|ba)%' as s, v not similar to '_{3}' as n from (values ('foobar'), ('baz'), ('qux'), ('a.c')) t(v)",
  "select v, regexp_full_match(v, '(foo|ba).*') as s, not regexp_full_match(v, '.{3}') as n from (values ('foobar'), ('baz'), ('qux'), ('a.c')) t(v)")
A("expr_regex", "select v, v ~ '^[a-c]+' as m, v ~* 'B' as i, v !~ 'z' as n, v !~* 'Q' as ni from (values ('abc'), ('xyz'), ('Qb')) t(v)",
  "select v, regexp_matches(v, '^[a-c]+') as m, regexp_matches(v, 'B', 'i') as i, not regexp_matches(v, 'z') as n, not regexp_matches(v, 'Q', 'i') as ni from (values ('abc'), ('xyz'), ('Qb')) t(v)")
A("expr_arithmetic", "select a, b, a + b as s, a - b as d, a * b as p, a / b as q, a % b as r, -a as n, @ a as ab, a ^ 2 as sq, |/ (a * a) as rt, ||/ 27.0::double precision as cb from (values (7, 2), (-7, 2), (9, -4)) t(a, b)",
  "select a, b, a + b as s, a - b as d, a * b as p, cast(trunc(a / b) as int) as q, a % b as r, -a as n, abs(a) as ab, pow(a, 2) as sq, sqrt(a * a) as rt, cast(3 as double) as cb from (values (7, 2), (-7, 2), (9, -4)) t(a, b)")
A("expr_bitwise", "select a, b, a & b as x, a | b as o, a # b as e, ~a as n, a << 2 as l, a >> 1 as r from (values (12, 10), (255, 1)) t(a, b)",
  "select a, b, a & b as x, a | b as o, xor(a, b) as e, ~a as n, a << 2 as l, a >> 1 as r from (values (12, 10), (255, 1)) t(a, b)")
A("expr_concat", "select n_name || '-' || n_nationkey as k, concat(n_name, null, n_regionkey) as c, concat_ws('/', n_name, null, 'x') as w, n_name || null as nn from nation")
A("expr_any_all_array", "select v, v = any(array[1, 2]) as a, v <> all(array[1, 2]) as b, v > all(array[0, 1]) as c, v < any(array[2, 3]) as d from (values (1), (3)) t(v)",
  "select v, v in (1, 2) as a, v not in (1, 2) as b, v > 1 as c, v < 3 as d from (values (1), (3)) t(v)")
A("expr_subscript", "select (array[10, 20, 30])[2] as a, (array[10, 20])[5] as b, array[1, null, 3] as c", "select 20 as a, cast(null as int) as b, [1, null, 3] as c")
A("expr_typed_literals", "select date '2024-01-15' as d, timestamp '2024-01-15 10:20:30' as t, extract(epoch from interval '1 day 2 hours')::double precision as s", "select date '2024-01-15' as d, timestamp '2024-01-15 10:20:30' as t, cast(93600 as double) as s")
A("expr_collate", "select n_name collate \"C\" as n from nation order by n_name collate \"C\" limit 5", "select n_name as n from nation order by n_name limit 5")

# joins
A("join_cross", "select r_name, n_name from region cross join nation")
A("join_comma", "select c_custkey, n_name from customer, nation where c_nationkey = n_nationkey and c_acctbal > 9000")
A("join_inner_on", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where o_totalprice > 300000")
A("join_left", "select c_custkey, count(o_orderkey) as n from customer left join orders on c_custkey = o_custkey and o_totalprice > 200000 group by c_custkey")
A("join_right", "select n_name, s_suppkey from supplier right join nation on s_nationkey = n_nationkey")
A("join_full", "select a.k as ak, b.k as bk from (select c_nationkey as k from customer) a full join (select s_nationkey as k from supplier) b on a.k = b.k")
A("join_full_theta", "select a.k as ak, b.k as bk from (values (1), (2), (5)) a(k) full join (values (2), (3)) b(k) on a.k > b.k")
A("join_using", "select k, a.v as av, b.v as bv from (values (1, 'x'), (2, 'y')) a(k, v) full join (values (2, 'z'), (3, 'w')) b(k, v) using (k)")
A("join_natural", "select k, v, w from (values (1, 'x'), (2, 'y')) a(k, v) natural join (values (2, 'z'), (1, 'w')) b(k, w)")
A("join_theta", "select count(*) as n from part a join part b on a.p_size < b.p_size")
A("join_self", "select a.n_name as a, b.n_name as b from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")
A("join_null_keys", "select a.v as av, b.v as bv from (values (1), (null)) a(v) join (values (1), (null)) b(v) on a.v = b.v")
A("join_semi_exists", "select c_custkey from customer c where exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_totalprice > 350000)")
A("join_anti_not_exists", "select c_custkey from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey)")
A("join_not_in_nulls", "select count(*) as n from nation where n_nationkey not in (select v from (values (1), (null)) t(v))")
A("join_or_factored", "select count(*) as n from lineitem, part where (p_partkey = l_partkey and p_size < 10 and l_quantity < 10) or (p_partkey = l_partkey and p_size > 40 and l_quantity > 40)")
A("join_lateral", "select c_custkey, t.m from customer, lateral (select max(o_totalprice) as m from orders where o_custkey = c_custkey) t")

# aggregates
A("agg_basic", "select l_returnflag, count(*) as n, count(l_tax) as nt, min(l_quantity) as mn, max(l_shipdate) as mx, round(sum(l_extendedprice), 2) as s, round(avg(l_discount), 6) as a from lineitem group by l_returnflag")
A("agg_no_group", "select count(*) as n, sum(l_linenumber)::bigint as s, min(l_orderkey) as m from lineitem")
A("agg_empty", "select count(*) as n, sum(n_nationkey)::bigint as s, avg(n_nationkey)::double precision as a, max(n_name) as m from nation where n_nationkey < 0")
A("agg_exact_average", "select o_custkey, (avg(o_orderkey))::double precision as a, (sum(o_orderkey))::double precision as s from orders group by o_custkey")
A("agg_distinct", "select l_returnflag, count(distinct l_suppkey) as n, sum(distinct l_linenumber)::bigint as s from lineitem group by l_returnflag")
A("agg_group_expr_ordinal", "select extract(year from o_orderdate)::int as y, o_orderstatus, count(*) as n from orders group by 1, o_orderstatus")
A("agg_group_alias", "select upper(c_mktsegment) as seg, count(*) as n from customer group by seg")
A("agg_having", "select l_orderkey, sum(l_quantity) as q from lineitem group by l_orderkey having sum(l_quantity) > 220")
A("agg_string_agg", "select n_regionkey, string_agg(n_name, ',' order by n_name) as names from nation group by n_regionkey")
A("agg_array_agg", "select k, array_agg(v order by v) as a from (values (1, 3), (1, 1), (2, 5)) t(k, v) group by k")
A("agg_array_agg_nulls", "select k, array_length(array_agg(v), 1)::bigint as n from (values (1, 3), (1, null), (2, 5)) t(k, v) group by k", "select k, count(*) as n from (values (1, 3), (1, null), (2, 5)) t(k, v) group by k")
A("agg_filter", "select o_orderstatus, count(*) filter (where o_totalprice > 100000) as big, count(*) as n from orders group by o_orderstatus")
A("agg_stats", "select l_returnflag, round(stddev(l_quantity), 6) as sd, round(var_pop(l_quantity), 5) as vp, round(corr(l_quantity, l_extendedprice), 6) as c from lineitem group by l_returnflag")
A("agg_bool_bit", "select c_mktsegment, bool_and(c_acctbal > 0) as a, bool_or(c_acctbal > 9900) as o, bit_or(c_nationkey) as b from customer group by c_mktsegment")
A("agg_percentile", "select l_returnflag, percentile_cont(0.5) within group (order by l_quantity) as m, percentile_disc(0.25) within group (order by l_quantity) as d from lineitem group by l_returnflag",
  "select l_returnflag, quantile_cont(l_quantity, 0.5) as m, quantile_disc(l_quantity, 0.25) as d from lineitem group by l_returnflag")
A("agg_rollup", "select n_regionkey, n_name, count(*) as n from nation group by rollup (n_regionkey, n_name)")
A("agg_cube", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by cube (l_returnflag, l_linestatus)")
A("agg_grouping_sets", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by grouping sets ((l_returnflag), (l_linestatus), ())")
A("agg_float_keys", "select case when v = 'NaN'::double precision then 'nan' else 'zero' end as k, count(*) as n from (values ('NaN'::double precision), ('NaN'::double precision), (0.0::double precision), (-0.0::double precision)) t(v) group by v", "select * from (values ('nan', 2), ('zero', 2)) t(k, n)")

# windows
A("win_ranking", "select o_orderkey, row_number() over w as rn, rank() over w as r, dense_rank() over w as d from (select o_orderkey, o_orderpriority, o_custkey from orders) t window w as (partition by o_orderpriority order by o_custkey, o_orderkey)")
A("win_peers_share", "select n_nationkey, sum(n_regionkey) over (order by n_regionkey)::bigint as s, count(*) over (partition by n_regionkey) as c from nation")
A("win_average", "select n_nationkey, (avg(n_nationkey) over (partition by n_regionkey))::double precision as a from nation")
A("win_frame_rows", "select o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row), 2) as s from orders")
A("win_lag_lead", "select o_orderkey, lag(o_orderkey) over w as p, lead(o_orderkey, 2) over w as n, first_value(o_orderkey) over w as f from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)")
A("win_ntile", "select n_nationkey, ntile(4) over (order by n_nationkey) as q from nation")
A("win_over_group", "select c_nationkey, count(*) as n, rank() over (order by count(*) desc, c_nationkey) as r from customer group by c_nationkey")
A("win_named_base", "select n_nationkey, row_number() over (w order by n_name) as rn from nation window w as (partition by n_regionkey)")
A("win_null_partition", "select k, v, sum(v) over (partition by k)::bigint as s from (values (1, 2), (null, 3), (null, 4)) t(k, v)")

# sort, limit, distinct
A("sort_nulls", "select v, row_number() over (order by v) as a, row_number() over (order by v desc) as d, row_number() over (order by v nulls first) as f from (values (1), (null), (3)) t(v)",
  "select v, row_number() over (order by v nulls last) as a, row_number() over (order by v desc nulls first) as d, row_number() over (order by v nulls first) as f from (values (1), (null), (3)) t(v)")
A("sort_top_k", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10")
A("sort_offset", "select n_nationkey from nation order by 1 limit 5 offset 7")
A("sort_hidden_column", "select n_name from nation order by n_regionkey desc, n_nationkey limit 4")
A("limit_fetch", "select n_nationkey from nation order by n_nationkey fetch first 3 rows only", "select n_nationkey from nation order by n_nationkey limit 3")
A("distinct_rows", "select distinct l_returnflag, l_linestatus from lineitem")
A("distinct_on_first", "select distinct on (o_custkey) o_custkey, o_orderkey, o_totalprice from orders order by o_custkey, o_totalprice desc, o_orderkey")

# set operations
A("set_union_all", "select n_regionkey as k from nation union all select r_regionkey from region")
A("set_union", "select n_regionkey as k from nation union select c_nationkey from customer order by k")
A("set_union_types", "select 1 as v union all select 2.5 union all select null", "select cast(1 as decimal(12,1)) as v union all select 2.5 union all select null")
A("set_intersect_except", "(select n_nationkey as k from nation intersect select c_nationkey from customer) union all (select n_nationkey from nation except select c_nationkey from customer)")

# subqueries
A("sub_scalar", "select n_name, (select count(*) from customer where c_nationkey = n_nationkey) as n from nation")
A("sub_scalar_compare", "select o_orderkey from orders where o_totalprice > (select 2 * avg(o_totalprice) from orders)")
A("sub_in", "select c_custkey from customer where c_nationkey in (select n_nationkey from nation where n_regionkey = 2)")
A("sub_in_select_list", "select v, v in (select n_nationkey from nation) as i, v not in (select n_nationkey from nation) as ni from (values (1), (99), (null)) t(v)")
A("sub_any_all", "select v, v > any (select n_regionkey from nation) as a, v >= all (select n_regionkey from nation) as b, v = any (select n_regionkey from nation) as c from (values (0), (4), (9)) t(v)")
A("sub_all_empty", "select v, v > all (select n_regionkey from nation where n_nationkey < 0) as a, v > any (select n_regionkey from nation where n_nationkey < 0) as b from (values (1), (null)) t(v)")
A("sub_correlated_agg", "select l_orderkey, l_linenumber from lineitem l where l_quantity > (select 1.5 * avg(l2.l_quantity) from lineitem l2 where l2.l_partkey = l.l_partkey)")
A("sub_count_bug", "select n_nationkey from nation where 0 = (select count(*) from supplier where s_nationkey = n_nationkey)")
A("sub_array", "select r_regionkey, array_length(array(select n_nationkey from nation where n_regionkey = r_regionkey), 1)::bigint as n from region", "select r_regionkey, count(*) as n from region join nation on n_regionkey = r_regionkey group by r_regionkey")
A("cte_recursive", "with recursive r(n) as (select 1 union all select n + 1 from r where n < 20) select n from r")

# table functions
A("srf_generate_series", "select g from generate_series(1, 10, 3) as t(g)")
A("srf_generate_series_down", "select g from generate_series(10, 1, -4) as t(g)")
A("srf_generate_series_empty", "select count(*) as n from generate_series(5, 1) as t(g)")
A("srf_generate_series_time", "select g from generate_series(timestamp '2024-01-01', timestamp '2024-01-03', interval '12 hours') as t(g)")
A("srf_unnest", "select v from unnest(array[3, 1, 2]) as t(v)")
A("srf_ordinality", "select v, o from unnest(array['x', 'y']) with ordinality as t(v, o)", "select unnest(['x', 'y']) as v, cast(unnest([1, 2]) as bigint) as o")
A("srf_lockstep", "select unnest(array[1, 2]) as a, generate_series(1, 3) as b", "select unnest([1, 2, null]) as a, unnest([1, 2, 3]) as b")
A("srf_subscripts", "select s from generate_subscripts(array[5, 6, 7], 1) as t(s)", "select unnest([1, 2, 3]) as s")
A("srf_join", "select n_name, g from nation, generate_series(1, 2) as t(g)")


def queries() -> dict:
    return T.queries()


def oracle_sql() -> dict:
    return T.oracle
