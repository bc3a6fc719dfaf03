"""Intervals, geometry and text search through the Column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo as g
from ..functions import interval as iv
from ..functions import textsearch as ts


def interval_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of mixed units by their canonical length."""
    texts = ["1 month", "30 days", "29 days 24 hours", "1 year", "360 days", "-1 day", "1 mon 2 days 03:04:05.5"]
    rows = spark.range(1)
    for i, t in enumerate(texts):
        one = spark.range(1).select(F.lit(i).alias("i"), iv.literal(t).alias("v"))
        rows = one if i == 0 else rows.unionAll(one)
    month = iv.literal("1 month")
    return rows.select("i", iv.text(F.col("v")).alias("shown"), (iv.span(F.col("v")) == iv.span(month)).alias("same"), (iv.span(F.col("v")) > iv.span(month)).alias("longer"))


def interval_justify(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = iv.literal("1 mon 35 days 27:30:00")
    ts1, ts2 = F.lit("2024-03-31 10:00:00").cast("timestamp_ntz"), F.lit("2023-12-15 12:30:00").cast("timestamp_ntz")
    return spark.range(1).select(
        iv.text(iv.justify_hours(v)).alias("hours"),
        iv.text(iv.justify_days(v)).alias("days"),
        iv.text(iv.justify_interval(v)).alias("both"),
        iv.text(iv.multiply(iv.literal("1 month 1 day"), 1.5)).alias("times"),
        iv.text(iv.between(ts1, ts2)).alias("diff"),
        iv.text(iv.age(ts1, ts2)).alias("age"),
        iv.add_to(F.lit("2024-01-31 10:00:00").cast("timestamp_ntz"), iv.literal("1 month 1 day 2 hours")).alias("sum"),
    )


def geo_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances and containment of customers placed by their keys."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", g.point(F.col("c_custkey") % 17, F.col("c_nationkey")).alias("p"))
    home, b, ring = g.point(8, 12), g.box(g.point(3, 4), g.point(12, 20)), g.circle(g.point(8, 12), 5)
    s = g.lseg(g.point(0, 0), g.point(16, 24))
    return c.select(
        "c_custkey",
        F.round(g.point_distance(F.col("p"), home), 9).alias("d"),
        g.box_contains_point(b, F.col("p")).alias("in_box"),
        g.circle_contains_point(ring, F.col("p")).alias("in_ring"),
        F.round(g.point_lseg_distance(F.col("p"), s), 9).alias("to_segment"),
        g.left_of(F.col("p"), home).alias("is_left"),
        g.above(F.col("p"), home).alias("is_above"),
    )


def geo_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, c = g.box(g.point(0, 0), g.point(4, 3)), g.box(g.point(2, 1), g.point(6, 6))
    both = g.box_intersection(b, c)
    tri = g.polygon(F.array(g.point(0, 0), g.point(4, 0), g.point(0, 3)))
    walk = g.path(F.array(g.point(0, 0), g.point(3, 4), g.point(3, 10)), closed=False)
    l1, l2 = g.line(g.point(0, 0), g.point(1, 1)), g.line(g.point(0, 2), g.point(2, 0))
    s1, s2 = g.lseg(g.point(0, 0), g.point(2, 2)), g.lseg(g.point(0, 2), g.point(2, 0))
    r = F.round
    return spark.range(1).select(
        g.box_area(b).alias("area"), g.box_width(c).alias("width"), g.box_overlaps(b, c).alias("overlaps"), g.box_area(both).alias("shared"), g.box_contains(b, c).alias("holds"),
        r(g.box_distance(b, c), 9).alias("apart"), g.polygon_contains_point(tri, g.point(1, 1)).alias("inside"), g.polygon_contains_point(tri, g.point(3, 3)).alias("outside"),
        g.path_area(g.path(tri["points"])).alias("tri_area"), g.path_length(walk).alias("walked"), g.path_area(walk).isNull().alias("open_area"), g.n_points(tri).alias("corners"),
        g.line_intersection(l1, l2)["x"].alias("meet_x"), g.line_perpendicular(l1, l2).alias("perp"), g.line_parallel(l1, l2).alias("par"), g.lseg_intersection(s1, s2)["y"].alias("cross_y"),
        r(g.circle_area(g.circle(g.point(0, 0), 2)), 9).alias("disc"), g.circle_overlaps(g.circle(g.point(0, 0), 2), g.circle(g.point(3, 0), 1)).alias("touch"),
        r(g.polygon_distance(tri, g.polygon(F.array(g.point(10, 0), g.point(12, 0), g.point(11, 3)))), 9).alias("gap"), g.polygon_box(tri)["high"]["x"].alias("reach"), g.slope(g.point(0, 0), g.point(2, 4)).alias("slope"),
        g.point_mul(g.point(1, 2), g.point(3, 4))["x"].alias("mul_x"), g.polygon_same(tri, g.polygon(F.array(g.point(0, 3), g.point(0, 0), g.point(4, 0)))).alias("turned"),
    )


def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = ts.vector("fat:2A cat:3 sat:4B 'on':5 mat:6")
    queries = ["fat & cat", "fat & dog", "fat | dog", "!dog", "cat:A", "fat:A", "ca:*", "fat <-> cat", "fat <2> sat", "cat <-> fat", "!(fat & cat)"]
    rows = [F.struct(F.lit(q).alias("q"), ts.matches(v, q).alias("hit"), F.lit(ts.n_nodes(q)).alias("nodes")) for q in queries]
    return spark.range(1).select(F.inline(F.array(*rows)))


def text_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of nation names' parts, filtered and counted."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").withColumn("v", ts.from_array(F.split(F.lower("n_name"), "_")))
    return n.select("n_nationkey", ts.length(F.col("v")).alias("words"), F.array_join(ts.to_array(F.col("v")), " ").alias("lexemes"), ts.matches(F.col("v"), "nation & 3").alias("hit"), ts.length(ts.delete(F.col("v"), "nation")).alias("rest"))


ALL = (interval_compare, interval_justify, geo_points, geo_shapes, text_search, text_vectors)

ORACLE = {
    "interval_compare": "select * from (values (0, '1 mon', true, false), (1, '30 days', true, false), (2, '29 days 24:00:00', true, false), (3, '1 year', false, true), (4, '360 days', false, true), (5, '-1 days', false, false), (6, '1 mon 2 days 03:04:05.5', false, true)) t(i, shown, same, longer)",
    "interval_justify": "select '1 mon 36 days 03:30:00' as hours, '2 mons 5 days 27:30:00' as days, '2 mons 6 days 03:30:00' as both, '1 mon 16 days 12:00:00' as times, '106 days 21:30:00' as diff, '3 mons 15 days 21:30:00' as age, timestamp '2024-03-01 12:00:00' as sum",
    "geo_points": """with p as (select c_custkey, cast(c_custkey % 17 as double) as x, cast(c_nationkey as double) as y from customer), q as (select *, least(1.0, greatest(0.0, (x * 16 + y * 24) / (16 * 16 + 24 * 24))) as t from p)
        select c_custkey, round(sqrt((x - 8) * (x - 8) + (y - 12) * (y - 12)), 9) as d, x between 3 and 12 and y between 4 and 20 as in_box, sqrt((x - 8) * (x - 8) + (y - 12) * (y - 12)) <= 5 as in_ring,
        round(sqrt((x - 16 * t) * (x - 16 * t) + (y - 24 * t) * (y - 24 * t)), 9) as to_segment, x < 8 as is_left, y > 12 as is_above from q""",
    "geo_shapes": """select 12.0::double as area, 4.0::double as width, true as overlaps, 4.0::double as shared, false as holds, round(sqrt(8.0), 9) as apart, true as inside, false as outside, 6.0::double as tri_area, 11.0::double as walked, true as open_area,
        3 as corners, 1.0::double as meet_x, true as perp, false as par, 1.0::double as cross_y, round(4 * pi(), 9) as disc, true as touch, 6.0::double as gap, 4.0::double as reach, 2.0::double as slope, -5.0::double as mul_x, true as turned""",
    "text_search": "select * from (values ('fat & cat', true, 3), ('fat & dog', false, 3), ('fat | dog', true, 3), ('!dog', true, 2), ('cat:A', false, 1), ('fat:A', true, 1), ('ca:*', true, 1), ('fat <-> cat', true, 3), ('fat <2> sat', true, 3), ('cat <-> fat', false, 3), ('!(fat & cat)', false, 4)) t(q, hit, nodes)",
    "text_vectors": "select n_nationkey, cast(len(list_distinct(string_split(lower(n_name), '_'))) as int) as words, array_to_string(list_sort(list_distinct(string_split(lower(n_name), '_'))), ' ') as lexemes, n_name = 'NATION_3' as hit, cast(1 as int) as rest from nation",
}


def queries() -> dict:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict:
    return dict(ORACLE)
