"""Geometric types as structs of doubles: point(x, y), lseg(a, b), box(high, low), line(a, b, c),
circle(center, radius), path(closed, points), polygon(points). Comparisons allow EPSILON.

Every function takes and returns Columns and stays in Catalyst; paths and polygons use higher-order
functions over their arrays of points.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .interval import let

EPSILON = 1.0e-6
LEAST = F.least
MOST = F.greatest


def _n(v) -> Column:
    return v.cast("double") if isinstance(v, Column) else F.lit(float(v))


def eq(a, b) -> Column:
    return F.abs(a - b) <= EPSILON


def lt(a, b) -> Column:
    return b - a > EPSILON


def le(a, b) -> Column:
    return a - b <= EPSILON


# construction
def point(x, y) -> Column:
    return F.struct(_n(x).alias("x"), _n(y).alias("y"))


def lseg(a: Column, b: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"))


def box(a: Column, b: Column | None = None) -> Column:
    b = a if b is None else b
    return F.struct(point(MOST(a["x"], b["x"]), MOST(a["y"], b["y"])).alias("high"), point(LEAST(a["x"], b["x"]), LEAST(a["y"], b["y"])).alias("low"))


def line(p: Column, q: Column) -> Column:
    """Ax + By + C = 0 through two points."""
    vertical = eq(p["x"], q["x"])
    m = (q["y"] - p["y"]) / (q["x"] - p["x"])
    a = F.when(vertical, -1.0).otherwise(m)
    b = F.when(vertical, 0.0).otherwise(-1.0)
    c = F.when(vertical, p["x"]).otherwise(p["y"] - m * p["x"])
    return F.struct(a.alias("a"), b.alias("b"), c.alias("c"))


def circle(center: Column, radius) -> Column:
    return F.struct(center.alias("center"), _n(radius).alias("radius"))


def path(points: Column, closed: bool = True) -> Column:
    return F.struct(F.lit(closed).alias("closed"), points.alias("points"))


def polygon(points: Column) -> Column:
    return F.struct(points.alias("points"))


# points
def point_add(p, q):
    return point(p["x"] + q["x"], p["y"] + q["y"])


def point_sub(p, q):
    return point(p["x"] - q["x"], p["y"] - q["y"])


def point_mul(p, q):
    return point(p["x"] * q["x"] - p["y"] * q["y"], p["x"] * q["y"] + p["y"] * q["x"])


def point_div(p, q):
    n = q["x"] * q["x"] + q["y"] * q["y"]
    return point((p["x"] * q["x"] + p["y"] * q["y"]) / n, (p["y"] * q["x"] - p["x"] * q["y"]) / n)


def point_distance(p, q):
    return F.hypot(p["x"] - q["x"], p["y"] - q["y"])


def point_same(p, q):
    return eq(p["x"], q["x"]) & eq(p["y"], q["y"])


def left_of(p, q):
    return lt(p["x"], q["x"])


def right_of(p, q):
    return lt(q["x"], p["x"])


def above(p, q):
    return lt(q["y"], p["y"])


def below(p, q):
    return lt(p["y"], q["y"])


def horizontal(p, q):
    return eq(p["y"], q["y"])


def vertical(p, q):
    return eq(p["x"], q["x"])


def slope(p, q):
    return F.when(vertical(p, q), F.lit(float("inf"))).when(horizontal(p, q), 0.0).otherwise((p["y"] - q["y"]) / (p["x"] - q["x"]))


# segments
def lseg_length(s):
    return point_distance(s["a"], s["b"])


def lseg_center(s):
    return point((s["a"]["x"] + s["b"]["x"]) / 2, (s["a"]["y"] + s["b"]["y"]) / 2)


def _direction(s):
    return s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]


def lseg_parallel(s, t):
    (ax, ay), (bx, by) = _direction(s), _direction(t)
    return eq(ax * by, ay * bx)


def lseg_perpendicular(s, t):
    (ax, ay), (bx, by) = _direction(s), _direction(t)
    return eq(ax * bx, -(ay * by))


def closest_on_lseg(p, s):
    return let(F.struct(p.alias("p"), s.alias("s")), lambda v: _closest_on_lseg(v["p"], v["s"]))


def _closest_on_lseg(p, s):
    dx, dy = _direction(s)
    n = dx * dx + dy * dy
    t = F.when(n == 0, 0.0).otherwise(((p["x"] - s["a"]["x"]) * dx + (p["y"] - s["a"]["y"]) * dy) / n)
    t = LEAST(MOST(t, F.lit(0.0)), F.lit(1.0))
    return point(s["a"]["x"] + t * dx, s["a"]["y"] + t * dy)


def point_lseg_distance(p, s):
    return let(closest_on_lseg(p, s), lambda c: point_distance(p, c))


def point_on_lseg(p, s):
    return eq(point_distance(p, s["a"]) + point_distance(p, s["b"]), lseg_length(s))


def _crossing(s, t):
    """(do the segments' lines cross once, parameter on s, parameter on t)."""
    (ax, ay), (bx, by) = _direction(s), _direction(t)
    det = ax * by - ay * bx
    dx, dy = t["a"]["x"] - s["a"]["x"], t["a"]["y"] - s["a"]["y"]
    safe = F.when(det == 0, None).otherwise(det)
    return det != 0, (dx * by - dy * bx) / safe, (dx * ay - dy * ax) / safe


def lseg_intersection(s, t):
    """The common point, NULL if none or if parallel."""
    return let(F.struct(s.alias("s"), t.alias("t")), lambda v: _lseg_intersection(v["s"], v["t"]))


def _lseg_intersection(s, t):
    ok, u, v = _crossing(s, t)
    dx, dy = _direction(s)
    inside = ok & le(F.lit(0.0), u) & le(u, F.lit(1.0)) & le(F.lit(0.0), v) & le(v, F.lit(1.0))
    return F.when(inside, point(s["a"]["x"] + u * dx, s["a"]["y"] + u * dy))


def lseg_intersects(s, t):
    touch = point_on_lseg(s["a"], t) | point_on_lseg(s["b"], t) | point_on_lseg(t["a"], s) | point_on_lseg(t["b"], s)
    return lseg_intersection(s, t).isNotNull() | touch


def lseg_distance(s, t):
    return F.when(lseg_intersects(s, t), 0.0).otherwise(_apart(s, t))


def _apart(s, t):
    """The distance of segments that do not meet: that of an end to the other."""
    return LEAST(point_lseg_distance(s["a"], t), point_lseg_distance(s["b"], t), point_lseg_distance(t["a"], s), point_lseg_distance(t["b"], s))


# lines
def line_of(s):
    return line(s["a"], s["b"])


def line_parallel(l, m):
    return eq(l["a"] * m["b"], l["b"] * m["a"])


def line_perpendicular(l, m):
    return eq(l["a"] * m["a"], -(l["b"] * m["b"]))


def line_intersection(l, m):
    det = l["a"] * m["b"] - m["a"] * l["b"]
    safe = F.when(det == 0, None).otherwise(det)
    return F.when(~line_parallel(l, m), point((l["b"] * m["c"] - m["b"] * l["c"]) / safe, (l["c"] * m["a"] - m["c"] * l["a"]) / safe))


def line_distance(l, m):
    ratio = F.when(m["a"] != 0, l["a"] / m["a"]).otherwise(l["b"] / m["b"])
    return F.when(line_parallel(l, m), F.abs(l["c"] - ratio * m["c"]) / F.hypot(l["a"], l["b"])).otherwise(0.0)


def point_line_distance(p, l):
    return F.abs(l["a"] * p["x"] + l["b"] * p["y"] + l["c"]) / F.hypot(l["a"], l["b"])


def closest_on_line(p, l):
    n = l["a"] * l["a"] + l["b"] * l["b"]
    k = (l["a"] * p["x"] + l["b"] * p["y"] + l["c"]) / n
    return point(p["x"] - l["a"] * k, p["y"] - l["b"] * k)


def point_on_line(p, l):
    return eq(l["a"] * p["x"] + l["b"] * p["y"] + l["c"], F.lit(0.0))


def line_same(l, m):
    return line_parallel(l, m) & eq(l["a"] * m["c"], m["a"] * l["c"]) & eq(l["b"] * m["c"], m["b"] * l["c"])


# boxes
def box_width(b):
    return b["high"]["x"] - b["low"]["x"]


def box_height(b):
    return b["high"]["y"] - b["low"]["y"]


def box_area(b):
    return box_width(b) * box_height(b)


def box_center(b):
    return point((b["high"]["x"] + b["low"]["x"]) / 2, (b["high"]["y"] + b["low"]["y"]) / 2)


def box_diagonal(b):
    return lseg(b["high"], b["low"])


def bound_box(b, c):
    return box(point(MOST(b["high"]["x"], c["high"]["x"]), MOST(b["high"]["y"], c["high"]["y"])), point(LEAST(b["low"]["x"], c["low"]["x"]), LEAST(b["low"]["y"], c["low"]["y"])))


def box_overlaps(b, c):
    return le(b["low"]["x"], c["high"]["x"]) & le(c["low"]["x"], b["high"]["x"]) & le(b["low"]["y"], c["high"]["y"]) & le(c["low"]["y"], b["high"]["y"])


def box_intersection(b, c):
    return let(F.struct(b.alias("b"), c.alias("c")), lambda v: _box_intersection(v["b"], v["c"]))


def _box_intersection(b, c):
    high = point(LEAST(b["high"]["x"], c["high"]["x"]), LEAST(b["high"]["y"], c["high"]["y"]))
    low = point(MOST(b["low"]["x"], c["low"]["x"]), MOST(b["low"]["y"], c["low"]["y"]))
    return F.when(box_overlaps(b, c), F.struct(high.alias("high"), low.alias("low")))


def box_contains(b, c):
    return le(c["high"]["x"], b["high"]["x"]) & le(b["low"]["x"], c["low"]["x"]) & le(c["high"]["y"], b["high"]["y"]) & le(b["low"]["y"], c["low"]["y"])


def box_contains_point(b, p):
    return (p["x"] <= b["high"]["x"]) & (p["x"] >= b["low"]["x"]) & (p["y"] <= b["high"]["y"]) & (p["y"] >= b["low"]["y"])


def box_same(b, c):
    return point_same(b["high"], c["high"]) & point_same(b["low"], c["low"])


def box_left(b, c):
    return lt(b["high"]["x"], c["low"]["x"])


def box_right(b, c):
    return lt(c["high"]["x"], b["low"]["x"])


def box_over_left(b, c):
    return le(b["high"]["x"], c["high"]["x"])


def box_over_right(b, c):
    return le(c["low"]["x"], b["low"]["x"])


def box_below(b, c):
    return lt(b["high"]["y"], c["low"]["y"])


def box_above(b, c):
    return lt(c["high"]["y"], b["low"]["y"])


def box_over_below(b, c):
    return le(b["high"]["y"], c["high"]["y"])


def box_over_above(b, c):
    return le(c["low"]["y"], b["low"]["y"])


def box_distance(b, c):
    """From centre to centre."""
    return point_distance(box_center(b), box_center(c))


def closest_on_box(p, b):
    x = LEAST(MOST(p["x"], b["low"]["x"]), b["high"]["x"])
    y = LEAST(MOST(p["y"], b["low"]["y"]), b["high"]["y"])
    return point(x, y)


def point_box_distance(p, b):
    return point_distance(p, closest_on_box(p, b))


def box_shift(b, p, sign: int = 1):
    f = point_add if sign > 0 else point_sub
    return box(f(b["high"], p), f(b["low"], p))


def box_scale(b, p):
    return box(point_mul(b["high"], p), point_mul(b["low"], p))


def box_circle(b):
    c = box_center(b)
    return circle(c, point_distance(c, b["high"]))


def box_polygon(b):
    h, l = b["high"], b["low"]
    return polygon(F.array(point(l["x"], l["y"]), point(l["x"], h["y"]), point(h["x"], h["y"]), point(h["x"], l["y"])))


# circles
def circle_area(c):
    return c["radius"] * c["radius"] * F.pi()


def circle_diameter(c):
    return c["radius"] * 2


def circle_distance(c, d):
    return MOST(point_distance(c["center"], d["center"]) - c["radius"] - d["radius"], F.lit(0.0))


def circle_overlaps(c, d):
    return le(point_distance(c["center"], d["center"]), c["radius"] + d["radius"])


def circle_contains(c, d):
    return le(point_distance(c["center"], d["center"]) + d["radius"], c["radius"])


def circle_contains_point(c, p):
    return point_distance(c["center"], p) <= c["radius"]


def circle_same(c, d):
    return point_same(c["center"], d["center"]) & eq(c["radius"], d["radius"])


def point_circle_distance(p, c):
    return MOST(point_distance(p, c["center"]) - c["radius"], F.lit(0.0))


def circle_left(c, d):
    return lt(c["center"]["x"] + c["radius"], d["center"]["x"] - d["radius"])


def circle_below(c, d):
    return lt(c["center"]["y"] + c["radius"], d["center"]["y"] - d["radius"])


def circle_box(c):
    d = c["radius"] / F.sqrt(F.lit(2.0))
    return box(point(c["center"]["x"] + d, c["center"]["y"] + d), point(c["center"]["x"] - d, c["center"]["y"] - d))


def circle_polygon(c, n: int = 12):
    import math

    corner = lambda k: point(c["center"]["x"] - c["radius"] * math.cos(2 * math.pi * k / n), c["center"]["y"] + c["radius"] * math.sin(2 * math.pi * k / n))
    return polygon(F.array(*map(corner, range(n))))


def circle_shift(c, p, sign: int = 1):
    return circle((point_add if sign > 0 else point_sub)(c["center"], p), c["radius"])


def circle_scale(c, p):
    return circle(point_mul(c["center"], p), c["radius"] * F.hypot(p["x"], p["y"]))


# paths and polygons
def n_points(shape):
    return F.size(shape["points"])


def _edges(points: Column, closed) -> Column:
    """array<struct<a, b>> of neighbouring points, and from the last to the first where closed."""
    following = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    every = F.zip_with(points, following, lambda a, b: lseg(a, b))
    keep = F.when(closed, F.size(points)).otherwise(F.size(points) - 1)
    return F.slice(every, F.lit(1), F.greatest(keep, F.lit(0)))


def edges(shape, is_path: bool = False) -> Column:
    return _edges(shape["points"], shape["closed"] if is_path else F.lit(True))


def path_length(p):
    return F.aggregate(edges(p, True), F.lit(0.0), lambda s, e: s + lseg_length(e))


def _twice_area(points):
    return F.aggregate(_edges(points, F.lit(True)), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])


def path_area(p):
    return F.when(p["closed"], F.abs(_twice_area(p["points"])) / 2)


def path_open(p):
    return path(p["points"], False)


def path_close(p):
    return path(p["points"], True)


def path_concat(p, q):
    return F.when(~p["closed"] & ~q["closed"], path(F.concat(p["points"], q["points"]), False))


def path_shift(p, by, sign: int = 1):
    f = point_add if sign > 0 else point_sub
    return F.struct(p["closed"].alias("closed"), F.transform(p["points"], lambda x: f(x, by)).alias("points"))


def polygon_center(g):
    sums = F.aggregate(g["points"], point(0, 0), lambda s, p: point_add(s, p))
    return point(sums["x"] / n_points(g), sums["y"] / n_points(g))


def polygon_box(g):
    xs, ys = F.transform(g["points"], lambda p: p["x"]), F.transform(g["points"], lambda p: p["y"])
    return box(point(F.array_max(xs), F.array_max(ys)), point(F.array_min(xs), F.array_min(ys)))


def polygon_circle(g):
    c = polygon_center(g)
    total = F.aggregate(g["points"], F.lit(0.0), lambda s, p: s + point_distance(p, c))
    return circle(c, total / n_points(g))


def polygon_contains_point(g, p):
    """On the outline, or inside by the crossing rule."""
    on = F.exists(edges(g), lambda e: point_on_lseg(p, e))
    crosses = F.filter(
        edges(g),
        lambda e: ((e["a"]["y"] > p["y"]) != (e["b"]["y"] > p["y"]))
        & (p["x"] < (e["b"]["x"] - e["a"]["x"]) * (p["y"] - e["a"]["y"]) / F.when(e["b"]["y"] == e["a"]["y"], None).otherwise(e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]),
    )
    return on | (F.size(crosses) % 2 == 1)


def polygon_contains(g, h):
    crossing = F.exists(edges(g), lambda e: F.exists(edges(h), lambda f: lseg_intersection(e, f).isNotNull() & ~point_on_lseg(f["a"], e) & ~point_on_lseg(f["b"], e)))
    return F.forall(h["points"], lambda p: polygon_contains_point(g, p)) & ~crossing


def polygon_overlaps(g, h):
    meet = F.exists(edges(g), lambda e: F.exists(edges(h), lambda f: lseg_intersects(e, f)))
    return meet | polygon_contains_point(g, F.get(h["points"], F.lit(0))) | polygon_contains_point(h, F.get(g["points"], F.lit(0)))


def polygon_distance(g, h):
    return let(F.struct(g.alias("g"), h.alias("h")), lambda v: _polygon_distance(v["g"], v["h"]))


def _polygon_distance(g, h):
    pairs = F.flatten(F.transform(edges(g), lambda e: F.transform(edges(h), lambda f: _apart(e, f))))
    return F.when(polygon_overlaps(g, h), 0.0).otherwise(F.array_min(pairs))


def polygon_point_distance(g, p):
    return F.when(polygon_contains_point(g, p), 0.0).otherwise(F.array_min(F.transform(edges(g), lambda e: point_lseg_distance(p, e))))


def path_distance(p, q):
    return F.array_min(F.flatten(F.transform(edges(p, True), lambda e: F.transform(edges(q, True), lambda f: lseg_distance(e, f)))))


def path_point_distance(p, x):
    return F.array_min(F.transform(edges(p, True), lambda e: point_lseg_distance(x, e)))


def path_contains_point(p, x):
    on = F.exists(edges(p, True), lambda e: point_on_lseg(x, e))
    return on | (p["closed"] & polygon_contains_point(p, x))


def path_intersects(p, q):
    return F.exists(edges(p, True), lambda e: F.exists(edges(q, True), lambda f: lseg_intersects(e, f)))


def polygon_same(g, h):
    """The same points in the same or the opposite order, from any start."""
    n = n_points(g)
    twice = F.concat(h["points"], h["points"])
    back = F.reverse(twice)
    turns = F.sequence(F.lit(1), n)
    match = lambda ring: F.exists(turns, lambda k: F.forall(F.zip_with(g["points"], F.slice(ring, k, n), point_same), lambda t: t))
    return (n == n_points(h)) & (match(twice) | match(back))


# segments, lines and boxes against each other
def lseg_same(s, t):
    return point_same(s["a"], t["a"]) & point_same(s["b"], t["b"])


def _nearest(*pairs) -> Column:
    """The point of the (distance, point) with the least distance."""
    return F.array_min(F.array(*[F.struct(d.alias("d"), p.alias("p")) for d, p in pairs]))["p"]


def closest_on_other_lseg(s, t):
    """The point of t that is closest to s."""
    ends = _nearest((point_lseg_distance(s["a"], t), closest_on_lseg(s["a"], t)), (point_lseg_distance(s["b"], t), closest_on_lseg(s["b"], t)), (point_lseg_distance(t["a"], s), t["a"]), (point_lseg_distance(t["b"], s), t["b"]))
    return F.coalesce(lseg_intersection(s, t), ends)


def line_intersects(l, m):
    return ~line_parallel(l, m)


def lseg_on_line(s, l):
    return point_on_line(s["a"], l) & point_on_line(s["b"], l)


def _side(p, l):
    return l["a"] * p["x"] + l["b"] * p["y"] + l["c"]


def lseg_crosses_line(s, l):
    a, b = _side(s["a"], l), _side(s["b"], l)
    return ((a <= EPSILON) & (b >= -EPSILON)) | ((a >= -EPSILON) & (b <= EPSILON))


def lseg_line_distance(s, l):
    return F.when(lseg_crosses_line(s, l), 0.0).otherwise(F.least(point_line_distance(s["a"], l), point_line_distance(s["b"], l)))


def closest_on_lseg_to_line(s, l):
    near = F.when(point_line_distance(s["a"], l) <= point_line_distance(s["b"], l), s["a"]).otherwise(s["b"])
    return F.when(lseg_crosses_line(s, l), F.coalesce(line_intersection(line_of(s), l), s["a"])).otherwise(near)


def box_edges(b) -> Column:
    high, low = b["high"], b["low"]
    corners = [low, point(low["x"], high["y"]), high, point(high["x"], low["y"])]
    return F.array(*[lseg(p, q) for p, q in zip(corners, corners[1:] + corners[:1], strict=True)])


def box_meets_line(b, l):
    return F.exists(box_edges(b), lambda e: lseg_crosses_line(e, l))


def box_below_eq(b, c):
    return le(b["high"]["y"], c["low"]["y"])


def box_above_eq(b, c):
    return le(c["high"]["y"], b["low"]["y"])


def lseg_in_box(s, b):
    return box_contains_point(b, s["a"]) & box_contains_point(b, s["b"])


def lseg_meets_box(s, b):
    return box_contains_point(b, s["a"]) | box_contains_point(b, s["b"]) | F.exists(box_edges(b), lambda e: lseg_intersects(s, e))


def lseg_box_distance(s, b):
    return F.when(lseg_meets_box(s, b), 0.0).otherwise(F.array_min(F.transform(box_edges(b), lambda e: _apart(s, e))))


def closest_on_box_to_lseg(s, b):
    """The point of the box that is closest to the segment; where they meet, the segment's closest to the centre."""
    near = F.array_min(F.transform(box_edges(b), lambda e: F.struct(lseg_distance(s, e).alias("d"), closest_on_other_lseg(s, e).alias("p"))))["p"]
    return F.when(lseg_meets_box(s, b), closest_on_lseg(box_center(b), s)).otherwise(near)


def path_scale(p, by):
    return F.struct(p["closed"].alias("closed"), F.transform(p["points"], lambda x: point_mul(x, by)).alias("points"))


def circle_bounds(c):
    """The box around a circle."""
    x, y, r = c["center"]["x"], c["center"]["y"], c["radius"]
    return box(point(x + r, y + r), point(x - r, y - r))


def circle_polygon_distance(c, g):
    return F.greatest(polygon_point_distance(g, c["center"]) - c["radius"], F.lit(0.0))


def all_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a & b, tests)
