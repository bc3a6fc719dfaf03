"""Intervals of months, days and microseconds as struct columns, with their canonical order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.patterns import parse_interval

DAY = 86_400_000_000
MONTH = 30 * DAY


def make(months, days, micros) -> Column:
    c = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(c(months).cast("int").alias("months"), c(days).cast("int").alias("days"), c(micros).cast("long").alias("micros"))


def literal(text: str, *fields: str) -> Column:
    """interval 'text' [fields]."""
    return make(*parse_interval(text, tuple(fields)))


def span(i: Column) -> Column:
    """The canonical length by which intervals compare: months of 30 days, days of 24 hours."""
    return i["months"].cast("decimal(38,0)") * MONTH + i["days"].cast("decimal(38,0)") * DAY + i["micros"]


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often `use` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def add(a: Column, b: Column) -> Column:
    return make(a["months"] + b["months"], a["days"] + b["days"], a["micros"] + b["micros"])


def negate(a: Column) -> Column:
    return make(-a["months"], -a["days"], -a["micros"])


def subtract(a: Column, b: Column) -> Column:
    return add(a, negate(b))


def multiply(a: Column, f) -> Column:
    """Fractions of months become days, fractions of days become time."""
    return let(a, lambda x: _multiply(x, f))


def _multiply(a: Column, f) -> Column:
    f = f if isinstance(f, Column) else F.lit(float(f))
    months, days = a["months"] * f, a["days"] * f
    m = F.signum(months) * F.floor(F.abs(months))
    rest = days + (months - m) * 30
    d = F.signum(rest) * F.floor(F.abs(rest) + F.lit(1e-9))
    return make(m, d, F.rint((rest - d) * DAY + a["micros"] * f))


def divide(a: Column, f) -> Column:
    return multiply(a, 1 / (f if isinstance(f, Column) else F.lit(float(f))))


def _whole(x: Column, unit: int) -> Column:
    """x / unit, towards zero."""
    return (F.signum(x) * F.floor(F.abs(x) / unit)).cast("long")


def justify_hours(i: Column) -> Column:
    return let(i, _justify_hours)


def _justify_hours(i: Column) -> Column:
    d = _whole(i["micros"], DAY)
    days, rest = i["days"] + d, i["micros"] - d * DAY
    up = (days > 0) & (rest < 0)
    down = (days < 0) & (rest > 0)
    return make(i["months"], F.when(up, days - 1).when(down, days + 1).otherwise(days), F.when(up, rest + DAY).when(down, rest - DAY).otherwise(rest))


def justify_days(i: Column) -> Column:
    return let(i, _justify_days)


def _justify_days(i: Column) -> Column:
    m = _whole(i["days"], 30)
    months, rest = i["months"] + m, i["days"] - m * 30
    up = (months > 0) & (rest < 0)
    down = (months < 0) & (rest > 0)
    return make(F.when(up, months - 1).when(down, months + 1).otherwise(months), F.when(up, rest + 30).when(down, rest - 30).otherwise(rest), i["micros"])


def justify_interval(i: Column) -> Column:
    """Days of 24 hours and months of 30 days, then one sign for all three where that is possible."""

    def carried(x: Column) -> Column:
        days = x["days"] + _whole(x["micros"], DAY)
        months = _whole(days, 30)
        return make(x["months"] + months, days - months * 30, x["micros"] - _whole(x["micros"], DAY) * DAY)

    def borrowed_months(x: Column) -> Column:
        m, d, t = x["months"], x["days"], x["micros"]
        down = (m > 0) & ((d < 0) | ((d == 0) & (t < 0)))
        up = (m < 0) & ((d > 0) | ((d == 0) & (t > 0)))
        return make(F.when(down, m - 1).when(up, m + 1).otherwise(m), F.when(down, d + 30).when(up, d - 30).otherwise(d), t)

    def borrowed_days(x: Column) -> Column:
        d, t = x["days"], x["micros"]
        down, up = (d > 0) & (t < 0), (d < 0) & (t > 0)
        return make(x["months"], F.when(down, d - 1).when(up, d + 1).otherwise(d), F.when(down, t + DAY).when(up, t - DAY).otherwise(t))

    return let(let(let(i, carried), borrowed_months), borrowed_days)


def add_to(ts: Column, i: Column) -> Column:
    """timestamp + interval: months with the day held to the month's end, then days, then time."""
    base = F.add_months(F.to_date(ts), i["months"])
    day = F.date_add(base, i["days"])
    clock = F.unix_micros(ts.cast("timestamp")) - F.unix_micros(F.to_date(ts).cast("timestamp"))
    out = F.timestamp_micros(F.unix_micros(day.cast("timestamp")) + clock + i["micros"]).cast("timestamp_ntz")
    return out


def between(later: Column, earlier: Column) -> Column:
    """timestamp - timestamp: days and time, no months."""
    us = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    d = _whole(us, DAY)
    return make(F.lit(0), d, us - d * DAY)


def age(later: Column, earlier: Column) -> Column:
    """The difference field by field, borrowing from the months' lengths."""
    swap = later < earlier
    pair = F.struct(F.when(swap, earlier).otherwise(later).alias("a"), F.when(swap, later).otherwise(earlier).alias("b"))
    out = let(pair, lambda p: _age(p["a"], p["b"]))
    return F.when(swap, negate(out)).otherwise(out)


def _age(a: Column, b: Column) -> Column:
    us = lambda t: F.unix_micros(t.cast("timestamp")) - F.unix_micros(F.to_date(t).cast("timestamp"))
    clock = us(a) - us(b)
    borrow_day = (clock < 0).cast("int")
    days = F.dayofmonth(a) - F.dayofmonth(b) - borrow_day
    borrow_month = (days < 0).cast("int")
    days = days + borrow_month * F.dayofmonth(F.last_day(F.to_date(b)))
    months = (F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b) - borrow_month
    return make(months, days, clock + borrow_day * DAY)


def text(i: Column) -> Column:
    """The output form: years, mons, days and a clock."""
    return let(i, _text)


def _text(i: Column) -> Column:
    plural = lambda n, word: F.when(n != 0, F.concat(n.cast("string"), F.lit(" " + word), F.when(n == 1, "").otherwise("s")))
    y, m = _whole(i["months"], 12), i["months"] - _whole(i["months"], 12) * 12
    us = F.abs(i["micros"])
    h, mi, s, f = us / 3_600_000_000, us / 60_000_000 % 60, us / 1_000_000 % 60, us % 1_000_000
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    hours = F.when(h >= 100, F.floor(h).cast("string")).otherwise(two(h))
    part = F.when(f > 0, F.concat(F.lit("."), F.rtrim(F.lpad(f.cast("string"), 6, "0"), F.lit("0")))).otherwise("")
    clock = F.concat(F.when(i["micros"] < 0, "-").otherwise(""), hours, F.lit(":"), two(mi), F.lit(":"), two(s), part)
    shown = F.when((i["micros"] != 0) | ((i["months"] == 0) & (i["days"] == 0)), clock)
    return F.concat_ws(" ", plural(y, "year"), plural(m, "mon"), plural(i["days"], "day"), shown)
