"""Civil-date buckets: salary cycles from the 25th to the 24th and weeks from Sunday, in Riyadh's local time."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

ZONE = "Asia/Riyadh"
ANCHOR_DAY = 25
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def local_ts(ts, zone: str = ZONE) -> Column:
    """The wall clock in the zone of a timestamp_ntz that is in UTC."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), _col(ts))


def local_date(ts, zone: str = ZONE) -> Column:
    return F.to_date(local_ts(ts, zone))


def period_start(d) -> Column:
    month = F.trunc(_col(d), "month")
    return F.when(F.day(_col(d)) >= ANCHOR_DAY, F.date_add(month, ANCHOR_DAY - 1)).otherwise(F.date_add(F.add_months(month, -1), ANCHOR_DAY - 1))


def period_end(d) -> Column:
    """The last day, itself in the cycle."""
    return F.date_add(F.add_months(period_start(d), 1), -1)


def period_label(d) -> Column:
    """A cycle has the name of the month it ends in, whatever the locale."""
    end = period_end(d)
    return F.concat_ws(" ", F.element_at(F.array(*map(F.lit, MONTHS)), F.month(end)), F.year(end).cast("string"))


def week_start(d) -> Column:
    return F.date_sub(_col(d), F.dayofweek(_col(d)) - 1)


def day_of_week(d) -> Column:
    """0 is Sunday."""
    return F.dayofweek(_col(d)) - 1


def effective_cycle(ts, override) -> Column:
    """An override moves a leg to another cycle; a week has none."""
    return F.coalesce(_col(override), period_start(local_date(ts)))


def add_cycles(cycle, n: int) -> Column:
    return F.add_months(_col(cycle), n)


def days_in_cycle(cycle) -> Column:
    return F.datediff(period_end(cycle), _col(cycle)) + 1


def days_elapsed(start, end, today) -> Column:
    """Days from start to today, both counted, within the bucket."""
    total = F.datediff(_col(end), _col(start)) + 1
    return F.least(total, F.greatest(F.lit(0), F.datediff(_col(today), _col(start)) + 1))


def short_label(d) -> Column:
    """Day and short month, as in 25 Jul."""
    return F.concat_ws(" ", F.day(_col(d)).cast("string"), F.substring(F.element_at(F.array(*map(F.lit, MONTHS)), F.month(_col(d))), 1, 3))


def civil_short(d, today) -> Column:
    """Day and short month, with the year if it isn't today's."""
    return F.concat(short_label(d), F.when(F.year(_col(d)) == F.year(_col(today)), "").otherwise(F.concat(F.lit(" "), F.year(_col(d)).cast("string"))))


def day_label(d, today) -> Column:
    """Today, Yesterday, or the weekday and the day."""
    back = F.datediff(_col(today), _col(d))
    return F.when(back == 0, "Today").when(back == 1, "Yesterday").otherwise(F.concat(F.date_format(_col(d), "EEE"), F.lit(" "), civil_short(d, today)))


def salary_cycle(due, received) -> Column:
    """The cycle a salary funds: that of its due date MM/DD, in January's year if it is announced in December."""
    received = _col(received)
    month, day = F.split_part(_col(due), F.lit("/"), F.lit(1)).cast("int"), F.split_part(_col(due), F.lit("/"), F.lit(2)).cast("int")
    year = F.year(received) + F.when((F.month(received) == 12) & (month == 1), 1).otherwise(0)
    return period_start(F.make_date(year, month, day))


def snapped_cycle(d, days: int = 5) -> Column:
    """Opt-in: a salary without a due date that comes within days before a boundary funds the cycle after it."""
    following = F.add_months(period_start(d), 1)
    return F.when(F.datediff(following, _col(d)) <= days, following).otherwise(period_start(d))


def register_sql(spark: SparkSession) -> None:
    """The same functions for SQL text."""
    for text in (
        "local_date(ts TIMESTAMP_NTZ) RETURNS DATE RETURN to_date(convert_timezone('UTC', 'Asia/Riyadh', ts))",
        "period_start(d DATE) RETURNS DATE RETURN CASE WHEN day(d) >= 25 THEN date_add(trunc(d, 'month'), 24) ELSE date_add(add_months(trunc(d, 'month'), -1), 24) END",
        "period_end(d DATE) RETURNS DATE RETURN date_add(add_months(period_start(d), 1), -1)",
        "week_start(d DATE) RETURNS DATE RETURN date_sub(d, dayofweek(d) - 1)",
        "effective_cycle(ts TIMESTAMP_NTZ, o DATE) RETURNS DATE RETURN coalesce(o, period_start(local_date(ts)))",
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")


# the same rules for parameters, which are plain dates


def cycle_of(day: dt.date) -> dt.date:
    if day.day >= ANCHOR_DAY:
        return day.replace(day=ANCHOR_DAY)
    return (day.replace(day=1) - dt.timedelta(days=1)).replace(day=ANCHOR_DAY)


def shifted(cycle: dt.date, cycles: int) -> dt.date:
    month = cycle.year * 12 + cycle.month - 1 + cycles
    return cycle.replace(year=month // 12, month=month % 12 + 1)


def week_of(day: dt.date) -> dt.date:
    return day - dt.timedelta(days=(day.weekday() + 1) % 7)


def bounds(grain: str, day: dt.date) -> tuple[dt.date, dt.date]:
    """First and last day of the bucket that day is in."""
    if grain == "week":
        return week_of(day), week_of(day) + dt.timedelta(days=6)
    start = cycle_of(day)
    return start, shifted(start, 1) - dt.timedelta(days=1)


def stepped(grain: str, day: dt.date, n: int) -> dt.date:
    return week_of(day) + dt.timedelta(days=7 * n) if grain == "week" else shifted(cycle_of(day), n)


def reanchored(grain: str, day: dt.date, today: dt.date) -> dt.date:
    """Switching the grain keeps the day in view: today if it is inside the bucket shown, else its first day."""
    start, end = bounds("week" if grain == "cycle" else "cycle", day)
    return bounds(grain, today if start <= today <= end else start)[0]
