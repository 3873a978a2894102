"""Clock and date parsing (B12-B17, F1-F3, F7-F9) as native expressions.

Spark's TIME type is not available here, so times of day stay ``HH:mm``
strings and minute-of-day integers. ANSI mode is on, hence ``try_*`` parses.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The departure-time layouts seen in the source files.
DEP_TIME_FORMATS = ("HH:mm", "HH:mm:ss", "yyyy-MM-dd HH:mm:ss")

# Length of the shortest string of a layout (years may have more than four digits).
SHORTEST = {"yyyy-MM-dd HH:mm:ss": 19, "yyyy-MM-dd": 10}

# The three inclusive service slots (lexicographic on HH:mm).
TIME_SLOTS = (("07:00", "09:00"), ("13:00", "15:00"), ("18:00", "20:00"))


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_clock(c) -> Column:
    """Timestamp for a departure string in any known layout, else null. Hours to
    seconds take two digits each and years at least four, so the length tells the one
    layout that can fit: a failed parse raises inside Spark, which costs many times a
    good one."""
    c = _col(c)
    n = F.length(c)
    short, long, full = DEP_TIME_FORMATS
    return (F.when(n == len(short), F.try_to_timestamp(c, F.lit(short)))
             .when(n == len(long), F.try_to_timestamp(c, F.lit(long)))
             .when(n >= len(full), F.try_to_timestamp(c, F.lit(full))))


def hour_of(c) -> Column:
    return F.hour(parse_clock(c))


def minute_of(c) -> Column:
    return F.minute(parse_clock(c))


def minute_of_day(c) -> Column:
    ts = parse_clock(c)
    return F.hour(ts) * 60 + F.minute(ts)


def split_hms(c) -> tuple[Column, Column, Column]:
    """``HH:mm:ss`` split into three integers (missing seconds -> 0; a part
    that is no number -> null)."""
    parts = F.split(_col(c), ":")
    sec = F.try_element_at(parts, F.lit(3))
    return (F.try_element_at(parts, F.lit(1)).try_cast("int"),
            F.try_element_at(parts, F.lit(2)).try_cast("int"),
            F.when(sec.isNull(), F.lit(0)).otherwise(sec.try_cast("int")))


def clock_in_range(hh: Column, mm: Column, ss: Column) -> Column:
    """0 <= hh < 24, 0 <= mm < 60, 0 <= ss < 60."""
    return ((hh >= 0) & (hh < 24) & (mm >= 0) & (mm < 60)
            & (ss >= 0) & (ss < 60))


def two_format_timestamp(c, full: str = "yyyy-MM-dd HH:mm:ss",
                         date_only: str = "yyyy-MM-dd") -> Column:
    """Full layout, else date-only layout, else null (strings shorter than a
    layout can't have it and are not tried)."""
    c = _col(c)
    return F.coalesce(*[F.when(F.length(c) >= SHORTEST.get(f, 0), F.try_to_timestamp(c, F.lit(f)))
                        for f in (full, date_only)])


def minute_text(c) -> Column:
    """Reformat any departure layout (or a bare date, = midnight) to
    ``HH:mm``; unparsable values -> null."""
    c = _col(c)
    ts = F.coalesce(parse_clock(c), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")))
    return F.date_format(ts, "HH:mm")


def date_text(c) -> Column:
    """First ten characters parsed as a date, written ``yyyy-MM-dd``."""
    return F.date_format(F.try_to_date(F.substring(_col(c), 1, 10), "yyyy-MM-dd"),
                         "yyyy-MM-dd")


def in_slots(c, slots=TIME_SLOTS) -> Column:
    """Inclusive lexicographic slot test on the departure string."""
    c = _col(c)
    cond = F.lit(False)
    for lo, hi in slots:
        cond = cond | c.between(lo, hi)
    return cond


def tod_class(hour: Column, default: int = 2) -> Column:
    """F8: 0-5 -> 0, 6-11 -> 1, 12-17 -> 2, 18-23 -> 3, otherwise ``default``."""
    return (F.when((hour >= 0) & (hour < 6), 0)
             .when((hour >= 6) & (hour < 12), 1)
             .when((hour >= 12) & (hour < 18), 2)
             .when((hour >= 18) & (hour < 24), 3)
             .otherwise(default))


def peak_flag(hour: Column, evening_start: int = 18) -> Column:
    """7 <= h < 10 or evening_start <= h < 20 (holding uses 17); null -> 0."""
    return F.coalesce((((hour >= 7) & (hour < 10)) |
                       ((hour >= evening_start) & (hour < 20))).cast("int"), F.lit(0))


def weekend_flag(day_type: Column) -> Column:
    """DAY_TYPE 1 (Sunday) or 7 (Saturday); null -> 0."""
    return F.coalesce(day_type.isin(1, 7).cast("int"), F.lit(0))
