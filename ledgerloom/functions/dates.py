"""Dates and times of statements, always strict: what cannot be read is null, never midnight."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (shape, Spark pattern, precision) in the order in which they are tried.
_DATE_SHAPES = (
    (r"^\d{8}$", "yyyyMMdd", "day"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d", "day"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d", "day"),
    (r"^\d{4}\.\d{1,2}\.\d{1,2}$", "yyyy.M.d", "day"),
    (r"^\d{4}年\d{1,2}月\d{1,2}日$", "yyyy年M月d日", "day"),
    (r"^\d{14}$", "yyyyMMddHHmmss", "second"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-M-d H:m:s", "second"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}$", "yyyy-M-d H:m", "minute"),
    (r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "yyyy/M/d H:m:s", "second"),
    (r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{1,2}$", "yyyy/M/d H:m", "minute"),
    (r"^\d{8} \d{1,2}:\d{1,2}:\d{1,2}$", "yyyyMMdd H:m:s", "second"),
    (r"^\d{8} \d{1,2}:\d{1,2}$", "yyyyMMdd H:m", "minute"),
    (r"^\d{4}年\d{1,2}月\d{1,2}日 \d{1,2}:\d{1,2}:\d{1,2}$", "yyyy年M月d日 H:m:s", "second"),
    (r"^\d{4}年\d{1,2}月\d{1,2}日 \d{1,2}:\d{1,2}$", "yyyy年M月d日 H:m", "minute"),
)
_TIME_SHAPES = ((r"^\d{1,2}:\d{1,2}:\d{1,2}$", "H:m:s", "second"), (r"^\d{1,2}:\d{1,2}$", "H:m", "minute"), (r"^\d{6}$", "HHmmss", "second"))


def date_struct(value: Column) -> Column:
    """struct(at, precision): ISO text to the precision read (day, minute or second); null if none."""
    s = F.regexp_replace(F.regexp_replace(F.trim(value.cast("string")), "\n", ""), "T", " ")
    found = None
    for shape, pattern, precision in _DATE_SHAPES:
        at = F.try_to_timestamp(F.when(s.rlike(shape), s), F.lit(pattern)).cast("timestamp_ntz")
        text = F.date_format(at, "yyyy-MM-dd" if precision == "day" else "yyyy-MM-dd HH:mm:ss")
        this = F.when(at.isNotNull(), F.struct(text.alias("at"), F.lit(precision).alias("precision")))
        found = this if found is None else F.coalesce(found, this)
    return found


def time_struct(value: Column) -> Column:
    """struct(at, precision) of a clock time: HH:mm:ss text; null if none."""
    s = F.regexp_replace(value.cast("string"), r"\s", "")
    found = None
    for shape, pattern, precision in _TIME_SHAPES:
        at = F.try_to_timestamp(F.when(s.rlike(shape), s), F.lit(pattern)).cast("timestamp_ntz")
        this = F.when(at.isNotNull(), F.struct(F.date_format(at, "HH:mm:ss").alias("at"), F.lit(precision).alias("precision")))
        found = this if found is None else F.coalesce(found, this)
    return found


def day_fraction_time(fraction: Column) -> Column:
    """The clock time of a spreadsheet's fraction of a day, rounded to seconds; null outside [0, 1)."""
    seconds = F.rint(fraction * 86400).cast("long")
    part = lambda x: F.lpad(x.cast("string"), 2, "0")
    text = F.concat_ws(":", part(F.floor(seconds / 3600)), part(F.floor(seconds % 3600 / 60)), part(seconds % 60))
    return F.when((fraction >= 0) & (fraction < 1) & (seconds < 86400), text)


def with_clock(date: Column, clock_cell: Column, has_clock: Column) -> Column:
    """struct(at, precision, issue) of a date struct and a separate time cell."""
    clock = time_struct(clock_cell)
    stated = has_clock & ~F.coalesce(F.trim(clock_cell.cast("string")), F.lit("")).isin("", "-", "--", "—", "/", "无", "N/A", "null")
    both = clock.isNotNull() & date.isNotNull()
    clash = both & (date["precision"] != "day") & (F.substring(date["at"], 12, 8) != clock["at"])
    joined = F.concat_ws(" ", F.substring(date["at"], 1, 10), clock["at"])
    use = stated & both & ~clash
    return F.struct(
        F.when(use, joined).otherwise(date["at"]).alias("at"),
        F.when(use, clock["precision"]).otherwise(date["precision"]).alias("precision"),
        F.when(stated & clash, "TIME_CONFLICT").when(stated & ~both, "TIME_INVALID").alias("issue"),
    )
