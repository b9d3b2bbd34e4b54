"""Facts with their provenance, and time as half-open intervals of stated precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A fact: its value as text, where it is from, what refers to it, and whether sources disagree.
FACT = "struct<value:string,origin:string,references:array<string>,conflict:boolean>"
#: The intervals that a precision stands for.
STEPS = {"day": "INTERVAL 1 DAY", "minute": "INTERVAL 1 MINUTE", "second": "INTERVAL 1 SECOND"}


def is_known(fact: Column, trusted: tuple[str, ...]) -> Column:
    """Whether a fact counts: a value without conflict, of a trusted origin, with a reference."""
    said = F.coalesce(fact["value"], F.lit("")) != ""
    return F.coalesce(said & ~F.coalesce(fact["conflict"], F.lit(False)) & fact["origin"].isin(*trusted) & (F.size(fact["references"]) > 0), F.lit(False))


def known_facts(observations: DataFrame, trusted: tuple[str, ...], facts: str = "facts") -> DataFrame:
    """observations (facts map<string, FACT>) whose known facts are columns of a map known (value only)."""
    kept = F.map_filter(facts, lambda k, v: is_known(v, trusted))
    return observations.withColumn("known", F.transform_values(kept, lambda k, v: v["value"]))


def time_range(value: Column, precision: Column, basis: Column, role: Column | None = None) -> Column:
    """struct(start, end, basis, role) of a local time; null without a stated precision and basis.

    A day is the whole day, never its midnight.
    """
    at = value.try_cast("timestamp_ntz")
    start = F.when(precision == "day", F.date_trunc("day", at)).when(precision == "minute", F.date_trunc("minute", at)).when(precision == "second", F.date_trunc("second", at)).cast("timestamp_ntz")
    end = F.coalesce(*[F.when(precision == p, start + F.expr(step)) for p, step in STEPS.items()])
    stated = precision.isin(*STEPS) & (F.coalesce(basis, F.lit("")) != "") & start.isNotNull()
    return F.when(stated, F.struct(start.alias("start"), end.alias("end"), basis.alias("basis"), (F.lit("occurrence") if role is None else role).alias("role")))
