"""Mappings that a user confirms: which row of a segment is its header and which column is which field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .headers import ALIASES, MONEY_FIELDS

#: The directions that a code may stand for, and the profile of a mapped segment.
DIRECTIONS = ("in", "out", "none")
USER_PROFILE = "user.confirmed.v1"
#: A mapping for all segments of its file that have none of their own.
ANY_SEGMENT = "*"
#: What a mapping says, beside the file (sha256) and segment that it is for.
MAPPING = "header_line int, columns map<string,int>, currency string, amount_signed boolean, direction_codes map<string,string>, source string"


def _problem(said: Column, header: Column, number: Column) -> Column:
    """The first rule that a mapping breaks, null if none."""
    columns = F.coalesce(said["columns"], F.expr("map()").cast("map<string,int>"))
    fields, places = F.map_keys(columns), F.map_values(columns)
    any_of = lambda names: F.arrays_overlap(fields, F.array(*[F.lit(n) for n in names]))
    inside = lambda i: F.coalesce((i >= 0) & (i < F.size(header)), F.lit(False))
    codes = F.coalesce(F.map_values(said["direction_codes"]), F.array().cast("array<string>"))
    return (
        F.when(number > 1, "SEGMENT_MAPPED_TWICE")
        .when(said["header_line"].isNull() | header.isNull(), "HEADER_LINE_MISSING")
        .when(~F.forall(fields, lambda f: f.isin(*ALIASES)) | ~F.forall(places, inside), "COLUMN_UNKNOWN")
        .when(F.size(F.array_distinct(places)) < F.size(places), "COLUMN_REPEATED")
        .when(~(any_of(("transaction_at", "booking_at")) & any_of(MONEY_FIELDS)), "FIELDS_MISSING")
        .when(~F.forall(codes, lambda c: F.coalesce(c.isin(*DIRECTIONS), F.lit(False))), "DIRECTION_CODE_UNKNOWN")
    )


def confirmed_mappings(rows: DataFrame, mappings: DataFrame) -> DataFrame:
    """(segment_id, file_id, segment, line, headers, user, problem) of the segments that a mapping is for.

    rows: (sha256, file_id, segment, segment_id, line, values). mappings: sha256, segment and the
    columns of MAPPING. A mapping for the segment comes before one for all segments of the file. line
    and headers are those of the header row. problem names the rule that the mapping breaks; such a
    segment has no header at all, so that none of its rows is read by a guess. Two mappings for one
    segment of a file are a problem, not a choice. Null digests and segments map nothing.
    """
    said = F.struct(*[F.col(part.split()[0]) for part in MAPPING.split(", ")])
    given = mappings.groupBy("sha256", F.col("segment").alias("_for")).agg(F.count("*").alias("_n"), F.first(said).alias("user"))
    given = given.select("sha256", "_for", F.struct("_n", "user").alias("_given"))
    segments = rows.select("sha256", "file_id", "segment", "segment_id").distinct()
    own = segments.join(given.withColumnsRenamed({"_for": "segment", "_given": "_own"}), ["sha256", "segment"], "left")
    every = given.where(F.col("_for") == ANY_SEGMENT).select("sha256", F.col("_given").alias("_every"))
    chosen = own.join(every, "sha256", "left").withColumn("_given", F.coalesce("_own", "_every")).where("_given IS NOT NULL")
    chosen = chosen.select("segment_id", "file_id", "segment", "_given._n", "_given.user", F.col("_given.user.header_line").alias("line"))
    headed = chosen.join(rows.select("segment_id", "line", F.col("values").alias("headers")), ["segment_id", "line"], "left")
    return headed.select("segment_id", "file_id", "segment", "line", "headers", "user", _problem(F.col("user"), F.col("headers"), F.col("_n")).alias("problem"))
