"""Statement files to records and issues as one job: formats, rows, headers, dispositions, normalisation.

Headers are found for all segments at once: every row's cells meet the fixed alias table, candidates
are scored, and a window gives each row the header that stands before it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.text import header_norm, meaningful
from ..lineage import cut
from ..sources.statements import csv_rows, file_format, read_files
from ..sources.workbooks import workbook_rows
from .headers import best_header, date_like, header_scores, map_headers, match_profiles, row_disposition
from .mapping import MAPPING, USER_PROFILE, confirmed_mappings
from .normalize import LAYOUT, TEXT_FIELDS, WARNINGS, normalize_rows

#: The cells that normalize_rows() takes, by the field of the header.
CELLS = {
    "transaction_at": "cell_date",
    "transaction_time": "cell_time",
    "booking_at": "cell_booking",
    "booking_time": "cell_booking_time",
    "amount": "cell_amount",
    "signed_amount": "cell_signed",
    "credit_amount": "cell_credit",
    "debit_amount": "cell_debit",
    "direction": "cell_direction",
    "currency": "cell_currency",
    "transaction_status": "cell_status",
    "balance": "cell_balance",
} | {f: f"cell_{f}" for f in TEXT_FIELDS}
#: Headers whose second line counts as part of them, and headers that are kept, not mapped.
GROUP_HEADERS = ("收入", "支出", "借方", "贷方")
RETAINED_HEADERS = ("序号", "钞汇", "对方账号与户名")
#: Warnings about files and segments.
FILE_WARNINGS = ("DUPLICATE_FILE", "EXTENSION_MISMATCH", "HEADER_INHERITED", "DATA_BEFORE_HEADER", "SEGMENT_NOT_TABULAR")
#: Rows within which a segment's header is looked for.
HEADER_WITHIN = 200


@dataclass
class Import:
    """files: one row per file with status and counts. raw_rows: every row with its disposition.
    records: canonical records with lineage. issues: (file_id, raw_id, code, severity).
    mappings: the segments that a mapping is for, with the rule that it breaks."""

    files: DataFrame
    raw_rows: DataFrame
    records: DataFrame
    issues: DataFrame
    mappings: DataFrame | None = None


def find_headers(rows: DataFrame, mapped: DataFrame | None = None) -> DataFrame:
    """(segment_id, line, depth, headers) of the headers of each segment: the best one of its first
    rows, and later rows that are headers again.

    rows: (segment_id, line, values). A header may take two lines; the first's group headers carry over.
    mapped: confirmed_mappings() of the rows. The header of a mapped segment is the row that its mapping
    names, and later rows that are headers again; one whose mapping is wrong has none.
    """
    after = Window.partitionBy("segment_id").orderBy("line")
    paired = rows.select("segment_id", "line", "values", F.lead("values").over(after).alias("below"), (F.row_number().over(after) - 1).alias("place"))
    clean = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda v: F.trim(F.coalesce(v, F.lit(""))))
    two = F.transform(F.sequence(F.lit(0), F.greatest(F.size("_a"), F.size("_b"), F.lit(1)) - 1), lambda i: F.struct(F.coalesce(F.get("_a", i), F.lit("")).alias("top"), F.coalesce(F.get("_b", i), F.lit("")).alias("bottom")))
    carried = F.aggregate(
        two,
        F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("out")),
        lambda s, x: F.struct(F.when(x["top"] != "", x["top"]).otherwise(s["last"]).alias("last"), F.concat(s["out"], F.array(_joined(F.when((x["top"] == "") & s["last"].isin(*GROUP_HEADERS), s["last"]).otherwise(x["top"]), x["bottom"]))).alias("out")),
        lambda s: s["out"],
    )
    single = paired.select("segment_id", "line", "place", F.lit(1).alias("depth"), clean(F.col("values")).alias("headers"))
    double = paired.where((F.col("place") < HEADER_WITHIN) & F.col("below").isNotNull()).select("segment_id", "line", "place", F.lit(2).alias("depth"), clean(F.col("values")).alias("_a"), clean(F.col("below")).alias("_b")).withColumn("headers", carried).drop("_a", "_b")
    candidates = single.unionByName(double).where("size(headers) > 0").withColumn("candidate", F.concat_ws("\n", "segment_id", "line", "depth"))
    candidates = cut(candidates)
    scored = header_scores(map_headers(candidates, "candidate"), "candidate").join(candidates.drop("headers"), "candidate")
    scored = cut(scored.withColumn("score", F.col("score") + 0.1 * (F.col("depth") - 1)).where("usable"))
    first = best_header(scored, "segment_id", "place", "depth", HEADER_WITHIN).select("segment_id", F.col("place").alias("_start"), F.col("depth").alias("_depth"), "candidate")
    again = scored.where("depth = 1").join(first.select("segment_id", "_start", "_depth"), "segment_id").where(F.col("place") >= F.col("_start") + F.col("_depth")).select("candidate")
    shown = ["candidate", "segment_id", "line", "depth", "headers"]
    found = candidates.join(first.select("candidate").union(again), "candidate", "left_semi").select(*shown, F.lit(None).cast(f"struct<{_typed(MAPPING)}>").alias("user"))
    if mapped is None:
        return found
    right = mapped.where("problem IS NULL")
    named = right.select(F.concat_ws("\n", "segment_id", "line", F.lit("user")).alias("candidate"), "segment_id", "line", F.lit(1).alias("depth"), "headers", "user")
    later = scored.where("depth = 1").join(right.select("segment_id", F.col("line").alias("_from")), "segment_id").where(F.col("line") > F.col("_from")).select("candidate")
    repeated = candidates.join(later, "candidate", "left_semi").select(*shown, F.lit(None).cast(f"struct<{_typed(MAPPING)}>").alias("user"))
    return found.join(mapped.select("segment_id"), "segment_id", "left_anti").unionByName(named).unionByName(repeated)


def _typed(columns: str) -> str:
    return ", ".join(part.replace(" ", ":", 1) for part in columns.split(", "))


def _joined(top: Column, bottom: Column) -> Column:
    return F.when((bottom != "") & (top != bottom), F.concat(top, bottom)).when(top != "", top).otherwise(bottom)


def inherit_headers(segments: DataFrame, tolerance: float = 3) -> DataFrame:
    """segments with inherited: the segment whose header a page's table without one takes over.

    segments: (file_id, place, segment_id, page, layout array<double>, width, mapped boolean,
    dated boolean), those of tables in file order. A table continues the one before it if it is on the
    same or the next page, has its width and column places, and starts with a date; a chain of them
    ends where one does not.
    """
    order = Window.partitionBy("file_id").orderBy("place")
    before = lambda c: F.lag(c).over(order)
    apart = F.exists(F.zip_with("layout", before("layout"), lambda a, b: F.coalesce(F.abs(a - b) > tolerance, F.lit(True))), lambda x: x)
    linked = (F.col("page") - before("page")).isin(0, 1) & (F.col("width") == before("width")) & (F.size("layout") == F.size(before("layout"))) & ~apart & F.col("dated")
    # A table that neither has a header nor continues one starts a chain of its own, without a header.
    starts = segments.withColumn("_start", F.col("mapped") | ~F.coalesce(linked, F.lit(False)))
    chained = starts.withColumn("_chain", F.sum(F.col("_start").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    head = F.first(F.when(F.col("mapped"), F.col("segment_id"))).over(Window.partitionBy("file_id", "_chain").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return chained.withColumn("inherited", F.when(~F.col("mapped"), head)).drop("_start", "_chain")


def with_layout(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Transaction rows (candidate, values, cell_types, formulas) with the cells and flags of their header."""
    mapped = map_headers(headers.where("user IS NULL"), "candidate")
    entry = F.struct("field", F.element_at("columns", 1).alias("column"))
    layout = mapped.groupBy("candidate").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.size("columns") == 1, entry)))).alias("columns"),
        F.array_sort(F.collect_list(F.when(F.size("columns") > 1, F.col("field")))).alias("ambiguous_fields"),
    )
    profiles = match_profiles(headers, "candidate").select("candidate", "profile", "source", F.col("currency").alias("default_currency"), F.col("signed").alias("signed_format"))
    said = lambda name: F.col(f"user.{name}")
    by_user = said("columns").isNotNull()
    codes = F.map_from_entries(F.array_distinct(F.transform(F.map_entries(said("direction_codes")), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), e["value"].alias("value")))))
    known = headers.select("candidate", "headers", "user").join(layout, "candidate", "left").join(profiles, "candidate", "left").withColumns(
        {
            "columns": F.coalesce(said("columns"), "columns"),
            "ambiguous_fields": F.coalesce("ambiguous_fields", F.array().cast("array<string>")),
            "profile": F.when(by_user, USER_PROFILE).otherwise(F.col("profile")),
            "source": F.when(by_user, said("source")).otherwise(F.col("source")),
            "default_currency": F.when(by_user, said("currency")).otherwise(F.col("default_currency")),
            "signed_format": F.when(by_user, said("amount_signed")).otherwise(F.col("signed_format")),
            "direction_codes": codes,
            "confirmed": by_user,
        }
    )
    joined = rows.join(known.drop("user"), "candidate").na.fill({"profile": "generic.v1", "signed_format": False})
    place = lambda f: F.try_element_at("columns", F.lit(f))
    fields = F.map_keys("columns")
    of_type = lambda kind: F.filter(fields, lambda f: F.coalesce(F.get("cell_types", F.element_at("columns", f)) == kind, F.lit(False)))
    beyond = F.slice("values", F.size("headers") + 1, F.greatest(F.size("values") - F.size("headers"), F.lit(0)))
    return joined.withColumns({cell: F.get("values", place(field)) for field, cell in CELLS.items()}).withColumns(
        {
            "mapped_fields": fields,
            "split": place("credit_amount").isNotNull() | place("debit_amount").isNotNull(),
            "numeric_fields": of_type("n"),
            "error_fields": of_type("e"),
            "formula_fields": F.filter(fields, lambda f: F.array_contains(F.map_keys("formulas"), F.element_at("columns", f))),
            "wider": F.exists(beyond, lambda v: F.trim(F.coalesce(v, F.lit(""))) != ""),
        }
    )


def enrich(records: DataFrame) -> DataFrame:
    """records (values, headers, columns, profile) with source_fields, unmapped_headers and hints.

    Every cell of the row is kept with its header and the fields that it went to. Two known banks' memo
    fills an empty counterparty or description, and says so in hinted_fields.
    """
    entries = F.map_entries("columns")
    header = lambda i: F.coalesce(F.get("headers", i), F.format_string("第 %d 列", i + 1))
    targets = lambda i: F.transform(F.filter(entries, lambda e: e["value"] == i), lambda e: e["key"])
    usage = lambda i: F.when(F.trim(header(i)).isin(*RETAINED_HEADERS), "retained").when(F.size(targets(i)) > 0, "mapped").otherwise("unmapped")
    cells = F.transform("values", lambda v, i: F.struct(i.alias("index"), header(i).alias("header"), v.alias("value"), targets(i).alias("targets"), usage(i).alias("usage")))
    unmapped = F.array_distinct(F.transform(F.filter("source_fields", lambda f: (f["usage"] == "unmapped") & meaningful(f["value"])), lambda f: f["header"]))
    out = records.withColumn("source_fields", cells).withColumn("unmapped_headers", unmapped)
    memo_header = F.regexp_replace(F.coalesce(F.get("headers", F.try_element_at("columns", F.lit("memo"))), F.lit("")), r"\s", "")
    says = meaningful(F.col("memo"))
    hints = {"counterparty": F.col("profile").startswith("ccb.account_activity.") & memo_header.isin("交易地点/附言", "交易地点附言") & says, "description": F.col("profile").startswith("boc.account_activity.") & says}
    filled = {f: F.when(hint & ~meaningful(F.col(f)), F.col("memo")).otherwise(F.col(f)) for f, hint in hints.items()}
    named = F.filter(F.array(*[F.when(hint & ~meaningful(F.col(f)), F.lit(f)) for f, hint in hints.items()]), lambda f: f.isNotNull())
    return out.withColumn("hinted_fields", named).withColumns(filled)


def import_segments(rows: DataFrame, mappings: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(raw rows with their disposition, records, mapped segments) of the rows of segments.

    rows: (sha256, file_id, path, segment, line, end_line, values, cell_types, formats, formulas), from
    files or from a table of segments that were extracted before. mappings: see confirmed_mappings().
    """
    rows = rows.withColumn("segment_id", F.concat_ws("\n", "file_id", "segment"))
    mapped = None if mappings is None else cut(confirmed_mappings(rows, mappings))
    headers = cut(find_headers(rows.select("segment_id", "line", "values"), mapped))
    marks = headers.select("segment_id", F.col("line").alias("h_line"), "depth", "candidate")
    order = Window.partitionBy("segment_id").orderBy("line")
    numbered = rows.join(marks, (rows["segment_id"] == marks["segment_id"]) & (rows["line"] == marks["h_line"]), "left").drop(marks["segment_id"])
    second = F.coalesce(F.lag(F.col("depth") == 2).over(order), F.lit(False))
    numbered = numbered.withColumns({"is_header": F.col("candidate").isNotNull() | second, "_active": F.last("candidate", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    raw_id = F.sha2(F.concat_ws("\n", "file_id", "segment", F.col("line").cast("string")), 256)
    raw = cut(row_disposition(numbered.drop("candidate")).withColumns({"raw_id": raw_id, "dated": date_like(F.col("values"))}).drop("h_line", "depth", "is_header"))

    given = with_layout(raw.where("disposition = 'transaction'").withColumnRenamed("_active", "candidate"), headers)
    records = enrich(normalize_rows(given)).withColumn("record_id", F.sha2(F.concat_ws("\n", "raw_id", F.col("candidate")), 256))
    kept = ["record_id", "raw_id", "file_id", "path", "segment", "line", "end_line", "headers", "columns", "profile", "source", "parse_status", "mapping_method", "transaction_at", "transaction_at_precision", "booking_at", "booking_at_precision", "amount", "signed_amount", "direction", "raw_direction", "currency", "balance", "transaction_status", "raw_status", *TEXT_FIELDS, "source_fields", "unmapped_headers", "hinted_fields", "issues"]
    records = cut(records.select(*kept))
    return raw, records, mapped


def import_statements(spark: SparkSession, path: str, allow_duplicates: bool = False, mappings: DataFrame | None = None) -> Import:
    """All statement files under a path.

    Files with the bytes of an earlier path are skipped unless allowed. A file that cannot be read has
    its issue and no rows. Delimited text and XLSX workbooks are read; other known formats are named in
    an issue. Every row is kept with its disposition; a file without records says so. mappings are the
    user's, by the digest of the file's bytes and the name of the segment (see confirmed_mappings()).
    """
    listed = read_files(spark, path).withColumn("f", file_format(F.col("path"), F.col("content"), F.col("length")))
    occurrence = F.row_number().over(Window.partitionBy("sha256").orderBy("path"))
    # Only names and digests meet in the window; the contents are read again where they are wanted.
    files = cut(listed.select("path", "length", "sha256", "f.format", F.col("f.issue").alias("read_issue")).withColumn("occurrence", occurrence))
    files = files.withColumns({"file_id": F.sha2(F.concat_ws(":", "sha256", "occurrence"), 256), "skipped": (F.col("occurrence") > 1) & F.lit(not allow_duplicates)})
    wanted = lambda fmt: listed.join(files.where(~F.col("skipped") & (F.col("format") == fmt)).select("path"), "path", "left_semi")
    text = csv_rows(wanted("csv")).withColumns({"segment": F.lit("csv"), "cell_types": F.transform("values", lambda _: F.lit("s")), "formats": F.array().cast("array<string>"), "formulas": F.create_map().cast("map<int,string>")})
    read = cut(text.unionByName(workbook_rows(wanted("xlsx"))).join(files.select("path", "file_id", "sha256"), "path"))

    raw, records, mapped = import_segments(read.where("issue IS NULL").drop("issue"), mappings)

    issue = lambda df, code, raw_col=None: df.select("file_id", (F.col(raw_col) if raw_col else F.lit(None).cast("string")).alias("raw_id"), code.alias("code"))
    unread = {"pdf": "PDF_LAYOUT_UNSUPPORTED", "png": "OCR_REQUIRED", "jpeg": "OCR_REQUIRED", "xls": "DEPENDENCY_MISSING"}
    later = F.try_element_at(F.create_map(*[F.lit(x) for pair in unread.items() for x in pair]), "format")
    headless = raw.where("disposition = 'unmapped'").groupBy("file_id", "segment_id").agg(F.max((F.size(F.filter("values", lambda v: F.trim(F.coalesce(v, F.lit(""))) != "")) >= 2) | F.col("dated")).alias("tabular"))
    tried = files.where("NOT skipped AND read_issue IS DISTINCT FROM 'FILE_TOO_LARGE'")
    issues = (
        issue(files.where("skipped"), F.lit("DUPLICATE_FILE"))
        .union(issue(files.where("NOT skipped AND read_issue IS NOT NULL"), F.col("read_issue")))
        .union(issue(files.where(~F.col("skipped") & later.isNotNull()), later))
        .union(issue(read.where("issue IS NOT NULL AND issue <> 'NO_TRANSACTIONS'"), F.col("issue")))
        .union(issue(headless, F.when(F.col("tabular"), "HEADER_UNRECOGNIZED").otherwise("SEGMENT_NOT_TABULAR")))
        .union(issue(raw.where("disposition = 'preamble' AND dated"), F.lit("DATA_BEFORE_HEADER"), "raw_id"))
        .union(issue(tried.join(records, "file_id", "left_anti"), F.lit("NO_TRANSACTIONS")))
        .union(records.select("file_id", "raw_id", F.explode("issues").alias("code")))
    )
    if mapped is not None:
        issues = issues.union(issue(mapped.where("problem IS NOT NULL"), F.lit("MAPPING_INVALID")))
    issues = cut(issues.withColumn("severity", F.when(F.col("code").isin(*WARNINGS, *FILE_WARNINGS), "warning").otherwise("error")))
    counted = records.groupBy("file_id").agg(F.count("*").alias("record_count"), F.count_if(F.col("parse_status") == "ready").alias("ready_count"))
    wrong = issues.where("severity = 'error'").select("file_id").distinct().withColumn("_wrong", F.lit(True))
    status = F.when(F.col("skipped"), "duplicate_file_skipped").when((F.col("record_count") > 0) & F.col("_wrong"), "partial").when(F.col("_wrong"), "failed").otherwise("completed")
    summary = files.join(counted, "file_id", "left").join(wrong, "file_id", "left").na.fill(0, ["record_count", "ready_count"]).na.fill(False, ["_wrong"]).withColumn("status", status)
    return Import(summary.drop("_wrong", "skipped"), raw.drop("_active", "segment_id", "dated"), records, issues, mapped)
