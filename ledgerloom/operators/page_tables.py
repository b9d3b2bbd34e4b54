"""Tables of recognised pages: from tokens with places to rows of cells, found by each page's own header line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from .ocr import column_bounds, row_bands
from .ocr_records import clean, header_field, ocr_date, ocr_rows_to_records

#: How far apart tokens of one header line are in heights, how far below it rows begin, the height of
#: the lines by which tokens of a cell are ordered.
SAME_LINE, BELOW, LINE = 0.7, 0.8, 8


def header_lines(tokens: DataFrame) -> DataFrame:
    """(page_id, header_y, header_h): the uppermost token that names the date column."""
    dates = tokens.where(header_field(F.col("text")) == "date").groupBy("page_id").agg(F.min(F.struct("y", "x", "h")).alias("top"))
    return dates.select("page_id", F.col("top.y").alias("header_y"), F.col("top.h").alias("header_h"))


def page_layouts(tokens: DataFrame, headers: DataFrame) -> DataFrame:
    """(page_id, field, left_x, right_x) of the columns that a page's header line names. Tokens of the line that name
    none still bound their neighbours."""
    on_line = F.abs(F.col("y") - F.col("header_y")) < F.greatest("h", "header_h") * SAME_LINE
    return column_bounds(tokens.join(headers, "page_id").where(on_line).select("page_id", "x", header_field(F.col("text")).alias("field")))


def table_from_tokens(tokens: DataFrame, pages: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, issues) of pages.

    tokens: (page_id, text, score, x, y, h, w), x and y being a token's centre. pages: (page_id, failed), all pages
    there are, failed where recognition broke off (default: those with a token).

    rows: page_id, row, cells map<field, text>, scores map<field, array<double>>, date_x, date_y, date_width and
    row_height. A row stands around each date below the header line, half way to its neighbours; its cells are all
    tokens of a column there, lines first, and each column of the page has a cell, if an empty one. issues:
    (page_id, code) of the pages that give no rows: ENGINE_FAILED, HEADER_UNREADABLE (no date column),
    HEADER_AMBIGUOUS (a field named twice), AMOUNT_HEADER_UNREADABLE (neither a signed column nor both of income
    and expense), NO_DATE_ROWS. Everything is joined within a page.
    """
    tokens = tokens.select("page_id", "text", "score", "x", "y", "h", "w")
    all_pages = tokens.select("page_id").distinct().withColumn("failed", F.lit(False)) if pages is None else pages.select("page_id", F.coalesce("failed", F.lit(False)).alias("failed"))
    headers = cut(header_lines(tokens))
    columns = cut(page_layouts(tokens, headers))
    layouts = columns.groupBy("page_id").agg(F.count("*").alias("n"), F.collect_set("field").alias("fields"))
    has = lambda f: F.array_contains("fields", f)
    code = (
        F.when(F.col("failed"), "ENGINE_FAILED")
        .when(F.col("n").isNull(), "HEADER_UNREADABLE")
        .when(F.col("n") > F.size("fields"), "HEADER_AMBIGUOUS")
        .when(~(has("signed") | has("credit") & has("debit")), "AMOUNT_HEADER_UNREADABLE")
    )
    judged = all_pages.join(layouts, "page_id", "left").select("page_id", code.alias("code"))
    good = judged.where("code IS NULL").select("page_id")
    columns = columns.join(good, "page_id", "left_semi")

    in_column = (F.col("x") >= F.col("left_x")) & (F.col("x") < F.col("right_x"))
    dates = tokens.join(columns.where("field = 'date'"), "page_id").where(in_column).join(headers, "page_id").where(F.col("y") > F.col("header_y") + F.col("header_h") * BELOW)
    bands = cut(row_bands(dates.where(ocr_date(clean(F.col("text"))).isNotNull()).select("page_id", "y", "h", F.col("x").alias("date_x"), F.col("y").alias("date_y"), F.col("w").alias("date_width"))))
    placed = tokens.join(columns, "page_id").where(in_column).join(bands.select("page_id", "row", "low", "high"), "page_id").where((F.col("y") >= F.col("low")) & (F.col("y") < F.col("high")))
    entry = F.struct(F.bround(F.col("y") / LINE).alias("line"), "x", "text", "score")
    cells = placed.groupBy("page_id", "row", "field").agg(F.array_sort(F.collect_list(entry)).alias("t"))
    whole = bands.join(columns.select("page_id", "field"), "page_id").join(cells, ["page_id", "row", "field"], "left")
    none = F.array().cast("array<double>")
    text, scores = F.coalesce(F.array_join("t.text", " "), F.lit("")), F.coalesce(F.col("t.score").cast("array<double>"), none)
    rows = whole.groupBy("page_id", "row", "date_x", "date_y", "date_width", (F.col("high") - F.col("low")).alias("row_height")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", text.alias("text"))))).alias("cells"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", scores.alias("scores"))))).alias("scores"),
    )
    empty = good.join(bands.select("page_id").distinct(), "page_id", "left_anti").select("page_id", F.lit("NO_DATE_ROWS").alias("code"))
    return rows, judged.where("code IS NOT NULL").union(empty)


def recognised_records(tokens: DataFrame, pages: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, issues): table_from_tokens()'s rows read as ocr_rows_to_records() does, with field_scores for scores."""
    rows, issues = table_from_tokens(tokens, pages)
    listed = rows.withColumnRenamed("scores", "field_scores").withColumn("scores", F.flatten(F.map_values("field_scores")))
    return ocr_rows_to_records(listed), issues
