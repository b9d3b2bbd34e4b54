"""Tables of recognised pages against the layout that made them."""

from __future__ import annotations

from ledgerloom.operators.page_tables import recognised_records, table_from_tokens

SCHEMA = "page_id int, text string, score double, x double, y double, h double, w double"


def token(page, text, x, y, score=0.99):
    return (page, text, score, float(x), float(y), 10.0, 40.0)


def head(page, *labels, y=10):
    return [token(page, label, 100 * i, y + i % 2) for i, label in enumerate(labels)]


def found(spark, tokens, pages=None, of=table_from_tokens):
    listed = None if pages is None else spark.createDataFrame(pages, "page_id int, failed boolean")
    rows, issues = of(spark.createDataFrame(tokens, SCHEMA), listed)
    return {(r.page_id, r.row): r for r in rows.collect()}, {(r.page_id, r.code) for r in issues.collect()}


def test_rows_and_cells(spark):
    tokens = head(1, "交易日期", "摘要", "odd", "收入金额", "支出金额", "余额") + [token(1, "2026-01-01", 0, -9)]  # a date above the header is no row
    tokens += [token(1, "2026-01-02", 0, 50), token(1, "two", 110, 58), token(1, "one", 90, 50), token(1, "three", 95, 66), token(1, "5.00", 300, 50, 0.8), token(1, "x", 200, 50)]
    tokens += [token(1, "2026-01-03", 3, 90), token(1, "7.25", 405, 91), token(1, "total", 0, 130), token(1, "2026-01-04", 0, 150), token(1, "-3", 400, 152)]
    rows, issues = found(spark, tokens, of=recognised_records)
    assert issues == set() and sorted(rows) == [(1, 0), (1, 1), (1, 2)]
    first, second, third = (rows[1, i] for i in range(3))
    assert first.cells == {"date": "2026-01-02", "description": "one two three", "credit": "5.00", "debit": "", "balance": ""}
    assert (first.date_y, first.row_height) == (50, 45) and first.field_scores["credit"] == [0.8] and first.field_scores["debit"] == []
    assert (str(first.amount), first.direction, first.issues) == ("5.00", "in", ["BALANCE_UNREADABLE", "LOW_OCR_SCORE"])
    assert (str(second.amount), second.direction) == ("7.25", "out") and third.issues[0] == "SPLIT_AMOUNT_NEGATIVE"
    assert third.cells["date"] == "total 2026-01-04" and third.transaction_at is None  # what stands in the band belongs to the cell


def test_pages_without_rows_say_why(spark):
    tokens = head(1, "摘要", "余额") + head(2, "日期", "交易金额", "余额", "账户余额") + head(3, "日期", "收入金额") + head(4, "日期", "交易金额") + [token(4, "soon", 0, 60)]
    tokens += head(5, "日期", "交易金额") + [token(5, "2026-01-02", 0, 60)]
    rows, issues = found(spark, tokens, [(i, i == 7) for i in range(1, 8)])
    assert issues == {(1, "HEADER_UNREADABLE"), (2, "HEADER_AMBIGUOUS"), (3, "AMOUNT_HEADER_UNREADABLE"), (4, "NO_DATE_ROWS"), (6, "HEADER_UNREADABLE"), (7, "ENGINE_FAILED")}
    assert list(rows) == [(5, 0)] and rows[5, 0].row_height == 28.0  # a single row is 2.8 heights


def test_uppermost_header_counts_and_empty_tables(spark):
    tokens = head(1, "日期", "交易金额") + [token(1, "2026-01-02", 0, 60), token(1, "-5.00", 100, 60)] + head(1, "日期", "余额", y=200) + [token(1, "2026-01-03", 0, 240)]
    rows, issues = found(spark, tokens)
    assert issues == set() and {k: v.cells for k, v in rows.items()} == {
        # The outer bands are half the median gap, here as far as the header.
        (1, 0): {"date": "日期 2026-01-02", "signed": "交易金额 -5.00"},
        (1, 1): {"date": "日期 2026-01-03", "signed": "余额"},
    }
    assert found(spark, []) == ({}, set())
