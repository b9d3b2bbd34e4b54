"""Canonicalisation of raw statement rows as one projection: values, and issues as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import date_struct, with_clock
from ..functions.money import MONEY, amount_text, is_empty, with_money
from ..functions.text import plain_text
from ..lineage import cut

#: Direction words, currency words and status marks of statements.
DIRECTION_WORDS = {
    "in": ("收入", "收", "收款", "入账", "转入", "in", "income"),
    "out": ("支出", "支", "付款", "消费", "扣款", "转出", "out", "expense"),
    "none": ("不计收支", "不计", "/", "中性交易", "none"),
}
CURRENCY_WORDS = {
    "CNY": ("人民币", "人民币元", "RMB", "CNY"),
    "USD": ("美元", "USD"),
    "EUR": ("欧元", "EUR"),
    "HKD": ("港币", "港元", "HKD"),
    "JPY": ("日元", "JPY"),
} | {code: (code,) for code in ("GBP", "CHF", "AUD", "CAD", "SGD", "NZD", "KRW", "TWD", "MOP")}
VOID_MARKS = ("交易关闭", "已关闭", "已撤销", "失败", "取消")
PENDING_MARKS = ("待支付", "处理中", "待付款", "进行中")
POSTED_MARKS = ("成功", "已入账", "已收款", "对方已收钱", "已存入", "已转账", "已到账", "已支出", "已支付", "退款")
WARNINGS = ("CURRENCY_DEFAULTED", "STATUS_UNKNOWN")


def _lookup(value: Column, words: dict[str, tuple[str, ...]]) -> Column:
    table = F.create_map(*[F.lit(x) for code, ws in words.items() for w in ws for x in (w, code)])
    return F.try_element_at(table, value)


def direction_of(value: Column, extra: dict[str, str] | None = None) -> Column:
    words = DIRECTION_WORDS | ({} if not extra else {code: (*DIRECTION_WORDS.get(code, ()), *[w.strip().lower() for w, c in extra.items() if c == code]) for code in set(extra.values())})
    return _lookup(F.lower(F.trim(value)), words)


def currency_of(value: Column) -> Column:
    return _lookup(F.upper(F.trim(value)), CURRENCY_WORDS)


def status_of(value: Column) -> Column:
    """unknown for an empty status; otherwise the first of void, pending, posted that it mentions."""
    s = F.trim(F.coalesce(value, F.lit("")))
    has = lambda marks: s.rlike("|".join(marks))
    return F.when(s == "", "unknown").when(has(VOID_MARKS), "void").when(has(PENDING_MARKS), "pending").when(has(POSTED_MARKS), "posted").otherwise("unknown")


def _sign_direction(amount: Column) -> Column:
    return F.when(amount < 0, "out").when(amount > 0, "in").when(amount == 0, "none")


#: The money fields, by the short names that their parsed structs have.
MONEY_CELLS = {"plain": "cell_amount", "signed": "cell_signed", "credit": "cell_credit", "debit": "cell_debit"}
#: Fields that are kept as text, and those of them that identify.
TEXT_FIELDS = ("counterparty", "counterparty_account", "counterparty_bank", "counterparty_combined", "description", "memo", "payment_method", "trade_type", "original_category", "source_record_id", "merchant_order_no", "account")
IDENTIFIERS = ("source_record_id", "merchant_order_no", "counterparty_account", "account")
#: Columns that normalize_rows() takes and what stands in for those that a table lacks.
LAYOUT = {
    "signed_format": "false",
    "split": "false",
    "default_currency": "CAST(NULL AS STRING)",
    "direction_codes": "CAST(NULL AS MAP<STRING, STRING>)",
    "profile": "'generic.v1'",
    "confirmed": "false",
    "source": "CAST(NULL AS STRING)",
    "numeric_fields": "CAST(NULL AS ARRAY<STRING>)",
    "ambiguous_fields": "CAST(NULL AS ARRAY<STRING>)",
    "formula_fields": "CAST(NULL AS ARRAY<STRING>)",
    "error_fields": "CAST(NULL AS ARRAY<STRING>)",
    "wider": "false",
    "mapped_fields": "CAST(NULL AS ARRAY<STRING>)",
}


def _issue(*flags: tuple[Column, str | Column, str | None]) -> Column:
    """array<struct<code, field>> of the flags that hold."""
    of = lambda code, field: F.struct((code if isinstance(code, Column) else F.lit(code)).alias("code"), F.lit(field).cast("string").alias("field"))
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), of(code, field)) for c, code, field in flags]), lambda i: i.isNotNull())


#: The field that each money cell is.
MONEY_FIELDS = {"plain": "amount", "signed": "signed_amount", "credit": "credit_amount", "debit": "debit_amount"}


def issue_rows(read: DataFrame, id_col: str) -> DataFrame:
    """(id, code, severity, field): an issue a row, of normalize_rows()'s result."""
    found = read.select(id_col, F.explode(F.arrays_zip(F.col("issues").alias("code"), F.col("issue_fields").alias("field"))).alias("i"))
    return found.select(id_col, "i.code", F.when(F.col("i.code").isin(*WARNINGS), "warning").otherwise("error").alias("severity"), "i.field")


def resolve_amounts(rows: DataFrame) -> DataFrame:
    """rows with _amount, struct(amount, direction, signed, issues, fields), from the parsed money columns
    plain, signed, credit and debit and from cell_direction, signed_format and split.

    A signed amount counts before split columns count before a plain amount. An unsigned positive
    amount never means income. split: whether the layout has credit or debit columns.
    """
    c = F.col
    plain, signed, credit, debit = c("plain.amount"), c("signed.amount"), c("credit.amount"), c("debit.amount")
    has_credit, has_debit = F.coalesce(credit, F.lit(0)) != 0, F.coalesce(debit, F.lit(0)) != 0
    shown = plain.isNotNull() & (c("signed_format") | (plain < 0) | c("plain.sign").isNotNull())
    extra = F.try_element_at("direction_codes", F.lower(c("_raw_direction")))
    sides = rows.withColumn("_raw_direction", F.trim(F.coalesce("cell_direction", F.lit("")))).withColumns(
        {
            "_by_plain": F.when(shown, _sign_direction(plain)),
            "_by_signed": _sign_direction(signed),
            "_both": F.coalesce(c("split") & has_credit & has_debit, F.lit(False)),
            "_some": F.coalesce(c("split") & ~(has_credit & has_debit) & (credit.isNotNull() | debit.isNotNull()), F.lit(False)),
            "_split": F.when(has_credit, credit).when(has_debit, debit).otherwise(F.lit(0).cast(MONEY)),
            "_split_direction": F.when(has_credit, "in").when(has_debit, "out").otherwise("none"),
            "_stated": F.coalesce(extra, direction_of(c("_raw_direction"))),
        }
    )
    amount = F.when(c("_both"), F.lit(None).cast(MONEY)).when(c("_some"), c("_split")).otherwise(F.coalesce(signed, plain))
    chosen = sides.withColumn("_value", amount)
    chosen = chosen.withColumn("_derived", F.when(c("_some"), c("_split_direction")).otherwise(F.coalesce("_by_signed", F.when(c("_value").isNotNull(), c("_by_plain")))))
    direction = F.when(c("_value").isNotNull(), F.coalesce("_stated", "_derived")).otherwise(c("_stated"))
    chosen = chosen.withColumn("_direction", direction)
    other = F.coalesce(signed, plain)
    invalid = [(~is_empty(c(cell)) & c(f"{name}.amount").isNull(), "AMOUNT_INVALID", MONEY_FIELDS[name]) for name, cell in MONEY_CELLS.items()]
    issues = _issue(
        *invalid,
        (F.abs(plain) != F.abs(signed), "AMOUNT_CONFLICT", "amount"),
        (c("_by_plain") != c("_by_signed"), "DIRECTION_CONFLICT", "direction"),
        (c("split") & ((credit < 0) | (debit < 0)), "SPLIT_AMOUNT_NEGATIVE", "amount"),
        (c("_both"), "BOTH_DIRECTIONS", "amount"),
        (c("_some") & (F.abs(other) != F.abs(c("_split"))), "AMOUNT_CONFLICT", "amount"),
        (c("_some") & (F.coalesce("_by_signed", "_by_plain") != c("_split_direction")), "DIRECTION_CONFLICT", "direction"),
        ((c("_raw_direction") != "") & c("_stated").isNull(), "DIRECTION_UNKNOWN", "direction"),
        (c("_value").isNotNull() & (c("_stated") != c("_derived")) & (c("_stated") != "none"), "DIRECTION_CONFLICT", "direction"),
        (c("_direction").isNull(), "DIRECTION_MISSING", "direction"),
        (c("_value").isNull(), "AMOUNT_MISSING", "amount"),
    )
    kept_sign = F.when(c("signed_format") | signed.isNotNull(), c("_value"))
    made = F.struct(F.abs("_value").alias("amount"), c("_direction").alias("direction"), kept_sign.alias("signed"), F.transform(issues, lambda i: i["code"]).alias("issues"), F.transform(issues, lambda i: i["field"]).alias("fields"))
    return chosen.withColumn("_amount", made).drop("_by_plain", "_by_signed", "_both", "_some", "_split", "_split_direction", "_stated", "_value", "_derived", "_direction", "_raw_direction")


def resolve_currency(currency_cell: Column, evidence: Column) -> Column:
    """struct(currency, issue) from the currency cell and the codes that the money cells name (array)."""
    stated = currency_of(F.coalesce(currency_cell, F.lit("")))
    known = F.array_distinct(F.filter(F.concat(F.array(stated), evidence), lambda x: x.isNotNull()))
    found = F.when(F.size(known) > 1, stated).when(F.size(known) == 1, F.element_at(known, 1)).otherwise(F.lit("CNY"))
    return F.struct(found.alias("currency"), F.when(F.size(known) > 1, "CURRENCY_CONFLICT").when(F.size(known) == 0, "CURRENCY_DEFAULTED").alias("issue"))


def _times(rows: DataFrame, field: str, date_cell: str, clock_cell: str) -> tuple[dict[str, Column], list[tuple[Column, str | Column, str]]]:
    """The columns of a date field with its clock column, and its issues; a column that is not there
    is not part of the layout."""
    mapped, clocked = date_cell in rows.columns, clock_cell in rows.columns
    date = date_struct(F.col(date_cell)) if mapped else F.lit(None).cast("struct<at:string,precision:string>")
    columns = {f"_{field}_date": date}
    here = F.coalesce(F.array_contains("mapped_fields", field), F.lit(True))  # null: every column there is
    issues = [(here & F.col(f"_{field}_date").isNull(), "DATE_INVALID", field)] if mapped else []
    if clocked:
        issues.append((F.col(f"_{field}.issue").isNotNull(), F.col(f"_{field}.issue"), field))
    return columns, issues


def normalize_rows(rows: DataFrame) -> DataFrame:
    """Canonical records of raw cells.

    rows: a column cell_<field> for each field of the layout (date, time, booking, booking_time,
    amount, signed, credit, debit, direction, currency, status, balance and TEXT_FIELDS; numbers as
    text), and those of LAYOUT that apply. A missing column is a field that the layout has not.

    Adds transaction_at, booking_at, their precisions, amount, signed_amount, direction, raw_direction,
    currency, the text fields, balance, raw_status, transaction_status, issues (codes in the order in
    which they are found), issue_fields (the field of each, null if it has none), parse_status (needs_review with any issue that is no warning) and
    mapping_method. The cells themselves stay.
    """
    c = F.col
    given = set(rows.columns)
    missing = {n: F.expr(v) for n, v in LAYOUT.items() if n not in given} | {cell: F.lit(None).cast("string") for cell in (*MONEY_CELLS.values(), "cell_direction", "cell_currency", "cell_status", "cell_balance") if cell not in given}
    staged = with_money(rows.withColumns(missing), MONEY_CELLS | {"_balance": "cell_balance"})
    parts = {"transaction_at": ("cell_date", "cell_time"), "booking_at": ("cell_booking", "cell_booking_time")}
    issues_of: dict[str, list[tuple[Column, str | Column, str]]] = {}
    for field, (date_cell, clock_cell) in parts.items():
        columns, issues_of[field] = _times(rows, field, date_cell, clock_cell)
        staged = staged.withColumns(columns)
        date = c(f"_{field}_date")
        timed = with_clock(date, c(clock_cell), F.lit(True)) if clock_cell in given else F.struct(date["at"].alias("at"), date["precision"].alias("precision"), F.lit(None).cast("string").alias("issue"))
        staged = staged.withColumn(f"_{field}", timed)
    codes = F.array(*[c(f"{n}.currency") for n in MONEY_CELLS])
    stated = F.coalesce(F.nullif(F.trim("cell_currency"), F.lit("")), "default_currency")
    staged = resolve_amounts(staged).withColumns({"_currency": resolve_currency(stated, codes), "_status": status_of(c("cell_status"))})
    dates = [flag for field in parts for flag in issues_of[field]]
    dated = _issue(*dates, (c("_transaction_at.at").isNull() & c("_booking_at.at").isNull(), "DATE_MISSING", None))
    unknown_status = ~F.trim(F.coalesce("cell_status", F.lit(""))).isin("") & (c("_status") == "unknown")
    several = lambda fields, code: F.transform(F.coalesce(fields, F.array().cast("array<string>")), lambda f: F.struct(F.lit(code).alias("code"), f.alias("field")))
    numeric = F.array_intersect(F.coalesce("numeric_fields", F.array().cast("array<string>")), F.array(*[F.lit(x) for x in IDENTIFIERS]))
    of_amount = F.transform(F.arrays_zip(c("_amount.issues").alias("code"), c("_amount.fields").alias("field")), lambda i: F.struct(i["code"].alias("code"), i["field"].alias("field")))
    found = F.concat(
        dated,
        of_amount,
        _issue((c("_currency.issue") == "CURRENCY_CONFLICT", "CURRENCY_CONFLICT", "currency"), (c("_currency.issue") == "CURRENCY_DEFAULTED", "CURRENCY_DEFAULTED", "currency")),
        several(numeric, "IDENTIFIER_NUMERIC"),
        _issue((unknown_status, "STATUS_UNKNOWN", "transaction_status")),
        several(c("ambiguous_fields"), "COLUMN_AMBIGUOUS"),
        several(c("formula_fields"), "FORMULA_CELL"),
        several(c("error_fields"), "CELL_ERROR"),
        _issue((c("wider"), "ROW_WIDTH_MISMATCH", None)),
    )
    staged = staged.withColumn("_found", found)
    out = staged.withColumns(
        {
            "transaction_at": c("_transaction_at.at"),
            "transaction_at_precision": c("_transaction_at.precision"),
            "booking_at": c("_booking_at.at"),
            "booking_at_precision": c("_booking_at.precision"),
            "amount": c("_amount.amount"),
            "signed_amount": c("_amount.signed"),
            "direction": c("_amount.direction"),
            "raw_direction": F.nullif(F.trim("cell_direction"), F.lit("")),
            "currency": c("_currency.currency"),
            "balance": amount_text(c("_balance.amount")),
            "raw_status": F.nullif(F.trim("cell_status"), F.lit("")),
            "transaction_status": c("_status"),
            "issues": F.transform("_found", lambda i: i["code"]),
            "issue_fields": F.transform("_found", lambda i: i["field"]),
            "source": F.coalesce("source", F.lit("未知来源")),
            "mapping_method": F.when(c("confirmed"), "user_confirmed").when(c("profile") != "generic.v1", "profile").otherwise("exact_alias"),
        }
        | {f: plain_text(c(f"cell_{f}"), F.array_contains(F.coalesce("numeric_fields", F.array().cast("array<string>")), f)) if f"cell_{f}" in given else F.lit(None).cast("string") for f in TEXT_FIELDS}
    )
    review = F.exists("issues", lambda x: ~x.isin(*WARNINGS))
    made = [x for x in out.columns if x.startswith("_") and x not in given or x in MONEY_CELLS and x not in given]
    # Written once: Spark would otherwise push what is asked of the result through all the steps above.
    return cut(out.withColumn("parse_status", F.when(review, "needs_review").otherwise("ready")).drop(*made, *[x for x in missing if x not in ("source", "profile")]))
