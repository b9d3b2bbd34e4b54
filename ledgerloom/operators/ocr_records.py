"""Records of recognised table rows: texts cleaned, dates and amounts read strictly, issues as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import with_money
from ..functions.text import nfkc

#: The headers of recognised tables and their fields.
OCR_HEADERS = {
    "交易日期": "date",
    "交易时间": "date",
    "日期": "date",
    "收入/支出金额": "signed",
    "收入支出金额": "signed",
    "交易金额": "signed",
    "支出金额": "debit",
    "收入金额": "credit",
    "余额": "balance",
    "账户余额": "balance",
    "币种": "currency",
    "币别": "currency",
    "账号": "account",
    "本方账号": "account",
    "摘要": "description",
    "交易摘要": "description",
    "对方户名": "counterparty",
    "对方账号": "counterparty_account",
    "渠道": "payment_method",
    "流水号": "source_record_id",
}
#: Cells without an amount, the decimals that an amount may have, the least score of a row.
NO_AMOUNT = ("", "-", "--", "/", "无")
DECIMALS, LEAST_ROW_SCORE = 2, 0.9


def clean(text: Column) -> Column:
    """A recognised text without white space, its compatibility forms and dashes made plain."""
    return F.translate(F.regexp_replace(F.coalesce(nfkc(text), F.lit("")), r"(?U)\s", ""), "−—–", "---")


def header_field(text: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in OCR_HEADERS.items() for x in pair])
    return F.try_element_at(table, clean(text))


def ocr_date(cleaned: Column) -> Column:
    """ISO text of a clean date with or without a whole clock; a damaged clock makes no date."""
    parts = r"^(20\d\d)[-/](\d\d)[-/](\d\d)(\d\d:\d\d:\d\d)?$"
    day = F.regexp_replace(cleaned, parts, "$1-$2-$3")
    clock = F.regexp_extract(cleaned, parts, 4)
    text = F.when(clock == "", day).otherwise(F.concat_ws(" ", day, clock))
    pattern = F.when(clock == "", "yyyy-MM-dd").otherwise("yyyy-MM-dd HH:mm:ss")
    return F.when(cleaned.rlike(parts) & F.try_to_timestamp(text, pattern).isNotNull(), text)


def ocr_rows_to_records(rows: DataFrame) -> DataFrame:
    """rows (cells map<string,string>, scores array<double>) with transaction_at, amount, direction,
    balance and issues.

    A layout with a signed column reads amount and sign from it; one with two columns takes the side
    that is not zero. Amounts of more than two decimals are not rounded: they cannot be read. Scores
    may be null.
    """
    cell = lambda f: F.try_element_at("cells", F.lit(f))
    given = rows.withColumns({f"_{f}": cell(f) for f in ("signed", "credit", "debit", "balance")} | {"_date": clean(cell("date"))})
    parsed = with_money(given, {f"_m_{f}": f"_{f}" for f in ("signed", "credit", "debit", "balance")})
    exact = lambda f: F.when(F.col(f"_m_{f}.amount") == F.round(F.col(f"_m_{f}.amount"), DECIMALS), F.col(f"_m_{f}.amount"))
    values = parsed.withColumns({f"_v_{f}": exact(f) for f in ("signed", "credit", "debit", "balance")})
    signed, credit, debit = F.col("_v_signed"), F.col("_v_credit"), F.col("_v_debit")
    single = F.array_contains(F.map_keys("cells"), "signed")
    unread = lambda f: ~F.regexp_replace(F.coalesce(F.col(f"_{f}"), F.lit("")), r"\s", "").isin(*NO_AMOUNT) & F.col(f"_v_{f}").isNull()
    some = lambda v: F.coalesce(v, F.lit(0)) != 0
    sign = F.col("_m_signed.sign")
    case = (
        F.when(single, "signed")
        .when(unread("credit") | unread("debit"), "unreadable")
        .when(F.coalesce(credit < 0, F.lit(False)) | F.coalesce(debit < 0, F.lit(False)), "negative")
        .when(some(credit) & ~some(debit), "in")
        .when(some(debit) & ~some(credit), "out")
        .when(F.coalesce(credit == 0, F.lit(False)) | F.coalesce(debit == 0, F.lit(False)), F.when(some(credit) & some(debit), "both").otherwise("none"))
        .otherwise("both")
    )
    judged = values.withColumn("_case", case)
    c = F.col("_case")
    amount = F.when(c == "signed", F.abs(signed)).when(c == "in", F.abs(credit)).when(c == "out", F.abs(debit)).when(c == "none", F.lit(0))
    direction = F.when(c == "signed", F.when(signed.isNotNull(), F.when(sign == "-", "out").when(sign == "+", "in"))).when(c.isin("in", "out", "none"), c)
    out = judged.withColumns({"transaction_at": ocr_date(F.col("_date")), "amount": amount.cast("decimal(38,2)"), "direction": direction, "balance": F.col("_v_balance").cast("decimal(38,2)")})
    low = F.size("scores") > 0
    flags = [
        (c == "unreadable", "AMOUNT_UNREADABLE"),
        (c == "negative", "SPLIT_AMOUNT_NEGATIVE"),
        (c == "both", "AMBIGUOUS_DUAL_AMOUNT"),
        (F.col("amount").isNull(), "AMOUNT_UNREADABLE"),
        (F.col("direction").isNull(), "DIRECTION_UNKNOWN"),
        (F.col("transaction_at").isNull(), "DATE_UNREADABLE"),
        (F.col("balance").isNull(), "BALANCE_UNREADABLE"),
        (F.coalesce(low & (F.array_min("scores") < LEAST_ROW_SCORE), F.lit(False)), "LOW_OCR_SCORE"),
    ]
    issues = F.filter(F.array(*[F.when(F.coalesce(f, F.lit(False)), F.lit(code)) for f, code in flags]), lambda i: i.isNotNull())
    return out.withColumn("issues", issues).select(*rows.columns, "transaction_at", "amount", "direction", "balance", "issues")
