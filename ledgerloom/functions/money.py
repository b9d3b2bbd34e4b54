"""Money cells of statements: one currency mark, one form of sign, dot decimals, whole groups of three.

A cell is read in steps that are columns of their own, so that Spark evaluates each once and the plan
grows with the steps, not with their uses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Currency words and signs, the ISO code of each (None: it names no single currency).
CURRENCY_MARKS = {
    "人民币": "CNY",
    "CNY": "CNY",
    "RMB": "CNY",
    "USD": "USD",
    "EUR": "EUR",
    "HKD": "HKD",
    "JPY": "JPY",
    "GBP": "GBP",
    "CHF": "CHF",
    "AUD": "AUD",
    "CAD": "CAD",
    "SGD": "SGD",
    "NZD": "NZD",
    "KRW": "KRW",
    "TWD": "TWD",
    "MOP": "MOP",
    "¥": None,
    "$": None,
    "€": "EUR",
    "£": "GBP",
}
#: Cells that mean no amount.
EMPTY_CELLS = ("", "-", "--", "—", "/", "无", "N/A", "null")
SIGNS = "+负-"
#: 38 digits in all, 18 behind the point; the limit of a valid amount is 1e15.
MONEY = "decimal(38,18)"
LIMIT = "1000000000000000"

_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　￠￡￥−﹩﹢﹣"
_PLAIN = "".join(map(chr, range(0x21, 0x7F))) + " ¢£¥-$+-"


def plain_width(cell: Column) -> Column:
    """A cell in half-width characters: the compatibility forms that statements use for amounts, and
    the minus sign. It stays in the JVM."""
    return F.translate(cell.cast("string"), _WIDE, _PLAIN)


def is_empty(cell: Column) -> Column:
    return F.trim(F.coalesce(cell.cast("string"), F.lit(""))).isin(*EMPTY_CELLS)


def with_money(rows: DataFrame, cells: dict[str, str]) -> DataFrame:
    """rows with a column struct(amount, sign, currency) for each (name: column of cells).

    sign is '-', '+' or null; currency the ISO code that the cell names; all are null if the cell is
    no amount of less than 1e15.
    """
    c = F.col
    names = list(cells)
    each = lambda build: {f"_{step}_{n}": value for n in names for step, value in build(n).items()}

    def trimmed(n: str) -> dict[str, Column]:
        s = F.trim(plain_width(c(f"`{cells[n]}`")))
        return {"s": F.when(~is_empty(c(f"`{cells[n]}`")), s)}

    def unit(n: str) -> dict[str, Column]:
        s = c(f"_s_{n}")
        named = s.endswith("人民币")
        return {"unit": named, "core": F.trim(F.when(named, F.expr(f"left(`_s_{n}`, length(`_s_{n}`) - 3)")).when(s.endswith("元"), F.expr(f"left(`_s_{n}`, length(`_s_{n}`) - 1)")).otherwise(s))}

    def unwrapped(n: str) -> dict[str, Column]:
        core = c(f"_core_{n}")
        wrapped = core.startswith("(") & core.endswith(")") & (F.length(core) >= 2)
        return {"wrapped": wrapped, "inner": F.when(wrapped, F.trim(F.expr(f"substring(`_core_{n}`, 2, length(`_core_{n}`) - 2)"))).otherwise(core)}

    def cut(n: str) -> dict[str, Column]:
        inner = c(f"_inner_{n}")
        return {"digits": F.regexp_extract(inner, r"\d.*$", 0), "head": F.upper(F.regexp_extract(inner, r"^\D*", 0))}

    def tokens(n: str) -> dict[str, Column]:
        digits, head = c(f"_digits_{n}"), c(f"_head_{n}")
        tail = digits.endswith("-")
        # each sign stands alone: at most one sign and one mark make up what is before the number
        parts = F.split(F.trim(F.regexp_replace(head, f"([{SIGNS}])", " $1 ")), r"\s+")
        return {"tail": tail, "number": F.when(tail, F.expr(f"left(`_digits_{n}`, length(`_digits_{n}`) - 1)")).otherwise(digits), "parts": F.filter(parts, lambda p: p != "")}

    def sorted_out(n: str) -> dict[str, Column]:
        parts = c(f"_parts_{n}")
        is_sign = lambda p: p.isin(*SIGNS)
        return {"signs": F.filter(parts, is_sign), "marks": F.filter(parts, lambda p: ~is_sign(p))}

    def judged(n: str) -> dict[str, Column]:
        number, signs, marks = c(f"_number_{n}"), c(f"_signs_{n}"), c(f"_marks_{n}")
        whole = number.rlike(r"^\d+(\.\d+)?$") | number.rlike(r"^\d{1,3}(,\d{3})+(\.\d+)?$")
        forms = c(f"_wrapped_{n}").cast("int") + c(f"_tail_{n}").cast("int") + F.size(signs)
        valid = whole & (forms <= 1) & (F.size(marks) <= 1) & F.forall(marks, lambda m: m.isin(*CURRENCY_MARKS))
        value = F.when(valid, F.regexp_replace(number, ",", "").try_cast(MONEY))
        sign = F.get(signs, F.lit(0))
        return {"value": F.when(value < F.lit(LIMIT).cast(MONEY), value), "sign": F.when(c(f"_wrapped_{n}") | c(f"_tail_{n}") | sign.isin("-", "负"), "-").when(sign == "+", "+")}

    def made(n: str) -> dict[str, Column]:
        iso = F.create_map(*[F.lit(x) for pair in CURRENCY_MARKS.items() if pair[1] for x in pair])
        value, sign = c(f"_value_{n}"), c(f"_sign_{n}")
        currency = F.coalesce(F.try_element_at(iso, F.get(c(f"_marks_{n}"), F.lit(0))), F.when(c(f"_unit_{n}"), "CNY"))
        found = F.struct(F.when(sign == "-", -value).otherwise(value).cast(MONEY).alias("amount"), F.when(value.isNotNull(), sign).alias("sign"), F.when(value.isNotNull(), currency).alias("currency"))
        return {"money": found}

    out = rows
    for step in (trimmed, unit, unwrapped, cut, tokens, sorted_out, judged, made):
        out = out.withColumns(each(step))
    kept = [F.col(f"`{x}`") for x in rows.columns if x not in names]
    return out.select(*kept, *[F.col(f"_money_{n}").alias(n) for n in names])


def amount_text(amount: Column) -> Column:
    """A decimal without its trailing zeros, as text."""
    plain = F.regexp_replace(amount.cast("string"), r"(\.\d*?)0+$", "$1")
    return F.regexp_replace(plain, r"\.$", "")
