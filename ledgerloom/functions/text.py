"""Text normalisation and identifier rules as Column builders."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Counterparties too general to identify a merchant.
GENERIC_PARTIES = ("消费", "转账", "支付", "付款", "其他", "未知", "财付通", "支付宝", "微信支付", "/", "-", "无")
#: Processor prefixes of a bank's merchant text, in the order in which they are stripped.
PROCESSOR_PREFIXES = ("财付通-微信支付-", "财付通－微信支付－", "财付通-", "财付通－", "支付宝-支付宝外部商户-", "支付宝-", "支付宝－")


@F.pandas_udf(StringType())
def _nfkc_casefold(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).casefold())


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def is_ascii(value: Column) -> Column:
    return F.octet_length(value) == F.length(value)


def nfkc(value: Column) -> Column:
    """NFKC; Spark has no built-in for it, and ASCII text does not need it."""
    return _nfkc(value)


def norm(value: Column, ascii_only: bool = False) -> Column:
    """NFKC, case-folded, without anything but letters and digits; '' for null.

    ascii_only states that the column holds ASCII alone: the expression then stays in the JVM.
    """
    folded = F.lower(value) if ascii_only else _nfkc_casefold(value)
    return F.coalesce(F.regexp_replace(folded, r"(?U)[\W_]+", ""), F.lit(""))


def identifier(value: Column) -> Column:
    """The trimmed value if it can identify: six characters or more, not masked; else null."""
    trimmed = F.trim(value.cast("string"))
    return F.when((F.length(trimmed) >= 6) & ~trimmed.rlike(r"(?i)[*×]|x{3,}"), trimmed)


def reference_tokens(*columns: Column) -> Column:
    """Distinct tokens of six or more of [A-Za-z0-9_-] in a narrative."""
    text = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns])
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9_-]{6,})"), F.lit(1)))


def without_processor(value: Column) -> Column:
    """A bank's merchant text after its processor prefixes, each stripped in turn where it stands."""
    in_turn = "^" + "".join(f"(?:{prefix})?" for prefix in PROCESSOR_PREFIXES)
    return F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), in_turn, "")


def meaningful(value: Column) -> Column:
    """Whether a cell says something: not null, and not only dashes, slashes, stars or blanks."""
    return F.coalesce(F.length(F.regexp_replace(value, r"[-—_/＊*\s]", "")) > 0, F.lit(False))


def header_norm(value: Column, ascii_only: bool = False) -> Column:
    """A header as it is looked up: NFKC, lower case, without blanks and punctuation."""
    lowered = F.lower(value if ascii_only else _nfkc(value))
    return F.regexp_replace(F.coalesce(lowered, F.lit("")), r"(?U)[\s/:：()（）\[\]【】*、·_-]", "")


def plain_text(cell: Column, numeric: Column) -> Column:
    """A cell as the text of a field, trimmed, null if empty; a whole number stored as one loses its point."""
    text = F.nullif(F.trim(cell.cast("string")), F.lit(""))
    return F.when(F.coalesce(numeric, F.lit(False)), F.regexp_replace(text, r"\.0+$", "")).otherwise(text)
