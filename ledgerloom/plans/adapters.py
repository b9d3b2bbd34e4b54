"""The test tables in ledger shape: projections whose SQL text Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: name: (table, condition, {column: expression})
ADAPTERS: dict[str, tuple[str, str, dict[str, str]]] = {
    "event_records": (
        "events",
        "true",
        {
            "record_id": "event_id",
            "source": "event_type",
            "currency": "CASE WHEN user_id % 11 = 0 THEN NULL WHEN user_id % 5 = 0 THEN 'USD' ELSE 'CNY' END",
            "direction": "CASE user_id % 3 WHEN 0 THEN 'in' WHEN 1 THEN 'out' ELSE 'none' END",
            "transaction_status": "CASE event_id % 7 WHEN 0 THEN 'void' WHEN 1 THEN 'pending' WHEN 2 THEN 'unknown' ELSE 'posted' END",
            "money": "CAST(value AS DECIMAL(18,2))",
            "transaction_at": "CAST(CAST(ts AS DATE) AS STRING)",
            "booking_at": "CAST(NULL AS STRING)",
        },
    ),
    "ledger": (
        "orders",
        "true",
        {
            "id": "o_orderkey",
            "book_record_id": "concat('r', lpad(CAST(o_orderkey AS STRING), 12, '0'))",
            "batch_id": "CAST(o_custkey % 4 AS STRING)",
            "file_id": "CAST(o_orderkey % 9 AS STRING)",
            "source": "CASE WHEN o_orderkey % 2 = 0 THEN '微信' ELSE '建设银行' END",
            "amount": "CAST(CAST(floor(o_totalprice / 20000) * 20000 AS BIGINT) AS STRING)",
            "currency": "'CNY'",
            "direction": "CASE WHEN o_custkey % 10 = 0 THEN 'in' ELSE 'out' END",
            "transaction_at": "CAST(CAST(o_orderdate AS DATE) AS STRING)",
            "transaction_at_precision": "'day'",
            "booking_at": "CAST(NULL AS STRING)",
            "booking_at_precision": "CAST(NULL AS STRING)",
            "counterparty": "CASE WHEN o_orderkey % 2 = 0 THEN concat('Shop ', CAST(o_custkey % 40 AS STRING)) ELSE '财付通' END",
            "description": "CASE WHEN o_orderkey % 2 = 0 THEN 'goods' ELSE '消费' END",
            "memo": "CASE WHEN o_orderkey % 2 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN concat('ref order', lpad(CAST(o_orderkey + 3 AS STRING), 8, '0')) ELSE concat('财付通-微信支付-Shop ', CAST(o_custkey % 40 AS STRING)) END",
            "payment_method": "CASE WHEN o_orderkey % 2 = 0 AND o_custkey % 3 <> 2 THEN '建设银行储蓄卡(1234)' WHEN o_orderkey % 2 = 0 THEN '零钱' END",
            "account": "CASE WHEN o_orderkey % 2 = 1 AND o_custkey % 7 = 0 THEN '6222005678' WHEN o_orderkey % 2 = 1 THEN '6222001234' END",
            "counterparty_account": "CAST(NULL AS STRING)",
            "counterparty_combined": "CAST(NULL AS STRING)",
            "counterparty_bank": "CAST(NULL AS STRING)",
            "source_record_id": "CASE WHEN o_orderkey % 2 = 0 THEN concat('order', lpad(CAST(o_orderkey AS STRING), 8, '0')) END",
            "merchant_order_no": "CAST(NULL AS STRING)",
            "trade_type": "CASE WHEN o_orderkey % 2 = 0 THEN '商户消费' END",
            "original_category": "CAST(NULL AS STRING)",
            "transaction_status": "CASE o_orderstatus WHEN 'P' THEN 'pending' ELSE 'posted' END",
            "raw_status": "o_orderstatus",
            "balance": "CAST(NULL AS STRING)",
            "balance_reliable": "CAST(NULL AS BOOLEAN)",
        },
    ),
    "document_exports": ("documents", "true", {"id": "doc_id", "text_key": "md5(text)", "source": "source", "batch_id": "CAST(doc_id % 3 AS STRING)", "lang": "lang"}),
    "order_pool": (
        "orders",
        "o_orderkey % 3 <> 0",
        {"order_id": "o_orderkey", "day": "CAST(o_orderdate AS DATE)", "channel": "o_custkey % 3", "order_amount": "CAST(CAST(floor(o_totalprice / 20000) * 20000 AS BIGINT) AS DECIMAL(18,2))", "order_source": "CASE WHEN o_custkey % 20 = 0 THEN 'b' ELSE 'a' END", "referred": "o_custkey % 4 = 0"},
    ),
    "bank_sums": (
        "orders",
        "o_orderkey % 3 = 0",
        {"bank_id": "o_orderkey", "day": "CAST(o_orderdate AS DATE)", "channel": "o_custkey % 3", "bank_amount": "CAST(CAST(floor(o_totalprice / 20000) * 40000 AS BIGINT) AS DECIMAL(18,2))"},
    ),
    "refund_lines": (
        "lineitem",
        "l_returnflag = 'R'",
        {"id": "l_orderkey * 10 + l_linenumber", "currency": "'CNY'", "money": "CAST(l_extendedprice AS DECIMAL(18,2))", "at": "l_shipdate", "source": "'shop'", "source_record_id": "concat('order', lpad(CAST(l_orderkey AS STRING), 9, '0'))", "merchant_order_no": "CAST(NULL AS STRING)"},
    ),
    "refund_orders": (
        "orders",
        "true",
        {"id": "o_orderkey", "currency": "'CNY'", "money": "CAST(o_totalprice AS DECIMAL(18,2))", "at": "o_orderdate", "source": "'shop'", "source_record_id": "concat('order', lpad(CAST(o_orderkey AS STRING), 9, '0'))", "merchant_order_no": "CAST(NULL AS STRING)"},
    ),
    "cells": (
        "orders",
        "true",
        {
            "record_id": "o_orderkey",
            "cell_date": "CASE o_orderkey % 5 WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) WHEN 1 THEN replace(CAST(CAST(o_orderdate AS DATE) AS STRING), '-', '') WHEN 2 THEN concat(replace(CAST(CAST(o_orderdate AS DATE) AS STRING), '-', '/'), ' 10:20:30') WHEN 3 THEN concat(CAST(CAST(o_orderdate AS DATE) AS STRING), 'garbage') ELSE concat(CAST(CAST(o_orderdate AS DATE) AS STRING), ' 08:05') END",
            "cell_amount": "CASE o_orderkey % 8 WHEN 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) WHEN 1 THEN concat('-', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)) WHEN 2 THEN concat('USD ', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)) WHEN 3 THEN concat('(', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING), ')') WHEN 4 THEN CASE o_custkey % 3 WHEN 0 THEN concat('+', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)) WHEN 1 THEN concat('￥', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)) ELSE concat('（￥', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING), '）') END WHEN 5 THEN concat('12,', CAST(o_custkey AS STRING)) WHEN 6 THEN '' ELSE concat(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING), '-') END",
            "cell_signed": "CAST(NULL AS STRING)",
            "cell_credit": "CASE WHEN o_custkey % 6 = 0 THEN CAST(o_custkey AS STRING) END",
            "cell_debit": "CASE WHEN o_custkey % 12 = 0 THEN '5' WHEN o_custkey % 6 = 1 THEN '7.50' END",
            "cell_direction": "CASE o_custkey % 5 WHEN 0 THEN '支出' WHEN 1 THEN '收入' WHEN 2 THEN 'odd' WHEN 3 THEN '/' END",
            "cell_currency": "CASE o_custkey % 4 WHEN 0 THEN '人民币' WHEN 1 THEN 'usd' WHEN 2 THEN NULL ELSE 'zzz' END",
            "cell_status": "CASE o_orderstatus WHEN 'F' THEN '支付成功' WHEN 'O' THEN '处理中' ELSE o_orderpriority END",
            "signed_format": "o_custkey % 9 = 0",
            "split": "o_custkey % 6 <= 1",
        },
    ),
    "decisions": (
        "conversations",
        "true",
        {
            "revision": "conv_id * 100 + turn",
            "relation_id": "CAST(conv_id % 50 AS STRING)",
            "action": "CASE WHEN turn > 0 AND length(text) % 5 = 0 THEN 'undo' WHEN length(text) % 3 = 0 THEN 'accept' WHEN length(text) % 3 = 1 THEN 'reject' ELSE 'defer' END",
            "target": "CASE WHEN turn > 0 AND length(text) % 5 = 0 THEN conv_id * 100 + turn - 1 END",
        },
    ),
    "base_records": (
        "documents",
        "true",
        {"record_id": "doc_id", "file_id": "source", "page": "doc_id % 5", "counterparty": "lang", "description": "md5(text)", "n_chars": "n_chars", "parse_status": "CASE WHEN doc_id % 4 = 0 THEN 'needs_review' ELSE 'ready' END", "transaction_at": "CAST(NULL AS STRING)", "booking_at": "CAST(NULL AS STRING)", "source": "source"},
    ),
    "observations": (
        "orders",
        "true",
        {
            "id": "o_orderkey",
            "role": "CASE WHEN o_orderkey % 2 = 0 THEN 'payment_platform' ELSE 'account_ledger' END",
            "amount": "CAST(CAST(floor(o_totalprice / 20000) * 20000 + 1 AS BIGINT) AS DECIMAL(18,2))",
            "currency": "CASE WHEN o_custkey % 50 = 0 THEN 'cny' ELSE 'CNY' END",
            "direction": "CASE WHEN o_custkey % 97 = 0 THEN 'none' ELSE 'out' END",
            "event_kind": "CASE WHEN o_custkey % 41 = 0 THEN NULL ELSE 'payment' END",
            "cash_effect": "o_custkey % 31 <> 0",
            "start": "CAST(o_orderdate AS TIMESTAMP_NTZ)",
            "end": "CAST(o_orderdate AS TIMESTAMP_NTZ) + INTERVAL 1 DAY",
            "basis": "'local'",
            "time_role": "'occurrence'",
            "funding_account": "CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE CAST(o_custkey % 3 AS STRING) END",
            "processor": "'p'",
            "reference": "CASE WHEN o_custkey % 6 = 0 THEN concat('ns:', CAST(o_custkey AS STRING)) END",
        },
    ),
    "ocr_tokens": (
        "lineitem",
        "true",
        {"page_id": "l_orderkey", "x": "CAST(l_quantity * 10 AS DOUBLE)", "y": "CAST(l_linenumber * 37 + l_suppkey % 5 AS DOUBLE)", "h": "CAST(12 AS DOUBLE)", "text": "CAST(l_partkey AS STRING)", "score": "1 - l_discount / 2"},
    ),
    "ocr_views": (
        "lineitem",
        "true",
        {"page_id": "l_orderkey * 100000 + l_partkey * 10 + l_suppkey % 10", "row": "l_linenumber", "v0": "CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE CAST(l_partkey % 9 AS STRING) END", "v1": "CASE WHEN l_suppkey % 7 = 0 THEN NULL WHEN l_suppkey % 11 = 0 THEN 'x' ELSE CAST(l_partkey % 9 AS STRING) END", "v2": "CASE WHEN l_suppkey % 6 = 0 THEN NULL ELSE CAST(l_partkey % 9 AS STRING) END"},
    ),
    "page_tokens": (
        "lineitem CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS v(part)",
        "true",
        {
            "page_id": "l_orderkey",
            "text": "CASE part WHEN 0 THEN CASE WHEN l_partkey % 9 = 0 THEN 'carried' ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END WHEN 1 THEN concat('goods', CAST(l_linenumber AS STRING)) WHEN 2 THEN CASE WHEN l_suppkey % 2 = 0 THEN '-' ELSE '+' END || CAST(CAST(l_quantity AS INT) AS STRING) || '.50' WHEN 3 THEN CAST(l_partkey AS STRING) ELSE 'more' END",
            "score": "1 - l_discount / 2",
            "x": "CAST(CASE part WHEN 4 THEN 120 ELSE 100 * part END + l_suppkey % 7 AS DOUBLE)",
            "y": "CAST(l_partkey % 700 * 40 + l_linenumber + 60 AS DOUBLE)",
            "h": "CAST(12 AS DOUBLE)",
            "w": "CAST(80 AS DOUBLE)",
        },
    ),
    "page_heads": (
        "orders CROSS JOIN (VALUES (0, '交易日期'), (1, '摘要'), (2, '交易金额'), (3, '余额')) AS v(part, label)",
        "true",
        {
            "page_id": "o_orderkey",
            "text": "CASE WHEN part = 0 AND o_orderkey % 7 = 0 THEN '日' WHEN part = 2 AND o_orderkey % 11 = 0 THEN '金' WHEN part = 1 AND o_orderkey % 13 = 0 THEN '余额' ELSE label END",
            "score": "CAST(0.99 AS DOUBLE)",
            "x": "CAST(100 * part AS DOUBLE)",
            "y": "CAST(10 + part AS DOUBLE)",
            "h": "CAST(12 AS DOUBLE)",
            "w": "CAST(60 AS DOUBLE)",
        },
    ),
    "page_views": (
        "lineitem CROSS JOIN (VALUES ('original', 0), ('dark_gray', 1), ('dark_neutral', 2)) AS v(view, k)",
        # A view of some pages lacks a row.
        "NOT (k = 1 AND l_orderkey % 13 = 0 AND l_linenumber = 1)",
        {
            "page_id": "l_orderkey",
            "view": "view",
            "row": "(l_partkey * 1000000 + l_suppkey % 1000 * 1000 + l_linenumber * 100 + CAST(l_quantity AS INT)) * 3 + k",
            "date_x": "CAST(10 + k AS DOUBLE)",
            "date_y": "CAST((l_partkey * 1000000 + l_suppkey % 1000 * 1000 + l_linenumber * 100 + CAST(l_quantity AS INT)) * 40 + k * (l_orderkey % 4) AS DOUBLE)",
            "date_width": "CAST(80 AS DOUBLE)",
            "row_height": "CAST(14 AS DOUBLE)",
            "transaction_at": "CASE WHEN l_partkey % 11 = k THEN NULL ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END",
            "amount": "CASE WHEN (l_partkey + k) % 7 = 0 THEN NULL WHEN k = 2 AND l_suppkey % 9 = 0 THEN '1.00' ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING) END",
            "direction": "CASE WHEN (l_suppkey + k) % 8 = 0 THEN NULL ELSE 'out' END",
            "balance": "CASE WHEN l_partkey % 3 = 0 OR k = 0 AND l_partkey % 2 = 0 THEN NULL ELSE CAST(l_partkey AS STRING) END",
        },
    ),
}


def adapter(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, condition, columns = ADAPTERS[name]
    table, _, joined = table.partition(" CROSS JOIN ")
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if joined:  # a few rows that the text itself names
        rows = rows.crossJoin(F.broadcast(spark.sql(f"SELECT * FROM {joined}")))
    return rows.where(condition).selectExpr(*[f"{e} AS `{c}`" for c, e in columns.items()])


def adapter_sql(name: str) -> str:
    """The same projection for DuckDB."""
    table, condition, columns = ADAPTERS[name]
    listed = ", ".join(f'{e} AS "{c}"' for c, e in columns.items()).replace("TIMESTAMP_NTZ", "TIMESTAMP")
    return f"(SELECT {listed} FROM {table} WHERE {condition})"
