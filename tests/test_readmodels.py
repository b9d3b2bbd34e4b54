"""Recognised rows, facts, manual changes, read models and bundles as small tables."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import browse, evidence, facts, ocr_records, review, totals
from ledgerloom.sources import statements


def test_recognised_rows(spark):
    cells = [
        {"date": "2026-09-01 10:20:30", "signed": "-￥1,234.50", "balance": "10"},
        {"date": "2026/09/01", "signed": "5", "balance": ""},
        {"date": "2026-09-0110:2", "credit": "7", "debit": "", "balance": "1"},
        {"date": "2026-02-30", "credit": "1", "debit": "2", "balance": "1.234"},
        {"date": "2026-09-01", "credit": "0.00", "debit": "-", "balance": "3"},
        {"date": "2026-09-01", "credit": "x", "debit": "-", "balance": "3"},
    ]
    rows = spark.createDataFrame([(i, c, [0.95] if i else [0.8]) for i, c in enumerate(cells)], "i int, cells map<string,string>, scores array<double>")
    found = {r.i: r for r in ocr_records.ocr_rows_to_records(rows).collect()}
    assert (found[0].transaction_at, found[0].amount, found[0].direction, found[0].balance, found[0].issues) == ("2026-09-01 10:20:30", Decimal("1234.50"), "out", Decimal("10.00"), ["LOW_OCR_SCORE"])
    assert (found[1].transaction_at, found[1].direction, found[1].issues) == ("2026-09-01", None, ["DIRECTION_UNKNOWN", "BALANCE_UNREADABLE"])
    assert (found[2].transaction_at, found[2].direction, found[2].issues) == (None, "in", ["DATE_UNREADABLE"])
    assert found[3].issues == ["AMBIGUOUS_DUAL_AMOUNT", "AMOUNT_UNREADABLE", "DIRECTION_UNKNOWN", "DATE_UNREADABLE", "BALANCE_UNREADABLE"]
    assert (found[4].amount, found[4].direction, found[4].issues) == (Decimal("0.00"), "none", [])
    assert found[5].issues == ["AMOUNT_UNREADABLE", "AMOUNT_UNREADABLE", "DIRECTION_UNKNOWN"]
    heads = spark.createDataFrame([("收入／ 支出金额",), ("备注",)], "h string").select(ocr_records.header_field(F.col("h")).alias("f")).collect()
    assert [r.f for r in heads] == ["signed", None]


def test_facts_and_times(spark):
    given = [("v", "bank", ["r"], False), ("v", "guess", ["r"], False), ("v", "bank", [], False), ("v", "bank", ["r"], True), ("", "bank", ["r"], False)]
    rows = spark.createDataFrame([({str(i): f for i, f in enumerate(given)},)], f"facts map<string,{facts.FACT}>")
    assert facts.known_facts(rows, ("bank",)).first().known == {"0": "v"}
    times = spark.createDataFrame([("2026-09-01 10:20:30", p) for p in ("day", "minute", "second", "hour")], "t string, p string")
    found = [r.x and (r.x.start, r.x.end) for r in times.select(facts.time_range(F.col("t"), F.col("p"), F.lit("local")).alias("x")).collect()]
    at = lambda *x: datetime(2026, 9, *x)
    assert found == [(at(1), at(2)), (at(1, 10, 20), at(1, 10, 21)), (at(1, 10, 20, 30), at(1, 10, 20, 31)), None]


def test_pairs_without_a_common_fact_are_counted(spark):
    rows = spark.createDataFrame([(1, 5, None), (2, 5, "x"), (3, None, "x"), (4, None, None), (5, None, None)], "id int, amount int, day string")
    pairs = {(r.a_id, r.b_id) for r in evidence.observation_pairs(rows, ["amount", "day"]).collect()}
    assert {tuple(sorted(p)) for p in pairs} == {(1, 2), (2, 3)}
    counted = {(r.a_known, r.b_known): r.n_pairs for r in evidence.unblocked_pairs(rows, ["amount", "day"]).collect()}
    assert counted == {("", ""): 1, ("", "amount"): 2, ("", "amount,day"): 2, ("", "day"): 2, ("amount", "day"): 1}


def test_checked_changes(spark):
    schema = "record_id string, transaction_at string, transaction_at_precision string, booking_at string, booking_at_precision string, amount string, direction string, currency string, balance string, transaction_status string, memo string"
    good = ("a", "2026-9-1", None, None, None, "￥5.50", "out", "CNY", "1", None, "m")
    bad = ("b", "soon", None, None, None, "-5", "up", "XXX", "x", "odd", "m" * 2001)
    found = {r.record_id: r for r in review.checked_changes(spark.createDataFrame([good, bad], schema)).collect()}
    assert (found["a"].problems, found["a"].transaction_at, found["a"].transaction_at_precision, found["a"].amount, found["a"].signed_amount, found["a"].transaction_status) == ([], "2026-09-01", "day", "5.5", "-5.5", "unknown")
    assert found["b"].problems == ["DATE_INVALID", "DATE_MISSING", "AMOUNT_INVALID", "DIRECTION_UNKNOWN", "CURRENCY_UNKNOWN", "BALANCE_INVALID", "STATUS_UNKNOWN", "TEXT_TOO_LONG"]


def test_field_attention(spark):
    records = spark.createDataFrame([("a", "pending", {"transaction_at": 0, "credit_amount": 1, "debit_amount": 2}), ("b", "ready", {"amount": 1})], "record_id string, review_status string, columns map<string,int>")
    issues = spark.createDataFrame([("a", "AMOUNT_INVALID", "error"), ("a", "DATE_MISSING", "error"), ("a", "ODD", "error"), ("a", "STATUS_UNKNOWN", "warning"), ("b", "AMOUNT_INVALID", "error")], "record_id string, code string, severity string")
    found = {(r.field, tuple(r.reasons), tuple(r["columns"] or ())) for r in review.field_attention(records, issues).collect()}
    assert found == {("amount", ("AMOUNT_INVALID",), (1, 2)), ("transaction_at", ("DATE_MISSING",), (0,)), (None, ("ODD",), ())}


def test_attention_by_the_field_of_an_issue(spark):
    columns, ambiguous = {"transaction_at": 0, "transaction_time": 1, "signed_amount": 2, "booking_at": 3, "memo": 4}, {"currency": [5, 6]}
    records = spark.createDataFrame([("a", "pending", columns, ambiguous), ("b", "pending", columns, {})], "record_id string, review_status string, columns map<string,int>, ambiguous map<string,array<int>>")
    issues = [(r, c, "error", f) for r in "ab" for c, f in (("CURRENCY_CONFLICT", "currency"), ("SPLIT_AMOUNT_NEGATIVE", "amount"), ("DATE_INVALID", "booking_at"), ("TIME_CONFLICT", "transaction_time"), ("FORMULA_CELL", "memo"), ("CELL_ERROR", "credit_amount"), ("ROW_WIDTH_MISMATCH", None))]
    found = review.field_attention(records, spark.createDataFrame(issues, "record_id string, code string, severity string, field string")).collect()
    by = {(r.record_id, r.field): (r.reasons, r["columns"]) for r in found}
    assert by["a", "currency"] == (["CURRENCY_CONFLICT"], [5, 6]) and by["b", "currency"] == (["CURRENCY_CONFLICT"], [2])
    assert by["a", "amount"] == (["CELL_ERROR", "CURRENCY_CONFLICT", "SPLIT_AMOUNT_NEGATIVE"], [2]) and by["a", "direction"] == (["SPLIT_AMOUNT_NEGATIVE"], [2])
    assert by["a", "booking_at"] == (["DATE_INVALID"], [3]) and by["a", "transaction_at"] == (["TIME_CONFLICT"], [0, 1]) and by["a", "memo"] == (["FORMULA_CELL"], [4]) and by["a", None] == (["ROW_WIDTH_MISMATCH"], None)


def test_verdicts_and_lists(spark):
    relations = spark.createDataFrame([("p", {"r": "1"}), ("q", {"r": "2"})], "id string, dependencies map<string,string>")
    verdicts = spark.createDataFrame([("p", 1, "v", "f", "no", {"r": "1"}), ("p", 2, "v", "f", "yes", {"r": "1"}), ("p", 3, "old", "f", "no", {"r": "1"}), ("q", 1, "v", "f", "yes", {"r": "0"})], "relation_id string, job int, policy string, fingerprint string, verdict string, dependencies map<string,string>")
    assert {r.id: r.verdict for r in browse.with_verdicts(relations, verdicts, "v", "f").collect()} == {"p": "yes", "q": None}
    assert [r.job for r in browse.latest_jobs(verdicts, 2).collect()] == [3, 2]
    listed = spark.createDataFrame([("a", "", "2026-01-02"), ("b", "2026-01-03", None), ("c", None, None), ("d", "2026-01-02", None)], "id string, transaction_at string, booking_at string")
    assert [r.id for r in browse.transactions_order(listed).collect()] == ["b", "d", "a", "c"]
    texts = spark.createDataFrame([("f", 2, 1, ["z"]), ("f", 1, 1, ["x", None, "y"])], "file_id string, place int, line int, values array<string>")
    assert browse.document_text(texts).first().text == "x\ny\nz"
    batches = spark.createDataFrame([("k", "1", 2, 0, True), ("k", "2", 3, None, False)], "book_id string, batch_id string, n long, blockers int, readable boolean")
    assert {(r.batch_id, r.n, r.blockers) for r in totals.book_rollup(batches, ["n"]).collect()} == {("1", 2, 0), ("2", 3, 1), (None, 5, 1)}
    base, manual = spark.createDataFrame([("a",)], "record_id string"), spark.createDataFrame([("m", "x")], "record_id string, memo string")
    assert {(r.record_id, r.manual, r.memo) for r in review.with_manual(base, manual).collect()} == {("a", False, None), ("m", True, "x")}


def test_bundles_and_their_gates(spark, tmp_path):
    table = spark.createDataFrame([(1, "ready"), (2, "needs_review")], "record_id int, parse_status string")
    statements.write_bundle({"records": table}, str(tmp_path / "part"), status="needs_review")
    with pytest.raises(ValueError, match="errors"):
        statements.load_records(spark, str(tmp_path / "part"))
    assert statements.load_records(spark, str(tmp_path / "part"), ready_only=False, allow_partial=True).count() == 2
    table.write.parquet(str(tmp_path / "open" / "records"))
    with pytest.raises(ValueError, match="end"):
        statements.load_records(spark, str(tmp_path / "open"))
    (tmp_path / "part" / "evidence").mkdir()
    (tmp_path / "part" / "evidence" / "a.png").write_bytes(b"picture")
    assets = spark.createDataFrame([("evidence/a.png",)], "path string").withColumn("sha256", F.sha2(F.lit("picture").cast("binary"), 256))
    assert bytes(statements.evidence_file(spark, str(tmp_path / "part"), "evidence/a.png", assets).first().content) == b"picture"
    assert statements.evidence_file(spark, str(tmp_path / "part"), "evidence/a.png", assets.withColumn("sha256", F.lit("0"))).count() == 0
    for path in ("evidence/../records", "/etc/passwd", "other/a.png", "evidence\\a.png"):
        with pytest.raises(ValueError, match="relative"):
            statements.evidence_file(spark, str(tmp_path / "part"), path, assets)
