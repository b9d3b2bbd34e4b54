"""The rules' scenarios as small tables with the rows that they have to give."""

from __future__ import annotations

from decimal import Decimal
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import dates, money, privacy, text
from ledgerloom.lineage import cut
from ledgerloom.operators import analysis, browse, duplicates, evidence, headers, normalize, ocr, pairing, refunds, review, totals
from ledgerloom.schema import RECORD
from ledgerloom.sources import statements


def records(spark, *given):
    base = {"batch_id": "b", "file_id": "f1", "amount": "58.00", "currency": "CNY", "direction": "out", "transaction_at": "2026-01-01 12:00:00", "transaction_at_precision": "second", "transaction_status": "posted"}
    rows = [base | {"book_record_id": f"r{i}"} | g for i, g in enumerate(given)]
    return spark.createDataFrame([tuple(r.get(f.name) for f in RECORD) for r in rows], RECORD).withColumn("id", F.col("book_record_id"))


WALLET = {"source": "微信", "counterparty": "某超市", "payment_method": "建设银行储蓄卡(1234)", "source_record_id": "order10001", "trade_type": "商户消费", "description": "苹果"}
BANK = {"source": "建设银行", "counterparty": "财付通", "memo": "财付通-微信支付-某超市", "account": "6222001234", "description": "消费", "transaction_at": "2026-01-01 12:00:02"}


def candidates(spark, *given):
    return pairing.single_candidates(*map(cut, pairing.sides(records(spark, *given))))


def adopted(spark, *given):
    found = candidates(spark, *given).withColumns({"id": F.concat_ws("-", "bank_id", "order_id"), "endpoints": F.array("bank_id", "order_id"), "counted": F.lit(True)})
    return {(r.bank_id, r.order_id): r.status for r in pairing.adopt(found).collect()}


def test_mirror_is_one_payment(spark):
    assert adopted(spark, WALLET, BANK) == {("r1", "r0"): "automatic"}


def test_same_amount_and_time_is_not_enough(spark):
    assert adopted(spark, WALLET | {"payment_method": "零钱"}, BANK) == {}


def test_two_equal_orders_are_left_to_a_person(spark):
    assert set(adopted(spark, WALLET, WALLET | {"source_record_id": "order10002"}, BANK).values()) == {"suggested"}


def test_reference_pairs_beyond_the_window(spark):
    bank = BANK | {"memo": "ref order10001", "transaction_at": "2026-02-01 00:00:00"}
    assert adopted(spark, WALLET, bank) == {("r1", "r0"): "automatic"}


def test_account_tail_conflict_blocks_even_a_reference(spark):
    assert adopted(spark, WALLET, BANK | {"memo": "ref order10001", "account": "6222005678"}) == {}


def test_pairs_across_midnight(spark):
    wallet = WALLET | {"transaction_at": "2026-01-01 23:58:00"}
    assert adopted(spark, wallet, BANK | {"transaction_at": "2026-01-02 00:01:00"}) == {("r1", "r0"): "automatic"}


@pytest.mark.parametrize(
    ("kind", "narrative", "pairs"),
    [("转账", "微信支付转账", True), ("微信红包", "微信支付红包", True), ("微信红包", "微信支付转账", False), ("群收款", "微信支付群收款", True), ("转账", "微信支付退款", False), ("转账", "微信支付充值", False)],
)
def test_transfer_kinds_must_agree(spark, kind, narrative, pairs):
    wallet = WALLET | {"trade_type": kind, "counterparty": "Friend"}
    found = candidates(spark, wallet, BANK | {"memo": narrative}).collect()
    assert [r.transfer for r in found] == [pairs]


def test_refund_mirror_merges_incoming(spark):
    wallet = WALLET | {"direction": "in", "trade_type": "退款"}
    bank = BANK | {"direction": "in", "description": "退货", "memo": "财付通"}
    assert [r.refund_mirror for r in candidates(spark, wallet, bank).collect()] == [True]


def test_overlapping_exports_are_one_and_repeats_in_a_file_are_not(spark):
    row = WALLET | {"balance": "1"}
    rows = [row, row | {"file_id": "f2"}]
    ids = lambda rs: duplicates.source_duplicates(records(spark, *rs)).select("transaction_id").distinct().count()
    assert ids(rows) == 1
    assert ids([*rows, row | {"file_id": "f2"}]) == 3
    unnamed = [r | {"source_record_id": None} for r in rows]
    assert ids(unnamed) == 1
    assert ids([r | {"balance": None} for r in unnamed]) == 2


def test_field_union_keeps_every_value(spark):
    members = records(spark, WALLET, BANK).withColumn("transaction_id", F.lit("t"))
    fields = duplicates.field_union(duplicates.field_alternatives(members)).first().fields
    assert fields["counterparty"].selected == "某超市"
    assert {a.value for a in fields["counterparty"].alternatives} == {"某超市", "财付通"}
    assert fields["payment_method"].multiple_values is False


def test_combined_payment_searches_pools_of_any_size(spark):
    from itertools import combinations

    orders = [(i, i * 7 % 23 + 1, "ab"[i % 5 == 0]) for i in range(20)] + [(90 + i, 900, "a") for i in range(5)]
    pool = spark.createDataFrame([(1, Decimal(40), i, Decimal(a), s, i % 3 > 0) for i, a, s in orders], "bank_id long, bank_amount decimal(18,2), order_id long, order_amount decimal(18,2), order_source string, referred boolean")
    for size in (2, 3, 4):
        want = {(*[i for i, _, _ in c], all(i % 3 for i, _, _ in c)) for c in combinations(orders, size) if sum(a for _, a, _ in c) == 40 and len({s for *_, s in c}) == 1}
        found = pairing.combined_candidates(pool, size).drop("bank_id", "bank_amount").collect()
        assert want and sorted(map(tuple, found)) == sorted(want)


def test_combined_payment(spark):
    pool = spark.createDataFrame([(1, Decimal("58"), i, Decimal(a), "s", True) for i, a in enumerate(("20", "38", "50"))], "bank_id long, bank_amount decimal(18,2), order_id long, order_amount decimal(18,2), order_source string, referred boolean")
    assert [(r.o1, r.o2, r.automatic) for r in pairing.combined_candidates(pool, 2).collect()] == [(0, 1, True)]
    assert pairing.combined_candidates(pool, 3).count() == 0
    assert pairing.combined_candidates(pool, 2, most=2).count() == 0
    assert [r.n_orders for r in pairing.truncated_pools(pool, 2).collect()] == [3]


def test_conflict_with_an_adopted_proposal(spark):
    rows = [("a", ["x", "y"], True, True), ("b", ["x", "z", "w"], False, False), ("c", ["q", "r"], False, True)]
    found = pairing.adopt(spark.createDataFrame(rows, "id string, endpoints array<string>, automatic boolean, counted boolean"))
    assert {r.id: r.status for r in found.collect()} == {"a": "automatic", "b": "conflict", "c": "suggested"}


def test_refund_links_within_capacity(spark):
    schema = "credit_id string, expense_id string, amount decimal(18,2), room decimal(18,2)"
    fits = spark.createDataFrame([("c1", "e", Decimal(20), Decimal(58))], schema)
    over = spark.createDataFrame([("c1", "e", Decimal(40), Decimal(58)), ("c2", "e", Decimal(20), Decimal(58))], schema)
    assert [r.linked for r in refunds.link_refunds(fits).collect()] == [True]
    assert [r.linked for r in refunds.link_refunds(over).collect()] == [False, False]
    person = over.withColumns({"id": F.col("credit_id"), "accepted": F.col("credit_id") == "c1", "unruled": F.col("credit_id") != "c1"})
    assert {r.id: r.linked for r in refunds.allocate_accepted(person).collect()} == {"c1": True, "c2": False}


def test_refund_allocation_over_both_ends(spark):
    import random

    schema = "id string, credit_id string, expense_id string, amount int, room int, accepted boolean, unruled boolean"
    chance, rows = random.Random(4), []
    for book in range(40):
        room = {f"e{book}-{i}": chance.randint(10, 60) for i in range(4)}
        pairs = {(f"c{book}-{chance.randint(0, 5)}", chance.choice(sorted(room))) for _ in range(chance.randint(1, 14))}
        size = {c: chance.randint(1, 30) for c, _ in sorted(pairs)}
        for c, e in sorted(pairs):
            choice = chance.choice(["accept", None, "reject"])
            rows.append((f"{chance.random():.9f}{c}{e}", c, e, size[c], room[e], choice == "accept", choice is None))
    expected, used, given = {}, {}, set()
    for id_, c, e, amount, room, accepted, unruled in sorted(rows):
        alone = sum(r[1] == c for r in rows) == 1 and sum(r[3] for r in rows if r[2] == e) <= room
        expected[id_] = c not in given and used.get(e, 0) + amount <= room and (accepted or unruled and alone)
        if expected[id_]:
            given.add(c)
            used[e] = used.get(e, 0) + amount
    assert {r.id: r.linked for r in refunds.allocate_accepted(spark.createDataFrame(rows, schema)).collect()} == expected
    twice = [("1", "c", "e", 5, 9, True, False), ("2", "c", "f", 5, 9, True, False)]
    assert {r.id: r.linked for r in refunds.allocate_accepted(spark.createDataFrame(twice, schema)).collect()} == {"1": True, "2": False}
    assert refunds.allocate_accepted(spark.createDataFrame([], schema)).count() == 0


MONEY = [
    ("-￥1,234.50", "-1234.50"), ("￥-1,234.50", "-1234.50"), ("（￥1,234.50）", "-1234.50"), ("人民币负1,234.50", "-1234.50"), ("1,234.50-", "-1234.50"), ("−1234.50", "-1234.50"),
    ("+￥1,234.50", "1234.50"), ("￥+1,234.50", "1234.50"), ("1234.50元", "1234.50"), ("USD +1,234.50", "1234.50"),
    ("￥-+12", None), ("(-12)", None), ("USD ￥12", None), ("1,23.45", None), ("1.234,50", None), ("12abc", None), ("NaN", None), ("1e10", None), ("1 234.50", None), ("--12", None), ("", None), ("1000000000000000", None),
]


def test_money_grammar(spark):
    rows = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(MONEY)], "i int, v string")
    found = {r.i: r.m.amount for r in money.with_money(rows, {"m": "v"}).collect()}
    assert found == {i: None if w is None else Decimal(w) for i, (_, w) in enumerate(MONEY)}


def test_dates(spark):
    given = {"20260901": ("2026-09-01", "day"), "2026-09-01garbage": None, "46266": None, "2026年9月1日": ("2026-09-01", "day"), "2026/9/1 8:05": ("2026-09-01 08:05:00", "minute"), "2026-02-30": None, "20260901102030": ("2026-09-01 10:20:30", "second")}
    rows = spark.createDataFrame([(v,) for v in given], "v string").select("v", dates.date_struct(F.col("v")).alias("d")).collect()
    assert {r.v: r.d and tuple(r.d) for r in rows} == given
    clock = spark.range(1).select(dates.with_clock(dates.date_struct(F.lit("2026-08-01")), F.lit("10:20:30"), F.lit(True)).alias("x"), dates.day_fraction_time(F.lit(0.5)).alias("noon")).first()
    assert (clock.x.at, clock.x.issue, clock.noon) == ("2026-08-01 10:20:30", None, "12:00:00")


def test_norm_is_unicode(spark):
    row = spark.createDataFrame([("ＡＢ－微信 支付ß",)], "v string").select(text.norm(F.col("v")).alias("n"), text.identifier(F.lit("62**78")).alias("masked"), text.identifier(F.lit(" 123456 ")).alias("ok")).first()
    assert tuple(row) == ("ab微信支付ss", None, "123456")


def test_status_words(spark):
    given = {"交易关闭": "void", "已退款": "posted", "退款失败": "void", "处理中": "pending", "odd": "unknown", "": "unknown"}
    rows = spark.createDataFrame([(v,) for v in given], "v string").select("v", normalize.status_of(F.col("v")).alias("s")).collect()
    assert {r.v: r.s for r in rows} == given


def test_unsigned_amount_has_no_direction(spark):
    schema = "cell_date string, cell_amount string, cell_signed string, cell_credit string, cell_debit string, cell_direction string, cell_currency string, cell_status string, signed_format boolean, split boolean"
    rows = [("2026-01-01", "5", None, None, None, None, None, None, False, False), ("2026-01-01", None, None, "5", "6", None, "CNY", None, False, True), ("2026-01-01", "+5", None, None, None, None, "CNY", None, False, False)]
    found = normalize.normalize_rows(spark.createDataFrame(rows, schema)).collect()
    assert found[0].issues == ["DIRECTION_MISSING", "CURRENCY_DEFAULTED"] and found[0].parse_status == "needs_review"
    assert found[1].issues == ["BOTH_DIRECTIONS", "DIRECTION_MISSING", "AMOUNT_MISSING"]
    assert (found[2].direction, found[2].parse_status) == ("in", "ready")


def test_scaled_sum(spark):
    rows = spark.createDataFrame([("21",), ("0.50",)], "v string")
    assert rows.agg(totals.scaled_sum(F.col("v"), "t")).first().t == "21.50"


def test_header_mapping_and_profiles(spark):
    layouts = {
        "wechat": ["交易时间", "交易类型", "交易对方", "商品", "收/支", "金额(元)", "支付方式", "当前状态", "交易单号", "商户单号", "备注"],
        "ccb": ["序号", "摘要", "币别", "钞汇", "交易日期", "交易金额", "账户余额", "对方账号与户名", "交易地点/附言"],
        "both": ["交易日期", "交易时间", "金额"],
        "two": ["金额", "交易金额", "日期"],
    }
    given = spark.createDataFrame(list(layouts.items()), "segment_id string, headers array<string>")
    mapped = headers.map_headers(given)
    got = {(r.segment_id, r.field): r.columns for r in mapped.collect()}
    assert got["wechat", "amount"] == [5] and got["wechat", "transaction_at"] == [0]
    assert got["both", "transaction_at"] == [0] and got["both", "transaction_time"] == [1]
    assert got["two", "amount"] == [0, 1]
    assert {r.segment_id: r.profile for r in headers.match_profiles(given).collect()} == {"wechat": "wechat.export.v1", "ccb": "ccb.account_activity.v1"}
    assert {r.segment_id: r.usable for r in headers.header_scores(mapped).collect()} == dict.fromkeys(layouts, True)


def test_row_dispositions(spark):
    values = [["note"], ["日期", "金额"], ["2026-01-01", "5"], ["", None], ["合计", "5"], ["---", "=="], ["日期", "金额"], ["2026-01-02", "6"]]
    rows = spark.createDataFrame([("s", i, v, v == ["日期", "金额"]) for i, v in enumerate(values)], "segment_id string, line int, values array<string>, is_header boolean")
    found = [r.disposition for r in headers.row_disposition(rows).orderBy("line").collect()]
    assert found == ["preamble", "header", "transaction", "blank", "footer", "separator", "header", "transaction"]


def test_csv_files(spark, tmp_path):
    body = "交易日期,金额,收/支\n2026-09-01,1,支出\n\"a\nb\",2,收入\n"
    (tmp_path / "a.csv").write_bytes(body.encode("gb18030"))
    (tmp_path / "b.csv").write_bytes(body.replace(",", "\t").encode("utf-16"))
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "d.csv").write_bytes(b'"x"y,1,2\n')
    files = statements.read_files(spark, str(tmp_path))
    kinds = {r.path.rsplit("/", 1)[1]: (r.f.format, r.f.issue) for r in files.select("path", statements.file_format(F.col("path"), F.col("content"), F.col("length")).alias("f")).collect()}
    assert kinds == {"a.csv": ("csv", None), "b.csv": ("csv", None), "c.pdf": ("pdf", None), "d.csv": ("csv", None)}
    rows = statements.csv_rows(files.where("path LIKE '%.csv'")).collect()
    for name in ("a.csv", "b.csv"):
        mine = sorted((r.line, r.end_line, tuple(r["values"])) for r in rows if r.path.endswith(name))
        assert mine == [(1, 1, ("交易日期", "金额", "收/支")), (2, 2, ("2026-09-01", "1", "支出")), (3, 4, ("a\nb", "2", "收入"))]
    assert [r.issue for r in rows if r.path.endswith("d.csv")] == ["CSV_SYNTAX"]
    known = files.where("path LIKE '%a.csv'")
    assert statements.new_files(files, known).count() == 3


def test_bundle_is_written_once(spark, tmp_path):
    table = spark.createDataFrame([(1, "ready"), (2, "needs_review")], "record_id int, parse_status string")
    statements.write_bundle({"records": table}, str(tmp_path / "bundle"))
    assert statements.load_records(spark, str(tmp_path / "bundle")).count() == 1
    with pytest.raises(Exception, match="(?i)exist"):
        statements.write_bundle({"records": table}, str(tmp_path / "bundle"))


def test_decisions_fold_undo_to_reject(spark):
    events = spark.createDataFrame([(1, "accept", "a", None), (2, "undo", None, 1), (3, "defer", "b", None), (4, "undo", None, 3), (5, "reject", "c", None), (6, "accept", "c", None)], "revision long, action string, relation_id string, target long")
    assert {r.relation_id: r.action for r in review.fold_decisions(events).collect()} == {"a": "reject", "c": "accept"}


def test_inherited_rejection(spark):
    schema = "id string, kind string, source_ids array<string>"
    proposals = spark.createDataFrame([("n", "payment", ["1", "2", "3"]), ("m", "refund", ["1", "2"])], schema)
    old = spark.createDataFrame([("o", "payment", ["1", "2"], "reject", 4), ("p", "payment", ["1", "9"], "defer", 5)], schema + ", action string, revision long")
    assert {r.id: r.action for r in review.inherited_decisions(proposals, old).collect()} == {"n": "reject"}


def test_overlay_states_null(spark):
    base = spark.createDataFrame([(1, "x", "y"), (2, "x", "y")], "record_id int, counterparty string, memo string")
    change = spark.createDataFrame([(1, ["counterparty"], None, "ignored")], "record_id int, changed array<string>, counterparty string, memo string")
    assert {tuple(r) for r in review.overlay(base, change, "record_id", ["counterparty", "memo"]).collect()} == {(1, None, "y", True), (2, "x", "y", False)}


def observation(i, **facts):
    base = {"id": i, "role": "account_ledger", "amount": Decimal("58.00"), "currency": "CNY", "direction": "out", "event_kind": "payment", "cash_effect": True, "start": "2026-01-01", "end": "2026-01-02", "basis": "local", "time_role": "occurrence", "references": None, "funding_account": "a", "processor": "p"}
    return base | facts


OBSERVATION = "id string, role string, amount decimal(18,2), currency string, direction string, event_kind string, cash_effect boolean, start string, end string, basis string, time_role string, references array<string>, funding_account string, processor string"


def assessed(spark, *rows):
    names = [c.split()[0] for c in OBSERVATION.split(", ")]
    frame = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], OBSERVATION)
    frame = frame.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})
    return frame, evidence.assess_pairs(evidence.observation_pairs(frame, ["amount", "currency"]))


def test_unknown_is_not_conflict(spark):
    _, pairs = assessed(spark, observation("1"), observation("2", role="payment_platform"), observation("3", role="payment_platform", amount=None), observation("4", role="payment_platform", processor="q"))
    got = {(r.a_id, r.b_id): (r.state, r.conflicts, r.missing) for r in pairs.collect()}
    by_ids = {tuple(sorted(k)): v for k, v in got.items()}
    assert by_ids["1", "2"][0] == "supported"
    assert by_ids["1", "3"][0] == "needs_evidence" and "amount_unknown" in by_ids["1", "3"][2]
    assert by_ids["1", "4"] == ("rejected", ["processor_mismatch"], ["identity_link_unknown"])


def test_groups_do_not_depend_on_order(spark):
    rows = [observation("1"), observation("2"), observation("3", role="payment_platform"), observation("4", role="payment_platform")]
    seen = set()
    for order in list(permutations(rows))[::8]:
        frame, pairs = assessed(spark, *order)
        group = evidence.review_groups(pairs, frame, frame.where("false"), complete=True).first()
        seen.add((group.component, group.n_left, group.n_right, group.state, str(group.amount)))
    assert seen == {("1", 2, 2, "group_review", "116.00")}


def test_forced_pairs(spark):
    links = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (1, "b", "y"), (2, "c", "z"), (2, "c", "w"), (2, "d", "z"), (2, "d", "w")], "component int, left_id string, right_id string")
    assert {tuple(r) for r in evidence.forced_pairs(links).collect()} == {(1, "a", "x"), (1, "b", "y")}


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert [r.component for r in evidence.components(edges).select("component").distinct().collect()] == [0]


def test_balance_chain_and_counts(spark):
    rows = spark.createDataFrame([(1, 0, 5.0, "in", 10.0), (1, 1, 5.0, "in", 15.0), (1, 2, 5.0, "out", 9.0)], "page_id int, row int, amount double, direction string, balance double")
    assert [r.chain_conflict for r in ocr.balance_chain(rows).orderBy("row").collect()] == [False, True, True]
    footers = spark.createDataFrame([(1, "本页交易笔数:3"), (2, "本页交易笔数:3 本页交易数量4")], "page_id int, text string")
    assert {r.page_id: r.printed for r in ocr.printed_count(footers).collect()} == {1: 3, 2: None}


def test_rows_match_by_place_or_not_at_all(spark):
    schema = "page_id int, row int, date_x double, date_y double, date_width double, row_height double"
    base = spark.createDataFrame([(1, 0, 5.0, 10.0, 8.0, 20.0), (1, 1, 5.0, 30.0, 8.0, 20.0), (2, 0, 5.0, 10.0, 8.0, 20.0)], schema)
    other = spark.createDataFrame([(1, 0, 6.0, 11.0, 8.0, 20.0), (1, 1, 5.0, 31.0, 8.0, 20.0), (2, 0, 5.0, 40.0, 8.0, 20.0)], schema)
    assert {tuple(r) for r in ocr.match_rows(base, other).collect()} == {(1, 0, 0), (1, 1, 1)}


def test_header_columns_and_bands(spark):
    heads = spark.createDataFrame([(1, 10.0, "date"), (1, 30.0, None), (1, 50.0, "signed")], "page_id int, x double, field string")
    assert {(r.field, r.left_x, r.right_x) for r in ocr.column_bounds(heads).collect()} == {("date", float("-inf"), 20.0), ("signed", 40.0, float("inf"))}


def test_private_texts(spark):
    rows = spark.createDataFrame([(1, "to Ann Lee at 13800001111 or a@b.cn"), (2, "密码 1"), (3, None)], "id int, t string")
    masked = {r.id: r.t for r in rows.select("id", privacy.outbound_text(F.col("t")).alias("t")).collect()}
    assert masked == {1: "to Ann Lee at [number] or [mail]", 2: privacy.OMITTED, 3: ""}
    other = spark.createDataFrame([("call １３８００１３８０００ or ٠١٢٣٤٥٦٧٨٩, not 1234567",)], "t string")
    assert other.select(privacy.mask_patterns(F.col("t"))).first()[0] == "call [number] or [number], not 1234567"
    assert not any(c.isdigit() for c in other.select(privacy.token_patterns(b"k")(F.col("t"))).first()[0].split(" or ")[0].replace("call P", "")[20:])
    key = b"k"
    token = {r.value: r.t for r in spark.createDataFrame([("Ann",), ("Ann Lee",), ("张三丰",)], "value string").select("value", privacy.hmac_token(key)(F.col("value")).alias("t")).collect()}
    names = spark.createDataFrame([(v,) for v in token], "value string")
    inside = spark.createDataFrame([(1, "to Ann Lee and Ann"), (2, "转给张三丰先生的款"), (3, None), (4, "none")], "id int, t string")
    masked = {r.id: r.t for r in privacy.mask_literals(inside, "id", "t", names, key).collect()}
    assert masked == {1: f"to {token['Ann Lee']} and {token['Ann']}", 2: f"转给{token['张三丰']}先生的款", 3: None, 4: "none"}


def test_outbound_rows(spark):
    friend = WALLET | {"trade_type": "转账", "counterparty": "李四", "description": "转账给李四", "source_record_id": "order10009", "book_record_id": "f"}
    given = records(spark, WALLET | {"memo": "call 13800001111, 李四 order10009", "book_record_id": "m"}, friend, BANK | {"book_record_id": "b"})
    key = b"k"
    rows = {(r.counterparty, r.description, r.memo, r.payment_method): r for r in privacy.outbound_rows(given, key).collect()}
    assert len(rows) == 3
    merchant = next(r for r in rows.values() if r.counterparty == "某超市")
    assert merchant.description == "苹果" and not any(x in merchant.memo for x in ("13800001111", "李四", "order10009"))
    assert merchant.payment_method.startswith("建设银行储蓄卡(P") and "1234" not in merchant.payment_method.replace(merchant.payment_method[8:], "")
    others = [r for r in rows.values() if r.counterparty != "某超市"]
    assert all(r.counterparty.startswith("P") and r.description == privacy.WITHHELD_DESCRIPTION and r.memo == privacy.WITHHELD_MEMO for r in others)
    flat = str(list(rows.values()))
    assert not any(x in flat for x in ("李四", "6222001234", "order10001", "order10009"))


def test_fingerprint_ignores_order(spark):
    rows = [(1, "a"), (2, "b"), (3, None)]
    prints = {browse.fingerprint(spark.createDataFrame(list(p), "id int, v string")).first()[0] for p in permutations(rows)}
    assert len(prints) == 1 and browse.fingerprint(spark.createDataFrame(rows[:2], "id int, v string")).first()[0] not in prints


def test_coverage_invariant(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "book_record_id string")
    used = spark.createDataFrame([(["a"],), (["a"],)], "source_ids array<string>")
    assert sorted(tuple(r) for r in browse.coverage_gaps(rows, used).collect()) == [("a", "extra"), ("b", "missing")]


def analysed(spark, *given, decisions=None):
    made = analysis.build_analysis(records(spark, *given).drop("id"), decisions)
    transactions = sorted((str(r.money.normalize()), r.direction, tuple(r.source_ids), r.refund_linked) for r in made.transactions.collect())
    relations = sorted((r.kind, r.left_id, tuple(r.right_ids), r.decision) for r in made.relations.collect())
    return transactions, relations, {r.currency: (str(r.total_in), str(r.total_out), str(r.total_refund)) for r in made.totals.collect()}, made


def test_analysis_of_seed_rows(spark):
    """Two equal bank rows and one order are left to a person, the rest is merged or stands alone."""
    transactions, relations, total, _ = analysed(spark, WALLET, BANK, WALLET | {"amount": "20.00", "source_record_id": "order10002", "payment_method": "零钱"})
    assert total == {"CNY": ("0.00", "78.00", "0.00")}
    assert [(t[0], t[2]) for t in transactions] == [("2E+1", ("r2",)), ("58", ("r0", "r1"))]
    assert relations == [("payment", "r1", ("r0",), "automatic")]


def test_analysis_combined_payment_and_conflict(spark):
    parts = [WALLET | {"amount": "20.00", "source_record_id": "order20001"}, WALLET | {"amount": "38.00", "source_record_id": "order20002"}]
    bank = BANK | {"memo": "order20001 order20002 财付通"}
    transactions, relations, total, _ = analysed(spark, *parts, bank)
    assert total == {"CNY": ("0.00", "58.00", "0.00")} and relations == [("payment", "r2", ("r0", "r1"), "automatic")]
    assert [t[2] for t in transactions] == [("r0", "r2"), ("r1", "r2")]
    weak = analysed(spark, WALLET, *[p | {"source_record_id": f"order3000{i}"} for i, p in enumerate(parts)], BANK)[1]
    assert weak == [("payment", "r3", ("r0",), "automatic"), ("payment", "r3", ("r1", "r2"), "conflict")]


def test_analysis_duplicates_and_refunds(spark):
    twice = [WALLET, WALLET | {"file_id": "f2"}]
    refund = WALLET | {"direction": "in", "amount": "20.00", "trade_type": "退款", "transaction_at": "2026-01-02 12:00:00", "payment_method": "零钱"}
    transactions, relations, total, made = analysed(spark, *twice, refund)
    assert total == {"CNY": ("20.00", "58.00", "20.00")}
    assert [t[2] for t in transactions] == [("r2",), ("r0", "r1")] and [t[3] for t in transactions] == [True, False]
    assert {(k, d) for k, *_, d in relations} == {("duplicate", "automatic"), ("refund", "automatic")}
    assert analysis.source_coverage(made.transactions.select(F.explode("source_ids").alias("book_record_id")), made.transactions).count() == 0


def test_analysis_decisions(spark):
    """A person chooses between two orders; a rejection holds; an accept of changed records is stale."""
    given = [WALLET, WALLET | {"source_record_id": "order10002"}, BANK]
    _, open_, _, made = analysed(spark, *given)
    assert {d for *_, d in open_} == {"suggested"}
    digests = {r.book_record_id: r.digest for r in analysis.record_digests(records(spark, *given)).collect()}
    chosen = next(r for r in made.relations.collect() if r.right_ids == ["r1"])

    def decided(action, dependencies):
        row = (chosen.id, "payment", chosen.source_ids, action, 1, dependencies)
        return spark.createDataFrame([row], analysis.DECISION)

    now = {k: digests[k] for k in chosen.source_ids}
    transactions, relations, total, _ = analysed(spark, *given, decisions=decided("accept", now))
    assert {r[2][0]: r[3] for r in relations} == {"r1": "accepted", "r0": "conflict"} and total == {"CNY": ("0.00", "116.00", "0.00")}
    rejected = {r[2][0]: r[3] for r in analysed(spark, *given, decisions=decided("reject", None))[1]}
    assert rejected == {"r1": "reject", "r0": "suggested"}
    stale = analysed(spark, *given, decisions=decided("accept", now | {"r1": "old"}))
    assert {r[2][0]: r[3] for r in stale[1]} == {"r1": "stale", "r0": "suggested"}
    assert [r.id for r in analysis.stale_decisions(stale[3].relations, decided("accept", None)).collect()] == [chosen.id]
