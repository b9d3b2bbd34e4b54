"""Operators that tell what pairs say without making the pairs, against the pairs themselves."""

from __future__ import annotations

import random
from itertools import permutations

from pyspark.sql import functions as F

from ledgerloom.operators import evidence

OBSERVATION = "id long, role string, amount decimal(18,2), currency string, direction string, event_kind string, cash_effect boolean, start timestamp_ntz, end timestamp_ntz, basis string, time_role string, funding_account string, processor string, references array<string>"
BLOCK = ["amount", "currency", "direction", "start"]


def observed(spark, n: int, seed: int):
    from datetime import datetime, timedelta
    from decimal import Decimal

    pick, rows = random.Random(seed), []
    for i in range(n):
        day = pick.choice([datetime(2026, 1, 1), datetime(2026, 1, 2), None])
        referred = pick.choice([None, None, [], ["a"], ["b"], ["a", "b"], ["c", "c"]])
        rows.append((i, pick.choice(["account_ledger", "payment_platform", "payment_platform", "account_ledger", None]), pick.choice([Decimal(5), Decimal(5), Decimal(7), None]), "CNY", pick.choice(["out", "out", "out", None]), pick.choice(["payment"] * 9 + [None]), True, day, day and day + timedelta(days=1), "local", "occurrence", pick.choice(["1", "2", None]), "p", referred))
    return spark.createDataFrame(rows, OBSERVATION)


def test_classes_say_what_pairs_say(spark):
    for seed in (1,):
        rows = observed(spark, 70, seed)
        pairs = evidence.assess_pairs(evidence.observation_pairs(rows, BLOCK)).select("a_id", "b_id", "state").collect()
        found = evidence.assess_classes(rows, BLOCK)
        assert found.pairs.count() < len(pairs)
        label = {}
        supported = [(r.a_id, r.b_id) for r in pairs if r.state == "supported"]
        for x in sorted({x for p in supported for x in p}):
            todo = [] if x in label else [x]
            while todo:
                label[y := todo.pop()] = x
                todo += [z for p in supported if y in p for z in p if z not in label]
        assert supported and {(r.id, r.component) for r in evidence.class_components(found).collect()} == set(label.items())
        doubtful = sorted({x for r in pairs if r.state == "needs_evidence" for x in (r.a_id, r.b_id)})
        assert sorted(r.id for r in evidence.class_doubts(found).collect()) == doubtful


def test_doubt_ends_where_every_partner_shares_a_reference(spark):
    rows = observed(spark, 4, 1).drop("role", "funding_account", "references", "amount", "direction", "event_kind", "start", "end")
    day = F.lit("2026-01-01").cast("timestamp_ntz")
    alike = {"amount": F.lit(5).cast("decimal(18,2)"), "direction": F.lit("out"), "event_kind": F.lit("payment"), "start": day, "end": day + F.expr("INTERVAL 1 DAY"), "funding_account": F.lit(None).cast("string")}
    rows = rows.withColumns(alike | {"role": F.when(F.col("id") < 2, "account_ledger").otherwise("payment_platform"), "references": F.when(F.col("id") == 0, F.array(F.lit("a"), F.lit("b"))).when(F.col("id") == 2, F.array(F.lit("b"))).otherwise(F.array(F.lit("a")))})
    found = evidence.assess_classes(rows, BLOCK)
    assert sorted(r.id for r in evidence.class_doubts(found).collect()) == [1, 2]  # they share none; 0 and 3 share one with all
    assert {(r.id, r.component) for r in evidence.class_components(found).collect()} == {(i, 0) for i in range(4)}


def test_forced_pairs_are_those_of_every_matching():
    pick = random.Random(3)
    seen = 0
    for _ in range(200):
        n = pick.randint(1, 5)
        left, right = list("abcde"[:n]), list(range(n))
        links = {(x, y) for x in left for y in right if pick.random() < 0.5} | {(x, i) for i, x in enumerate(left) if pick.random() < 0.8}
        near = {x: [y for y in right if (x, y) in links] for x in left}
        whole = [set(zip(left, p)) for p in permutations(right) if set(zip(left, p)) <= links]
        full = evidence._full_matching(left, near)
        assert (full is None) == (not whole)
        if whole:
            assert set(evidence._unexchanged(full, links)) == set.intersection(*whole)
            seen += 1
    assert seen > 50


def test_only_components_of_equal_sides_are_matched(spark):
    named = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (5, 3), (6, 3), *[(i, 100) for i in range(100, 166)]], "id long, component long")
    assert sorted(r.id for r in evidence.matchable(named, F.col("id") % 2 == 1).collect()) == [1, 2]


def same_as_sql(spark, folder, name: str) -> int:
    """Rows of a query that equals its SQL over the tables of a folder."""
    from collections import Counter

    import duckdb

    from ledgerloom.plans.registry import ORACLE_SQL, QUERIES

    connection = duckdb.connect()
    for path in folder.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    found = QUERIES[name](spark, str(folder))
    result = connection.execute(ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    expected = result.fetchall()
    text = lambda v: str(float(v)) if isinstance(v, (int, float)) or hasattr(v, "as_tuple") else str(v)
    assert Counter(tuple(map(text, r)) for r in found.select(*columns).collect()) == Counter(tuple(map(text, r)) for r in expected)
    return len(expected)


def tables(folder, orders: str, lineitem: str = "SELECT * FROM l LIMIT 0"):
    import duckdb

    connection = duckdb.connect()
    for table, name, made in (("orders", "o", orders), ("lineitem", "l", lineitem)):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{table}.parquet'")
        connection.execute(f"COPY ({made}) TO '{folder}/{table}.parquet'")
    return folder


def test_sums_of_a_pool_of_more_than_twelve_orders_equal_sql(spark, tmp_path):
    made = tables(tmp_path, "SELECT o.* REPLACE (i AS o_orderkey, 3 AS o_custkey, '1995-01-01'::TIMESTAMP AS o_orderdate, i * 7919 % 90000 + 20000.0 AS o_totalprice) FROM range(30) r(i), (SELECT * FROM o LIMIT 1) o")
    assert same_as_sql(spark, made, "combined_payment_2") > 0 and same_as_sql(spark, made, "combined_payment_3") > 0


def test_views_of_rows_that_share_a_number_are_judged_as_one_in_sql_too(spark, tmp_path):
    made = tables(tmp_path, "SELECT * FROM o", "SELECT l.* REPLACE (k AS l_orderkey, p AS l_partkey, 1 AS l_suppkey, 1 AS l_linenumber) FROM (VALUES (1, 10001), (2, 1)) v(k, p), (SELECT * FROM l LIMIT 1) l")
    assert same_as_sql(spark, made, "ocr_consensus") == 1


def test_dates_at_one_height_keep_their_rows_and_order(spark, tmp_path):
    lines = "SELECT l.* REPLACE (1 AS l_orderkey, p AS l_partkey, s AS l_suppkey, n AS l_linenumber, d::TIMESTAMP AS l_shipdate) FROM (VALUES (10, 6, 1, '2001-01-01'), (10, 2, 1, '2001-01-02'), (10, 4, 1, '2001-01-03'), (12, 1, 2, '2001-01-04')) v(p, s, n, d), (SELECT * FROM l LIMIT 1) l"
    assert same_as_sql(spark, tables(tmp_path, "SELECT o.* REPLACE (1 AS o_orderkey) FROM o LIMIT 1", lines), "page_table") == 4


def test_competition_counts_the_candidates(spark):
    from ledgerloom.lineage import cut
    from ledgerloom.operators import pairing
    from ledgerloom.plans.adapters import adapter

    rows = adapter(spark, "/root/testdata/sf0.001", "ledger").where("id < 500").withColumn("transaction_at", F.concat(F.lit("1996-01-0"), (F.floor(F.col("id") / 4) % 3 + 1).cast("string")))
    minute = F.col("id") % 3 == 0
    at = F.when(minute, F.concat("transaction_at", F.lit(" 23:"), F.lpad((F.col("id") % 60).cast("string"), 2, "0"), F.lit(":00"))).otherwise(F.col("transaction_at"))
    rows = rows.withColumns({"transaction_at": at, "transaction_at_precision": F.when(minute, "minute").otherwise("day"), "amount": F.lit("5"), "memo": F.when(F.col("id") % 10 == 1, F.concat(F.lit("ref order"), F.lpad((F.col("id") + 3).cast("string"), 8, "0"))).otherwise(F.col("memo"))})
    bank, platform = map(cut, pairing.sides(rows))
    found = pairing.single_candidates(bank, platform).collect()
    # Each pair of the sides that fits, as pairs dealt out one by one have it.
    pairs = bank.selectExpr("id AS bank_id").crossJoin(platform.selectExpr("id AS order_id")).join(pairing.reference_pairs(bank, platform).withColumn("r", F.lit(True)), ["bank_id", "order_id"], "left").withColumn("by_reference", F.coalesce("r", F.lit(False))).drop("r")
    brute = pairing.fitting_pairs(pairs, bank, platform).where("b_money = p_money").collect()
    assert sorted((r.bank_id, r.order_id, r.by_reference) for r in found) == sorted((r.bank_id, r.order_id, r.by_reference) for r in brute)
    n = {}
    for r in found:
        for end in (r.bank_id, r.order_id):
            n[end] = n.get(end, 0) + 1
    counts = cut(pairing.competition(bank, platform))
    assert {r.endpoint: r.n for r in counts.collect()} == n and max(n.values()) > 1
    lone = sorted((r.bank_id, r.order_id) for r in found if n[r.bank_id] == n[r.order_id] == 1)
    assert lone and sorted((r.bank_id, r.order_id) for r in pairing.lone_candidates(bank, platform, counts).collect()) == lone


def test_transactions_do_not_wait_for_all_proposals(spark, monkeypatch):
    from ledgerloom.operators import analysis
    from ledgerloom.plans.adapters import adapter

    asked, pools = [], analysis.payment_pools
    monkeypatch.setattr(analysis, "payment_pools", lambda bank, platform, among=None: asked.append(among is None) or pools(bank, platform, among))
    made = analysis.build_analysis(adapter(spark, "/root/testdata/sf0.001", "ledger").drop("id"))
    assert made.transactions.count() > 0 and made.totals.count() == 1 and not any(asked)


def test_private_values_that_begin_alike(spark):
    from ledgerloom.functions import privacy

    rows = spark.createDataFrame([(1, "ref order0001, order0002"), (2, "ref order0001, order0002"), (3, "order0003 and ab"), (4, ""), (5, None), (6, "order000")], "id long, t string")
    values = spark.createDataFrame([("order0001",), ("order0002",), ("order0003",), ("order0004",), ("order00",), ("b",), ("",)], "value string")
    found = sorted((r.id, r.value) for r in privacy.literals_in(rows, "id", "t", values).collect())
    assert found == sorted((r.id, v.value) for r in rows.collect() for v in values.collect() if v.value and v.value in (r.t or ""))
    plan = privacy.literals_in(rows, "id", "t", values)._jdf.queryExecution().optimizedPlan().toString()
    assert "_g" not in plan  # no join on how values begin
    masked = {r.id: r.t for r in privacy.mask_literals(rows, "id", "t", values, b"k").collect()}
    assert masked[1] == masked[2] and "order0001" not in masked[1] and masked[4] == "" and masked[5] is None


def test_page_issues_deal_rows_out_once(spark):
    from ledgerloom.lineage import cut
    from ledgerloom.operators.observations import merge_observations
    from ledgerloom.plans.adapters import adapter

    seen = cut(adapter(spark, "/root/testdata/sf0.001", "page_views"))
    _, issues = merge_observations(seen, seen.select("page_id", "view", F.lit("X").alias("code")).limit(0))
    assert issues._jdf.queryExecution().sparkPlan().toString().count("Join") == 0 and issues.count() > 0
