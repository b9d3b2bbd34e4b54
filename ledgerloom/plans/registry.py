"""Registered queries of the reconciliation engine: name, Spark job, and DuckDB SQL where it can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import privacy
from ..functions.dates import date_struct
from ..functions.money import with_money
from ..lineage import cut
from ..operators import analysis, browse, commands, duplicates, evidence, facts, ingest, normalize, observations, ocr_records, ocr, page_tables, pairing, refunds, review, totals
from ..operators.predicates import eligible, flow_direction, within_window
from ..streaming import ledger as streaming
from .adapters import adapter, adapter_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql is not None:
            ORACLE_SQL[query.__name__] = sql
        return query

    return add


def q(name: str) -> str:
    return adapter_sql(name)


# --- overview and totals -------------------------------------------------------------------------


@register(f"""
SELECT coalesce(source, '未知来源') AS source, coalesce(currency, '未知币种') AS currency, count(*) AS n_records,
  coalesce(sum(CASE WHEN direction = 'in' THEN money END), 0)::DECIMAL(38,2) AS sum_in,
  coalesce(sum(CASE WHEN direction = 'out' THEN money END), 0)::DECIMAL(38,2) AS sum_out,
  coalesce(sum(CASE WHEN direction = 'none' THEN money END), 0)::DECIMAL(38,2) AS sum_none,
  count(*) FILTER (transaction_status = 'posted') AS n_posted, count(*) FILTER (transaction_status = 'pending') AS n_pending,
  count(*) FILTER (transaction_status = 'void') AS n_void, count(*) FILTER (transaction_status = 'unknown') AS n_unknown
FROM {q("event_records")} GROUP BY 1, 2""")
def overview_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.overview(adapter(spark, sf_dir, "event_records"))


@register(f"SELECT min(transaction_at) AS first_day, max(transaction_at) AS last_day FROM {q('event_records')}")
def date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.date_range(adapter(spark, sf_dir, "event_records"))


@register(f"""
SELECT coalesce(currency, 'CNY') AS currency, coalesce(sum(CASE WHEN direction = 'in' THEN money END), 0)::DECIMAL(38,2) AS total_in,
  coalesce(sum(CASE WHEN direction = 'out' THEN money END), 0)::DECIMAL(38,2) AS total_out,
  coalesce(sum(CASE WHEN direction = 'in' AND source = 'click' THEN money END), 0)::DECIMAL(38,2) AS total_refund
FROM {q("event_records")} WHERE transaction_status NOT IN ('void', 'pending') AND direction IN ('in', 'out') GROUP BY 1""")
def totals_by_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapter(spark, sf_dir, "event_records").withColumn("currency", F.coalesce("currency", F.lit("CNY")))
    included = ~F.col("transaction_status").isin("void", "pending") & F.col("direction").isin("in", "out")
    return totals.totals_by_currency(rows.withColumns({"included": included, "refund": (F.col("direction") == "in") & (F.col("source") == "click")}))


@register(f"""
SELECT source, field, count(*) FILTER (value IS NOT NULL AND value <> '') AS n_filled, count(*) AS n FROM (
  SELECT source, unnest(['memo', 'payment_method', 'account', 'counterparty']) AS field, unnest([memo, payment_method, account, counterparty]) AS value FROM {q("ledger")}
) GROUP BY 1, 2""")
def field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.field_coverage(adapter(spark, sf_dir, "ledger"), ["memo", "payment_method", "account", "counterparty"], "source")


@register(f"""
SELECT batch_id, count(*) AS n, count(*) FILTER (transaction_status = 'pending') AS n_pending, count(*) FILTER (memo IS NULL) AS n_without_memo
FROM {q("ledger")} GROUP BY 1""")
def import_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.group_counts(adapter(spark, sf_dir, "ledger"), ["batch_id"], {"n_pending": F.col("transaction_status") == "pending", "n_without_memo": F.col("memo").isNull()})


# --- pairing -------------------------------------------------------------------------------------

_SIDES = f"""
WITH ledger AS {q("ledger")}, ok AS (
  SELECT *, amount::DECIMAL(38,2) AS money, regexp_extract_all(concat_ws(' ', coalesce(memo, ''), coalesce(description, '')), '[A-Za-z0-9_-]{{6,}}') AS tokens
  FROM ledger WHERE transaction_status NOT IN ('void', 'pending') AND direction IN ('in', 'out')
), b AS (SELECT * FROM ok WHERE source = '建设银行'), p AS (SELECT * FROM ok WHERE source = '微信'
), cand AS (
  SELECT b.id AS bank_id, p.id AS order_id, b.currency, b.direction AS flow, b.money AS amount,
    list_contains(b.tokens, p.source_record_id) AS by_reference,
    coalesce(replace(b.memo, '财付通-微信支付-', '') = p.counterparty, false) AS merchant,
    (p.payment_method LIKE '建设银行%' AND b.transaction_at = p.transaction_at AND b.account LIKE '%1234') AS channel,
    (concat_ws(' ', b.counterparty, b.memo) SIMILAR TO '.*(财付通|微信).*') AS processor, b.direction = 'out' AS outgoing
  FROM b JOIN p ON b.currency = p.currency AND b.direction = p.direction AND b.money = p.money
  WHERE NOT (p.payment_method LIKE '%(1234)' AND b.account NOT LIKE '%1234')
), found AS (
  SELECT bank_id, order_id, currency, flow, amount, by_reference, merchant, coalesce(channel, false) AND processor AND outgoing AS unique_channel
  FROM cand WHERE by_reference OR coalesce(channel, false)
), proposals AS (SELECT *, by_reference OR merchant OR unique_channel AS automatic FROM found
), ends AS (SELECT bank_id, order_id, bank_id AS endpoint FROM proposals UNION ALL SELECT bank_id, order_id, order_id FROM proposals
), counts AS (SELECT endpoint, count(*) AS n FROM ends GROUP BY 1
), judged AS (
  SELECT p.*, greatest(x.n, y.n) AS most, p.automatic AND greatest(x.n, y.n) = 1 AS adopted
  FROM proposals p JOIN counts x ON x.endpoint = p.bank_id JOIN counts y ON y.endpoint = p.order_id
)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    bank, platform = pairing.sides(adapter(spark, sf_dir, "ledger"))
    return cut(bank), cut(platform)


@register(_SIDES + " SELECT bank_id, order_id, amount::DECIMAL(18,2) AS amount, by_reference, merchant, unique_channel, automatic FROM proposals")
def pair_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.single_candidates(*_sides(spark, sf_dir)).select("bank_id", "order_id", F.col("amount").cast("decimal(18,2)").alias("amount"), "by_reference", "merchant", "unique_channel", "automatic")


@register(_SIDES + " SELECT endpoint, n FROM counts")
def pair_competition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.competition(*_sides(spark, sf_dir))


@register(_SIDES + """ SELECT bank_id, order_id, CASE WHEN adopted THEN 'automatic' WHEN bank_id IN (SELECT bank_id FROM judged WHERE adopted) OR order_id IN (SELECT order_id FROM judged WHERE adopted) THEN 'conflict' ELSE 'suggested' END AS status,
  (most - 1)::BIGINT AS competing FROM judged""")
def pair_adopted(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank, platform = _sides(spark, sf_dir)
    counts = cut(pairing.competition(bank, platform).withColumnRenamed("endpoint", "id"))
    found = pairing.single_candidates(cut(bank.join(counts, "id")), cut(platform.join(counts, "id")), keep=("n",))
    # An adopted pair is the only one of both of its ends, so no other shares an end with it: there are no conflicts.
    most = F.greatest("b_n", "p_n")
    return found.select("bank_id", "order_id", F.when(F.col("automatic") & (most == 1), "automatic").otherwise("suggested").alias("status"), (most - 1).alias("competing"))


@register(_SIDES + """ SELECT currency, coalesce(sum(CASE WHEN direction = 'in' THEN money END), 0)::DECIMAL(38,2) AS total_in, coalesce(sum(CASE WHEN direction = 'out' THEN money END), 0)::DECIMAL(38,2) AS total_out,
  0::DECIMAL(38,2) AS total_refund FROM ok WHERE id NOT IN (SELECT bank_id FROM judged WHERE adopted) GROUP BY 1""")
def dedup_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals once each adopted bank row has gone into its order's transaction, over all eligible rows."""
    rows = adapter(spark, sf_dir, "ledger").where(eligible()).withColumns({"direction": flow_direction(), "money": F.col("amount").try_cast("decimal(38,18)")})
    bank, platform = _sides(spark, sf_dir)
    adopted = pairing.lone_candidates(bank, platform, cut(pairing.competition(bank, platform))).where("automatic").select(F.col("bank_id").alias("id"))
    left = rows.join(adopted, "id", "left_anti")
    return totals.totals_by_currency(left.withColumns({"included": F.lit(True), "refund": F.lit(False)}))


_ANALYSIS = _SIDES + """, pool AS (
  SELECT b.id AS bank_id, b.money AS bank_money, p.id AS order_id, p.money AS order_money FROM b JOIN p ON b.currency = p.currency AND b.direction = p.direction
  WHERE b.direction = 'out' AND NOT coalesce(p.payment_method LIKE '%(1234)' AND b.account NOT LIKE '%1234', false) AND p.money < b.money
    AND (list_contains(b.tokens, p.source_record_id) OR coalesce(p.payment_method LIKE '建设银行%' AND b.transaction_at = p.transaction_at AND NOT (p.payment_method LIKE '%(1234)' AND b.account NOT LIKE '%1234'), false))
), sums AS (
  SELECT x.bank_id, x.bank_money, [x.order_id, y.order_id] AS orders FROM pool x JOIN pool y ON x.bank_id = y.bank_id AND x.order_id < y.order_id WHERE x.order_money + y.order_money = x.bank_money
  UNION ALL SELECT x.bank_id, x.bank_money, [x.order_id, y.order_id, z.order_id] FROM pool x JOIN pool y ON x.bank_id = y.bank_id AND x.order_id < y.order_id JOIN pool z ON z.bank_id = y.bank_id AND y.order_id < z.order_id WHERE x.order_money + y.order_money + z.order_money = x.bank_money
  UNION ALL SELECT x.bank_id, x.bank_money, [x.order_id, y.order_id, z.order_id, w.order_id] FROM pool x JOIN pool y ON x.bank_id = y.bank_id AND x.order_id < y.order_id JOIN pool z ON z.bank_id = y.bank_id AND y.order_id < z.order_id JOIN pool w ON w.bank_id = z.bank_id AND z.order_id < w.order_id
    WHERE x.order_money + y.order_money + z.order_money + w.order_money = x.bank_money
), gone AS (SELECT bank_id AS id FROM judged WHERE adopted UNION SELECT order_id FROM judged WHERE adopted)
"""


def _analysis(spark: SparkSession, sf_dir: str) -> analysis.Analysis:
    return analysis.build_analysis(adapter(spark, sf_dir, "ledger").drop("id"))


@register(_ANALYSIS + """ SELECT bank_id::VARCHAR AS left_id, order_id::VARCHAR AS right_ids, amount::DECIMAL(18,2) AS amount, automatic, CASE WHEN adopted THEN 'automatic' WHEN bank_id IN (SELECT id FROM gone) OR order_id IN (SELECT id FROM gone) THEN 'conflict' ELSE 'suggested' END AS decision FROM judged
UNION ALL SELECT bank_id::VARCHAR, array_to_string(orders, ','), bank_money::DECIMAL(18,2), false, CASE WHEN bank_id IN (SELECT id FROM gone) OR list_bool_or(list_transform(orders, lambda o: o IN (SELECT id FROM gone))) THEN 'conflict' ELSE 'suggested' END FROM sums""".replace("list_bool_or(list_transform(orders, lambda o: o IN (SELECT id FROM gone)))", "len(list_intersect(orders, (SELECT list(id) FROM gone))) > 0"))
def analysis_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every proposed payment, single or summed, with what became of it; ids as the orders' numbers."""
    number = lambda c: F.regexp_replace(c, "^r0*", "")
    found = _analysis(spark, sf_dir).relations
    return found.select(number(F.col("left_id")).alias("left_id"), F.array_join(F.transform("right_ids", number), ",").alias("right_ids"), F.col("amount").cast("decimal(18,2)").alias("amount"), "automatic", "decision")


@register(_ANALYSIS + """, one AS (
  SELECT [book_record_id] AS ids, id FROM ledger WHERE id NOT IN (SELECT id FROM gone)
  UNION ALL SELECT list_sort([x.book_record_id, y.book_record_id]), y.id FROM judged JOIN ledger x ON x.id = bank_id JOIN ledger y ON y.id = order_id WHERE adopted
) SELECT array_to_string(ids, ',') AS sources, l.amount::DECIMAL(18,2) AS amount, l.direction, l.transaction_status NOT IN ('void', 'pending') AND l.direction IN ('in', 'out') AS included FROM one JOIN ledger l USING (id)""")
def analysis_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _analysis(spark, sf_dir).transactions
    return found.select(F.array_join("source_ids", ",").alias("sources"), F.col("money").cast("decimal(18,2)").alias("amount"), "direction", "included")


@register(_SIDES + """ SELECT currency, coalesce(sum(CASE WHEN direction = 'in' THEN money END), 0)::DECIMAL(38,2) AS total_in, coalesce(sum(CASE WHEN direction = 'out' THEN money END), 0)::DECIMAL(38,2) AS total_out,
  0::DECIMAL(38,2) AS total_refund FROM ok WHERE id NOT IN (SELECT bank_id FROM judged WHERE adopted) GROUP BY 1""")
def analysis_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir).totals


@register(_SIDES + ", hits AS (SELECT id, unnest(tokens) AS token FROM b) SELECT DISTINCT hits.id AS bank_id, p.id AS order_id FROM hits JOIN p ON hits.token = p.source_record_id")
def reference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank, platform = pairing.sides(adapter(spark, sf_dir, "ledger"))
    return pairing.reference_pairs(bank, platform)


@register("""
SELECT a.event_id AS bank_id, b.event_id AS order_id FROM events a JOIN events b ON a.user_id = b.user_id AND abs(date_diff('microsecond', a.ts, b.ts)) <= 300000000
WHERE a.event_type = 'click' AND b.event_type = 'purchase'""")
def window_300s(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), "user_id", F.col("ts").alias("at"), F.lit("second").alias("precision"), "event_type")
    return pairing.day_pairs(events.where("event_type = 'click'"), events.where("event_type = 'purchase'"), ["user_id"])


_POOL = f"pool AS (SELECT b.bank_id, b.bank_amount, o.order_id, o.order_amount, o.order_source, o.referred FROM {q('bank_sums')} b JOIN {q('order_pool')} o ON b.day = o.day AND b.channel = o.channel)"
_SMALL = f"WITH {_POOL}, n AS (SELECT bank_id, count(*) AS n FROM pool GROUP BY 1), s AS (SELECT pool.* FROM pool JOIN n USING (bank_id) WHERE n <= 12 AND order_amount < bank_amount) "


#: Every pool, as large as it is.
_FITTING = f"WITH {_POOL}, s AS (SELECT * FROM pool WHERE order_amount < bank_amount) "


def _combined_sql(size: int, pools: str) -> str:
    names = [f"a{i}" for i in range(1, size + 1)]
    on = " ".join(f"JOIN s {b} ON {b}.bank_id = {a}.bank_id AND {b}.order_source = {a}.order_source AND {a}.order_id < {b}.order_id" for a, b in zip(names, names[1:]))
    ids = ", ".join(f"{a}.order_id AS o{i}" for i, a in enumerate(names, 1))
    return f"{pools} SELECT a1.bank_id, {ids}, a1.bank_amount, {' AND '.join(a + '.referred' for a in names)} AS automatic FROM s a1 {on} WHERE {' + '.join(a + '.order_amount' for a in names)} = a1.bank_amount"


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter(spark, sf_dir, "bank_sums").join(adapter(spark, sf_dir, "order_pool"), ["day", "channel"]).drop("day", "channel")


@register(_combined_sql(2, _FITTING))
def combined_payment_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.combined_candidates(_pool(spark, sf_dir), 2)


@register(_combined_sql(3, _FITTING))
def combined_payment_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.combined_candidates(_pool(spark, sf_dir), 3)


@register(_combined_sql(4, _SMALL))
def combined_payment_4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.combined_candidates(_pool(spark, sf_dir), 4)


@register(f"WITH {_POOL} SELECT bank_id, count(*) AS n_orders FROM pool GROUP BY 1 HAVING count(*) > 3")
def pool_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.truncated_pools(_pool(spark, sf_dir), 3)


# --- duplicates and merge ------------------------------------------------------------------------


@register(f"""
WITH f AS (SELECT text_key, source, count(*) AS n, min(id) AS first FROM {q("document_exports")} GROUP BY 1, 2)
SELECT text_key, sum(n)::BIGINT AS n_rows, count(*) AS n_files, min(first) AS first_id, count(*) >= 2 AND max(n) = 1 AS accepted FROM f GROUP BY 1 HAVING sum(n) >= 2""")
def duplicate_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.duplicate_groups(adapter(spark, sf_dir, "document_exports"), ["text_key"], ["source"], "id")


_MEMBERS = f"members AS (SELECT *, CAST(id % 3000 AS STRING) AS transaction_id FROM {q('ledger')})"
_ALTERNATIVES = f"""
WITH {_MEMBERS}, long AS (
  SELECT transaction_id, book_record_id, source, unnest(['counterparty', 'description', 'payment_method', 'transaction_at']) AS field, unnest([counterparty, description, payment_method, transaction_at]) AS value FROM members
), v AS (
  SELECT transaction_id, field, value, count(*) AS n_sources, min(book_record_id) AS first, arg_min(source, book_record_id) = '微信' AS p
  FROM long WHERE value IS NOT NULL AND value NOT IN ('', '/', '-') GROUP BY 1, 2, 3
), r AS (
  SELECT *, row_number() OVER (PARTITION BY transaction_id, field ORDER BY (value NOT IN ('消费', '财付通'))::INT DESC, (field IN ('counterparty', 'description', 'transaction_at') AND p)::INT DESC, first DESC)::INT AS rank FROM v
)"""


def _alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = adapter(spark, sf_dir, "ledger").withColumn("transaction_id", (F.col("id") % 3000).cast("string"))
    return duplicates.field_alternatives(members, ("counterparty", "description", "payment_method", "transaction_at"))


@register(_ALTERNATIVES + " SELECT transaction_id, field, value, n_sources, rank FROM r")
def field_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alternatives(spark, sf_dir).select("transaction_id", "field", "value", F.size("sources").cast("long").alias("n_sources"), "rank")


@register(_ALTERNATIVES + " SELECT transaction_id, field, max(CASE WHEN rank = 1 THEN value END) AS selected, max(CASE WHEN rank = 1 THEN n_sources END) AS n_sources, count(*) > 1 AS multiple_values FROM r GROUP BY 1, 2")
def field_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = duplicates.field_union(_alternatives(spark, sf_dir)).select("transaction_id", F.explode("fields").alias("field", "entry"))
    return merged.select("transaction_id", "field", "entry.selected", F.size("entry.selected_sources").cast("long").alias("n_sources"), "entry.multiple_values")


# --- refunds -------------------------------------------------------------------------------------

_REFUNDS = f"""
WITH RECURSIVE c AS {q("refund_lines")}, e AS {q("refund_orders")}, cand AS (
  SELECT c.id AS credit_id, e.id AS expense_id, c.money AS amount, e.money AS room FROM c JOIN e ON c.source_record_id = e.source_record_id AND c.source = e.source
  WHERE c.money <= e.money AND c.at >= e.at
)"""


def _refunds(spark: SparkSession, sf_dir: str) -> DataFrame:
    credits, expenses = adapter(spark, sf_dir, "refund_lines"), adapter(spark, sf_dir, "refund_orders")
    return refunds.refund_candidates(credits, expenses, refunds.shared_identifiers(credits, "id"), refunds.shared_identifiers(expenses, "id"))


@register(_REFUNDS + " SELECT * FROM cand")
def refund_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refunds(spark, sf_dir)


@register(_REFUNDS + " SELECT credit_id, expense_id, count(*) OVER (PARTITION BY credit_id) = 1 AND sum(amount) OVER (PARTITION BY expense_id) <= room AS linked FROM cand")
def refund_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refunds.link_refunds(_refunds(spark, sf_dir)).select("credit_id", "expense_id", "linked")


@register(_REFUNDS + " SELECT expense_id, sum(amount)::DECIMAL(28,2) AS claimed, any_value(room) AS room, sum(amount) > any_value(room) AS over_capacity FROM cand GROUP BY 1")
def refund_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    claimed = _refunds(spark, sf_dir).groupBy("expense_id").agg(F.sum("amount").cast("decimal(28,2)").alias("claimed"), F.first("room").alias("room"))
    return claimed.withColumn("over_capacity", F.col("claimed") > F.col("room"))


@register(_REFUNDS + """, single AS (SELECT credit_id, expense_id, min(amount) AS amount, min(room) AS room FROM cand GROUP BY 1, 2
), both_ends AS (
  SELECT * FROM single UNION ALL SELECT s.credit_id, e.id, s.amount, e.money FROM single s JOIN e ON e.id = xor(s.expense_id, 1) WHERE s.credit_id % 3 = 0 AND s.amount <= e.money
), ruled AS (
  SELECT *, printf('%012d-%012d', credit_id, expense_id) AS id, (credit_id + expense_id) % 5 < 3 AS accepted, (credit_id + expense_id) % 5 = 3 AS unruled, expense_id // 2 AS book,
    count(*) OVER (PARTITION BY credit_id) AS n_expenses, sum(amount) OVER (PARTITION BY expense_id) AS total
  FROM both_ends
), steps AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY id) AS k FROM ruled
), walk AS (  -- one candidate of each book after the other, with the links so far
  SELECT book, 0::BIGINT AS k, NULL::VARCHAR AS id, false AS linked, []::STRUCT(c BIGINT, e BIGINT, a DECIMAL(18,2))[] AS links FROM steps GROUP BY book
  UNION ALL
  SELECT book, k, id, ok, CASE WHEN ok THEN list_append(links, {'c': credit_id, 'e': expense_id, 'a': amount}) ELSE links END FROM (
    SELECT s.*, w.links, len(list_filter(w.links, lambda x: x.c = s.credit_id)) = 0
      AND coalesce(list_sum(list_transform(list_filter(w.links, lambda x: x.e = s.expense_id), lambda x: x.a)), 0) + s.amount <= s.room
      AND (s.accepted OR (s.unruled AND s.n_expenses = 1 AND s.total <= s.room)) AS ok
    FROM walk w JOIN steps s ON s.book = w.book AND s.k = w.k + 1))
SELECT s.id, s.credit_id, s.expense_id, s.accepted, w.linked FROM steps s JOIN walk w ON w.book = s.book AND w.k = s.k""")
def refund_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links under a person's rulings: refunds with rival purchases, purchases with rival refunds."""
    near = _refunds(spark, sf_dir).groupBy("credit_id", "expense_id").agg(F.min("amount").alias("amount"), F.min("room").alias("room"))
    orders = adapter(spark, sf_dir, "refund_orders").select(F.col("id").alias("expense_id"), F.col("money").alias("room"))
    # A purchase's number with its last bit turned names its rival.
    rival = near.where("credit_id % 3 = 0").select("credit_id", F.col("expense_id").bitwiseXOR(F.lit(1)).alias("expense_id"), "amount").join(orders, "expense_id").where("amount <= room")
    rows = near.unionByName(rival.select(*near.columns))
    mix = F.pmod(F.col("credit_id") + F.col("expense_id"), F.lit(5))
    rows = rows.withColumns({"id": F.format_string("%012d-%012d", "credit_id", "expense_id"), "accepted": mix < 3, "unruled": mix == 3})
    return refunds.allocate_accepted(rows).select("id", "credit_id", "expense_id", "accepted", "linked")


# --- canonicalisation ----------------------------------------------------------------------------

_MONEY_SQL = r"""CASE WHEN {c} IN ('', '-', '--', '/') THEN NULL
  WHEN regexp_full_match({c}, '(USD )?[0-9]+(\.[0-9]+)?') THEN CAST(replace({c}, 'USD ', '') AS DECIMAL(38,2))
  WHEN regexp_full_match({c}, '\+[0-9]+(\.[0-9]+)?') THEN CAST(substring({c}, 2) AS DECIMAL(38,2))
  WHEN regexp_full_match({c}, '-[0-9]+(\.[0-9]+)?') THEN CAST({c} AS DECIMAL(38,2))
  WHEN regexp_full_match({c}, '[0-9]+(\.[0-9]+)?-') THEN -CAST(rtrim({c}, '-') AS DECIMAL(38,2))
  WHEN regexp_full_match({c}, '￥[0-9]+(\.[0-9]+)?') THEN CAST(substring({c}, 2) AS DECIMAL(38,2))
  WHEN regexp_full_match({c}, '（￥[0-9]+(\.[0-9]+)?）') THEN -CAST(trim({c}, '（￥）') AS DECIMAL(38,2))
  WHEN regexp_full_match({c}, '\([0-9]+(\.[0-9]+)?\)') THEN -CAST(trim({c}, '()') AS DECIMAL(38,2))
  WHEN regexp_full_match({c}, '[0-9]{{1,3}}(,[0-9]{{3}})+(\.[0-9]+)?') THEN CAST(replace({c}, ',', '') AS DECIMAL(38,2)) END"""
_SIGN_SQL = "CASE WHEN {c} LIKE '-%' OR {c} LIKE '%-' OR {c} LIKE '(%' OR {c} LIKE '（%' THEN '-' WHEN {c} LIKE '+%' THEN '+' END"


@register(f"""
WITH m AS (SELECT record_id, cell_amount, {_MONEY_SQL.format(c="cell_amount")} AS amount FROM {q("cells")})
SELECT record_id, amount, CASE WHEN amount IS NOT NULL THEN {_SIGN_SQL.format(c="cell_amount")} END AS sign, CASE WHEN amount IS NOT NULL AND cell_amount LIKE 'USD%' THEN 'USD' END AS currency FROM m""")
def parse_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = with_money(adapter(spark, sf_dir, "cells"), {"m": "cell_amount"})
    return parsed.select("record_id", F.col("m.amount").cast("decimal(38,2)").alias("amount"), "m.sign", "m.currency")


_DATE_SQL = "CASE record_id % 5 WHEN 3 THEN NULL WHEN 1 THEN concat(substring(cell_date, 1, 4), '-', substring(cell_date, 5, 2), '-', substring(cell_date, 7, 2)) WHEN 2 THEN replace(cell_date, '/', '-') WHEN 4 THEN concat(cell_date, ':00') ELSE cell_date END"


@register(f"SELECT record_id, {_DATE_SQL} AS at, CASE record_id % 5 WHEN 3 THEN NULL WHEN 2 THEN 'second' WHEN 4 THEN 'minute' ELSE 'day' END AS precision FROM {q('cells')}")
def parse_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter(spark, sf_dir, "cells").withColumn("d", date_struct(F.col("cell_date"))).select("record_id", "d.at", "d.precision")


@register(f"SELECT record_id, CASE cell_status WHEN '支付成功' THEN 'posted' WHEN '处理中' THEN 'pending' ELSE 'unknown' END AS status FROM {q('cells')}")
def status_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter(spark, sf_dir, "cells").select("record_id", normalize.status_of(F.col("cell_status")).alias("status"))


_AMOUNT_SQL = f"""
c AS (SELECT *, {_MONEY_SQL.format(c="cell_amount")} AS m, {_SIGN_SQL.format(c="cell_amount")} AS sg, cell_credit::DECIMAL(38,2) AS cr, cell_debit::DECIMAL(38,2) AS db FROM {q("cells")}),
d AS (SELECT *, CASE WHEN m IS NOT NULL AND (signed_format OR m < 0 OR sg IS NOT NULL) THEN CASE WHEN m < 0 THEN 'out' WHEN m > 0 THEN 'in' ELSE 'none' END END AS by_plain,
  split AND coalesce(cr, 0) <> 0 AND coalesce(db, 0) <> 0 AS two_sided FROM c),
e AS (SELECT *, split AND NOT two_sided AND (cr IS NOT NULL OR db IS NOT NULL) AS split_used, CASE WHEN coalesce(cr, 0) <> 0 THEN cr WHEN coalesce(db, 0) <> 0 THEN db ELSE 0 END AS sa,
  CASE WHEN coalesce(cr, 0) <> 0 THEN 'in' WHEN coalesce(db, 0) <> 0 THEN 'out' ELSE 'none' END AS sd,
  CASE cell_direction WHEN '支出' THEN 'out' WHEN '收入' THEN 'in' WHEN '/' THEN 'none' END AS stated FROM d),
f AS (SELECT *, CASE WHEN two_sided THEN NULL WHEN split_used THEN sa ELSE m END AS amt FROM e),
g AS (SELECT *, CASE WHEN split_used THEN sd WHEN amt IS NOT NULL THEN by_plain END AS derived FROM f),
h AS (SELECT *, CASE WHEN amt IS NOT NULL THEN coalesce(stated, derived) ELSE stated END AS dir FROM g),
amounts AS (SELECT record_id, abs(amt)::DECIMAL(38,2) AS amount, dir AS direction, list_filter([
  CASE WHEN cell_amount NOT IN ('', '-', '--', '/') AND m IS NULL THEN 'AMOUNT_INVALID' END,
  CASE WHEN two_sided THEN 'BOTH_DIRECTIONS' END,
  CASE WHEN split_used AND abs(m) <> abs(sa) THEN 'AMOUNT_CONFLICT' END,
  CASE WHEN split_used AND by_plain <> sd THEN 'DIRECTION_CONFLICT' END,
  CASE WHEN coalesce(cell_direction, '') <> '' AND stated IS NULL THEN 'DIRECTION_UNKNOWN' END,
  CASE WHEN amt IS NOT NULL AND stated <> derived AND stated <> 'none' THEN 'DIRECTION_CONFLICT' END,
  CASE WHEN dir IS NULL THEN 'DIRECTION_MISSING' END, CASE WHEN amt IS NULL THEN 'AMOUNT_MISSING' END], lambda x: x IS NOT NULL) AS issues FROM h)"""


def _amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = with_money(adapter(spark, sf_dir, "cells").withColumn("direction_codes", F.lit(None).cast("map<string,string>")), normalize.MONEY_CELLS)
    return normalize.resolve_amounts(parsed).withColumn("a", F.col("_amount"))


@register(f"WITH {_AMOUNT_SQL} SELECT record_id, amount, direction, array_to_string(issues, ',') AS issues FROM amounts")
def resolve_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _amounts(spark, sf_dir).select("record_id", F.col("a.amount").cast("decimal(38,2)").alias("amount"), "a.direction", F.array_join("a.issues", ",").alias("issues"))


_CURRENCY_SQL = f"""
cu AS (SELECT record_id, CASE upper(cell_currency) WHEN '人民币' THEN 'CNY' WHEN 'USD' THEN 'USD' END AS stated, CASE WHEN cell_amount LIKE 'USD%' THEN 'USD' END AS mark FROM {q("cells")}),
currencies AS (SELECT record_id, CASE WHEN stated <> mark THEN stated ELSE coalesce(stated, mark, 'CNY') END AS currency, CASE WHEN stated <> mark THEN 'CURRENCY_CONFLICT' WHEN stated IS NULL AND mark IS NULL THEN 'CURRENCY_DEFAULTED' END AS issue FROM cu)"""


@register(f"WITH {_CURRENCY_SQL} SELECT * FROM currencies")
def resolve_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = with_money(adapter(spark, sf_dir, "cells"), normalize.MONEY_CELLS)
    codes = F.array(*[F.col(f"{n}.currency") for n in normalize.MONEY_CELLS])
    return parsed.withColumn("c", normalize.resolve_currency(F.col("cell_currency"), codes)).select("record_id", "c.currency", "c.issue")


@register(f"""
WITH {_AMOUNT_SQL}, {_CURRENCY_SQL}, all_issues AS (
  SELECT a.record_id, list_concat(CASE WHEN a.record_id % 5 = 3 THEN ['DATE_INVALID', 'DATE_MISSING'] ELSE []::VARCHAR[] END, a.issues,
    list_filter([x.issue, CASE WHEN s.cell_status NOT IN ('支付成功', '处理中') THEN 'STATUS_UNKNOWN' END], lambda i: i IS NOT NULL)) AS issues
  FROM amounts a JOIN currencies x USING (record_id) JOIN {q("cells")} s USING (record_id)
), long AS (SELECT unnest(issues) AS code FROM all_issues)
SELECT code, count(*) AS n FROM long GROUP BY 1""")
def normalize_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.normalize_rows(adapter(spark, sf_dir, "cells")).select(F.explode("issues").alias("code")).groupBy("code").agg(F.count("*").alias("n"))


# --- review --------------------------------------------------------------------------------------

_FOLD = f"""
WITH ev AS {q("decisions")}, undone AS (SELECT target, max(revision) AS undone_by FROM ev WHERE action = 'undo' GROUP BY 1),
j AS (SELECT ev.*, undone_by FROM ev LEFT JOIN undone ON ev.revision = undone.target WHERE action <> 'undo'),
s AS (SELECT relation_id, action, revision FROM j WHERE undone_by IS NULL UNION ALL SELECT relation_id, 'reject', undone_by FROM j WHERE undone_by IS NOT NULL AND action = 'accept')
SELECT relation_id, arg_max(action, revision) AS action, max(revision) AS revision FROM s GROUP BY 1"""


@register(_FOLD)
def decision_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.fold_decisions(adapter(spark, sf_dir, "decisions"))


_OVERLAY = f"""
base AS {q("base_records")}, o AS (SELECT doc_id AS k, quality FROM labels),
eff AS (SELECT base.* REPLACE (CASE WHEN quality = 1 THEN 'confirmed' WHEN quality = 0 THEN NULL ELSE counterparty END AS counterparty), k IS NOT NULL AS human_confirmed FROM base LEFT JOIN o ON record_id = k)"""


def _effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    overrides = labels.select(F.col("doc_id").alias("record_id"), F.array(F.lit("counterparty")).alias("changed"), F.when(F.col("quality") == 1, "confirmed").alias("counterparty"))
    return review.overlay(adapter(spark, sf_dir, "base_records"), overrides, "record_id", ["counterparty"])


@register(f"""
WITH {_OVERLAY}, ex AS (SELECT doc_id FROM labels WHERE toxic = 1), pages AS (SELECT DISTINCT source, doc_id % 5 AS page FROM documents WHERE n_chars < 20),
r AS (SELECT eff.*, p.page IS NOT NULL AS open, CASE WHEN record_id IN (SELECT doc_id FROM ex) THEN 'excluded' WHEN human_confirmed THEN 'confirmed' WHEN parse_status = 'ready' THEN 'ready' ELSE 'pending' END AS review_status
  FROM eff LEFT JOIN pages p ON p.source = eff.file_id AND p.page = eff.page)
SELECT record_id, counterparty, human_confirmed, review_status, open AS page_review_pending, review_status IN ('confirmed', 'ready') AND NOT open AS eligible FROM r""")
def effective_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    excluded = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").select(F.col("doc_id").alias("record_id"))
    pages = adapter(spark, sf_dir, "base_records").where("n_chars < 20")
    found = review.eligible_records(_effective(spark, sf_dir), excluded, pages)
    return found.select("record_id", "counterparty", "human_confirmed", "review_status", "page_review_pending", "eligible")


@register(f"""
WITH base AS {q("base_records")} SELECT record_id, file_id, page FROM base WHERE parse_status = 'needs_review'
  AND record_id NOT IN (SELECT doc_id FROM labels) AND (file_id, page) NOT IN (SELECT source, doc_id % 5 FROM documents WHERE n_chars < 20)""")
def blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = adapter(spark, sf_dir, "base_records")
    issues = base.where("parse_status = 'needs_review'").select("record_id", "file_id", "page", F.lit("error").alias("severity"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("record_id"), "quality")
    left = review.blockers(issues, labels.where("quality = 1"), labels.where("quality = 0"), base.where("n_chars < 20"))
    return left.select("record_id", "file_id", "page")


@register(f"WITH {_OVERLAY} SELECT e.record_id, 'counterparty' AS field, b.counterparty AS old, e.counterparty AS new FROM eff e JOIN base b USING (record_id) WHERE e.counterparty IS DISTINCT FROM b.counterparty")
def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.change_log(adapter(spark, sf_dir, "base_records"), _effective(spark, sf_dir), "record_id", ["counterparty", "description"])


#: Commands of made-up reviewers, one for each turn: k is its place in its workspace, p that of its payload (some
#: repeat the one before), and four after each other name the same revision.
_COMMAND_ROWS = """
SELECT CAST(CAST(floor(conv_id / 12) AS BIGINT) AS STRING) AS ws, row_number() OVER (PARTITION BY CAST(floor(conv_id / 12) AS BIGINT) ORDER BY conv_id, turn) - 1 AS k FROM {conversations}"""
_COMMANDS = """
SELECT ws, k, CASE WHEN k % 8 = 1 THEN k - 1 ELSE k END AS p, CASE WHEN k % 4 = 1 THEN k - 1 ELSE k END AS r, CAST(floor(k / 4) AS BIGINT) AS expected FROM {rows}"""
_PAYLOADS = """
SELECT ws, k, expected, concat('request-', CAST(r AS STRING)) AS request_id, CASE p % 9 WHEN 4 THEN 'exclude' WHEN 5 THEN 'exclude' WHEN 6 THEN 'undo' WHEN 8 THEN 'other' ELSE 'confirm' END AS action,
  CASE WHEN p % 5 = 3 THEN '' ELSE 'seen' END AS note, concat('r', CAST(p * 5 % 40 * 4 + CAST(ws AS BIGINT) * 121 AS STRING)) AS record_id,
  CASE WHEN p % 2 = 0 THEN expected ELSE expected - 1 END AS target, CASE p % 6 WHEN 0 THEN 'abc' WHEN 1 THEN NULL ELSE '5.00' END AS amount
FROM {commands}"""


def _review_batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Commands, records, page tasks and files of the workspaces."""
    rows = spark.sql(_COMMAND_ROWS.format(conversations="{c}"), c=spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    sent = spark.sql(_PAYLOADS.format(commands="{c}"), c=spark.sql(_COMMANDS.format(rows="{r}"), r=rows))
    made = {
        "workspace_id": F.col("ws"), "seq": F.col("k").cast("long"), "request_id": F.col("request_id"), "expected_revision": F.col("expected"), "action": F.col("action"), "note": F.col("note"),
        "record_id": F.col("record_id"), "target_revision": F.col("target").cast("long"), "fields": F.when(F.col("amount").isNotNull(), F.create_map(F.lit("amount"), F.col("amount"))),
    }
    names = dict(x.split(" ", 1) for x in commands.COMMAND.replace("map<string, string>", "map<string,string>").split(", "))
    asked = sent.select(*[made.get(n, F.lit(None)).cast(t).alias(n) for n, t in names.items()])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    open_ = F.col("doc_id") % 4 == 0
    records = docs.select(
        F.floor(F.col("doc_id") / 121).cast("string").alias("workspace_id"), F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("record_id"), F.col("source").alias("file_id"), (F.col("doc_id") % 5).alias("page"),
        F.when(open_, "needs_review").otherwise("ready").alias("parse_status"), F.lit("2026-01-02").alias("transaction_at"), F.lit(None).cast("string").alias("booking_at"), F.when(~open_, "1.00").alias("amount"),
        F.lit("out").alias("direction"), F.lit("CNY").alias("currency"), F.lit(None).cast("string").alias("balance"), F.lit("posted").alias("transaction_status"),
    )
    tasks = records.select("workspace_id", F.concat_ws(":", "file_id", "page").alias("review_id"), "file_id", "page").distinct()
    files = records.select("workspace_id", "file_id", F.lit(False).alias("needs_page"), F.lit(None).cast("int").alias("n_pages")).distinct()
    return asked, records, tasks, files


_REPLAY = f"""
WITH RECURSIVE rows_ AS ({_COMMAND_ROWS.format(conversations="conversations")}), commands_ AS ({_COMMANDS.format(rows="rows_")}), sent AS ({_PAYLOADS.format(commands="commands_").replace("STRING", "VARCHAR")}
), asked AS (
  SELECT s.*, d.doc_id IS NOT NULL AS known, d.doc_id % 4 = 0 AS open_, coalesce(s.amount, '') AS said,
    md5(concat_ws('|', s.request_id, s.expected, s.action, s.note, s.record_id, s.target, coalesce(s.amount, '-'))) AS payload
  FROM sent s LEFT JOIN documents d ON s.record_id = concat('r', d.doc_id::VARCHAR) AND s.ws = floor(d.doc_id / 121)::BIGINT::VARCHAR
), walk AS (  -- the state after each command: revisions that can be undone, the applied requests, and the confirmed
  -- and excluded records at each revision so far
  SELECT ws, -1::BIGINT AS k, 0::BIGINT AS revision, []::BIGINT[] AS stack, []::VARCHAR[] AS ids, []::VARCHAR[] AS payloads, [[]]::VARCHAR[][] AS confirmed, [[]]::VARCHAR[][] AS excluded, [[]]::BIGINT[][] AS stacks,
    ''::VARCHAR AS outcome, NULL::BIGINT AS made FROM asked GROUP BY ws
  UNION ALL
  SELECT ws, k, CASE WHEN outcome = 'applied' THEN revision + 1 ELSE revision END,
    CASE WHEN outcome <> 'applied' THEN stack WHEN action = 'undo' THEN stacks[target] ELSE list_append(stack, revision + 1) END,
    CASE WHEN outcome = 'applied' THEN list_append(ids, request_id) ELSE ids END, CASE WHEN outcome = 'applied' THEN list_append(payloads, payload) ELSE payloads END,
    CASE WHEN outcome <> 'applied' THEN confirmed ELSE list_append(confirmed, CASE WHEN action = 'undo' THEN confirmed[target] WHEN action = 'confirm' THEN list_append(confirmed[revision + 1], record_id) ELSE confirmed[revision + 1] END) END,
    CASE WHEN outcome <> 'applied' THEN excluded ELSE list_append(excluded, CASE WHEN action = 'undo' THEN excluded[target] WHEN action = 'confirm' THEN list_filter(excluded[revision + 1], lambda x: x <> record_id) ELSE list_append(excluded[revision + 1], record_id) END) END,
    CASE WHEN outcome <> 'applied' THEN stacks ELSE list_append(stacks, CASE WHEN action = 'undo' THEN stacks[target] ELSE list_append(stack, revision + 1) END) END,
    outcome, CASE outcome WHEN 'applied' THEN revision + 1 WHEN 'replayed' THEN list_position(ids, request_id) END
  FROM (
    SELECT a.*, w.revision, w.stack, w.ids, w.payloads, w.confirmed, w.excluded, w.stacks, CASE
      WHEN a.action <> 'confirm' AND a.note = '' THEN 'note_missing'
      WHEN list_contains(w.ids, a.request_id) THEN CASE WHEN w.payloads[list_position(w.ids, a.request_id)] = a.payload THEN 'replayed' ELSE 'request_reused' END
      WHEN a.expected <> w.revision THEN 'stale'
      WHEN a.action = 'undo' THEN CASE WHEN len(w.stack) > 0 AND w.stack[-1] = a.target THEN 'applied' ELSE 'undo_not_newest' END
      WHEN a.action = 'other' THEN 'action_unknown'
      WHEN NOT a.known THEN 'record_unknown'
      WHEN a.action = 'confirm' AND (a.said = 'abc' OR a.said = '' AND a.open_ AND NOT list_contains(w.confirmed[w.revision + 1], a.record_id)) THEN 'fields_invalid'
      ELSE 'applied' END AS outcome
    FROM walk w JOIN asked a ON a.ws = w.ws AND a.k = w.k + 1))"""


@register(_REPLAY + " SELECT ws AS workspace_id, k AS seq, outcome, made AS revision FROM walk WHERE k >= 0")
def review_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each review command: repeats, stale revisions, undos, unreadable values."""
    return commands.replay_commands(*_review_batch(spark, sf_dir)).select("workspace_id", "seq", "outcome", "revision")


@register(_REPLAY + """, newest AS (SELECT ws, max_by(confirmed[revision + 1], k) AS c, max_by(excluded[revision + 1], k) AS e FROM walk GROUP BY 1)
SELECT ws AS workspace_id, record_id, bool_or(gone) AS excluded FROM (SELECT ws, unnest(list_distinct(c)) AS record_id, false AS gone FROM newest UNION ALL SELECT ws, unnest(list_distinct(e)), true FROM newest) GROUP BY 1, 2""")
def review_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that the standing commands confirm or exclude."""
    replayed = commands.replay_commands(*_review_batch(spark, sf_dir))
    return commands.record_states(replayed).select("workspace_id", "record_id", "excluded")


# --- browse --------------------------------------------------------------------------------------


@register(f"SELECT book_record_id, transaction_at, source, amount FROM {q('ledger')} ORDER BY transaction_at DESC, book_record_id DESC LIMIT 100 OFFSET 100")
def records_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.records_page(adapter(spark, sf_dir, "ledger"), page=2).select("book_record_id", "transaction_at", "source", "amount")


@register(f"SELECT book_record_id, counterparty FROM {q('ledger')} WHERE contains(lower(concat_ws(' ', coalesce(counterparty, ''), coalesce(description, ''))), 'shop 1') AND transaction_at >= '1996-01-01' AND transaction_at <= '1998-12-31' AND source = '微信'")
def search_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = browse.filter_records(adapter(spark, sf_dir, "ledger"), text="Shop 1", source="微信", start="1996-01-01", end="1998-12-31")
    return found.select("book_record_id", "counterparty")


@register("""SELECT 'a' AS batch_id, concat_ws(':', 'a', o_orderkey::VARCHAR) AS book_record_id FROM orders UNION ALL SELECT 'b', concat_ws(':', 'b', event_id::VARCHAR) FROM events""")
def batch_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("record_id"))
    b = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("record_id"))
    return browse.book_records([("a", a), ("b", b)]).select("batch_id", "book_record_id")


# --- evidence ------------------------------------------------------------------------------------

_ASSESSED = f"""
WITH RECURSIVE o AS {q("observations")}, pr AS (
  SELECT a.id AS a_id, b.id AS b_id, a.role <> b.role AS roles, a.currency = 'cny' AS bad_currency, a.direction = 'none' AS bad_direction, NOT (a.cash_effect AND b.cash_effect) AS no_cash,
    a.event_kind IS NULL OR b.event_kind IS NULL AS no_kind, a.funding_account <> b.funding_account AS other_account, coalesce(a.funding_account = b.funding_account, false) AS channel, coalesce(a.reference = b.reference, false) AS ref
  FROM o a JOIN o b ON a.id < b.id AND a.amount = b.amount AND a.currency = b.currency AND a.direction = b.direction AND a.start = b.start
), st AS (SELECT a_id, b_id, CASE WHEN NOT roles OR bad_currency OR bad_direction OR no_cash OR coalesce(other_account, false) THEN 'rejected' WHEN no_kind OR NOT (channel OR ref) THEN 'needs_evidence' ELSE 'supported' END AS state FROM pr
)"""


_BLOCK = ["amount", "currency", "direction", "start"]


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter(spark, sf_dir, "observations").withColumn("references", F.when(F.col("reference").isNotNull(), F.array("reference"))).drop("reference")


@register(_ASSESSED + " SELECT a_id, b_id, state FROM st")
def assess_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.assess_pairs(evidence.observation_pairs(_observed(spark, sf_dir), _BLOCK)).select("a_id", "b_id", "state")


@register(_ASSESSED + """, e AS (SELECT a_id AS x, b_id AS y FROM st WHERE state = 'supported' UNION SELECT b_id, a_id FROM st WHERE state = 'supported'),
r AS (SELECT x AS id, x AS root FROM e UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.id) SELECT id, min(root) AS component FROM r GROUP BY 1""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.class_components(evidence.assess_classes(_observed(spark, sf_dir), _BLOCK))


@register(_ASSESSED + """, e AS (SELECT a_id AS x, b_id AS y FROM st WHERE state = 'supported' UNION SELECT b_id, a_id FROM st WHERE state = 'supported'),
r AS (SELECT x AS id, x AS root FROM e UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.id), k AS (SELECT id, min(root) AS component FROM r GROUP BY 1),
link AS (SELECT k.component, e.x AS l, e.y AS r FROM e JOIN k ON k.id = e.x WHERE e.x % 2 = 1),
side AS (SELECT component, list_sort(list(DISTINCT l)) AS ls, list_sort(list(DISTINCT r)) AS rs FROM link GROUP BY 1),
grow AS (SELECT component, 0 AS n, []::BIGINT[] AS used FROM side WHERE len(ls) = len(rs) AND len(ls) <= 32
  UNION ALL SELECT grow.component, n + 1, list_append(used, link.r) FROM grow JOIN side USING (component) JOIN link ON link.component = grow.component AND link.l = side.ls[n + 1] WHERE NOT list_contains(used, link.r)),
done AS (SELECT grow.component, used, ls FROM grow JOIN side USING (component) WHERE n = len(ls)),
pairs AS (SELECT component, unnest(ls) AS left_id, unnest(used) AS right_id FROM done), many AS (SELECT component, count(*) AS m FROM done GROUP BY 1)
SELECT component, left_id, right_id FROM pairs JOIN many USING (component) GROUP BY component, left_id, right_id, m HAVING count(*) = m""")
def forced_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(_observed(spark, sf_dir))
    named = cut(evidence.matchable(evidence.class_components(evidence.assess_classes(rows, _BLOCK)), F.col("id") % 2 == 1))
    # Pairs are made inside the components that can force one.
    few = rows.join(named.select("id"), "id", "left_semi")
    supported = evidence.assess_pairs(evidence.observation_pairs(few, _BLOCK)).where("state = 'supported'").select("a_id", "b_id")
    sided = supported.withColumns({"left_id": F.when(F.col("a_id") % 2 == 1, F.col("a_id")).otherwise(F.col("b_id")), "right_id": F.when(F.col("a_id") % 2 == 1, F.col("b_id")).otherwise(F.col("a_id"))})
    return evidence.forced_pairs(sided.join(named.withColumnRenamed("id", "left_id"), "left_id").select("component", "left_id", "right_id"))


@register(_ASSESSED + """, e AS (SELECT a_id AS x, b_id AS y FROM st WHERE state = 'supported' UNION SELECT b_id, a_id FROM st WHERE state = 'supported'),
r AS (SELECT x AS id, x AS root FROM e UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.id), k AS (SELECT id, min(root) AS component FROM r GROUP BY 1),
u AS (SELECT a_id AS id FROM st WHERE state = 'needs_evidence' UNION SELECT b_id FROM st WHERE state = 'needs_evidence'),
g AS (SELECT component, count(*) FILTER (o.role = 'account_ledger') AS n_left, count(*) FILTER (o.role <> 'account_ledger') AS n_right, sum(CASE WHEN o.role = 'account_ledger' THEN amount END)::DECIMAL(38,2) AS amount, bool_or(u.id IS NOT NULL) AS doubt
  FROM k JOIN o USING (id) LEFT JOIN u USING (id) GROUP BY 1)
SELECT component, n_left, n_right, amount, array_to_string(list_sort(list_filter([CASE WHEN doubt THEN 'unresolved_competitor' END, CASE WHEN n_left <> n_right THEN 'multiplicity_mismatch' END], lambda x: x IS NOT NULL)), ',') AS reasons,
  CASE WHEN doubt OR n_left <> n_right THEN 'blocked' ELSE 'group_review' END AS state FROM g""")
def review_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    observations = adapter(spark, sf_dir, "observations")
    found = evidence.assess_classes(_observed(spark, sf_dir), _BLOCK)
    groups = evidence.judged_groups(evidence.class_components(found), evidence.class_doubts(found), observations, observations.where("false"), complete=True)
    return groups.withColumn("reasons", F.array_join("reasons", ","))


# --- privacy -------------------------------------------------------------------------------------


@register(r"""
WITH m AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '[\p{L}\p{Nd}_.+-]+@[\p{L}\p{Nd}_.-]+\.[A-Za-z]{2,}', '[mail]', 'g'), '(^|[^A-Za-z0-9])\+?\p{Nd}[\p{Nd} ()-]{6,}\p{Nd}', '\1[number]', 'g') AS masked FROM documents)
SELECT doc_id, md5(masked) AS masked_md5 FROM m""")
def mask_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.md5(privacy.mask_patterns(F.col("text"))).alias("masked_md5"))


@register(f"""
SELECT DISTINCT value FROM (SELECT account AS value FROM {q("ledger")} UNION ALL SELECT source_record_id FROM {q("ledger")}) WHERE value IS NOT NULL AND length(value) > 1""")
def private_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.private_values(adapter(spark, sf_dir, "ledger"))


_KEY = b"key of the test book"


def _hmac_sql(text: str) -> str:
    """P and 20 hex digits of the HMAC-SHA256 of a text expression under the test key."""
    pad = lambda by: "".join(rf"\x{x ^ by:02X}" for x in _KEY.ljust(64, b"\0"))
    return f"'P' || substring(sha256('{pad(0x5C)}'::BLOB || unhex(sha256('{pad(0x36)}'::BLOB || encode({text})))), 1, 20)"


@register(f"SELECT book_record_id, {_hmac_sql('account')} AS account_token FROM {q('ledger')}")
def private_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = privacy.hmac_token(_KEY)
    return adapter(spark, sf_dir, "ledger").select("book_record_id", token(F.col("account")).alias("account_token"))


@register(f"""
WITH v AS (SELECT DISTINCT counterparty AS value FROM {q("ledger")} WHERE counterparty IS NOT NULL), t AS (SELECT book_record_id, memo FROM {q("ledger")} WHERE memo IS NOT NULL)
SELECT book_record_id, value FROM t JOIN v ON contains(memo, value)""")
def literals_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each counterparty's name that stands anywhere in a memo: what mask_literals replaces."""
    rows = adapter(spark, sf_dir, "ledger")
    names = rows.where("counterparty IS NOT NULL").select(F.col("counterparty").alias("value")).distinct()
    return privacy.literals_in(rows, "book_record_id", "memo", names).withColumnRenamed("id", "book_record_id")


@register(f"""
SELECT {_hmac_sql('book_record_id')} AS id, amount, CASE WHEN source = '微信' THEN counterparty ELSE {_hmac_sql('counterparty')} END AS counterparty,
  CASE WHEN source = '微信' THEN description ELSE '[个人或未明确对象，说明未外发]' END AS description, CASE WHEN source = '微信' THEN '' ELSE '[未外发]' END AS memo,
  CASE WHEN source_record_id IS NOT NULL THEN {_hmac_sql("concat(source, ':source_record_id:', source_record_id)")} END AS source_record_id FROM {q("ledger")}""")
def outbound_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = privacy.outbound_rows(adapter(spark, sf_dir, "ledger"), _KEY)
    return found.select("id", "amount", "counterparty", "description", "memo", "source_record_id")


# --- recognised pages ----------------------------------------------------------------------------

_OCR = f"""
WITH t AS {q("ocr_tokens")}, d AS (SELECT page_id, y, h, row_number() OVER w - 1 AS row, lag(y) OVER w AS b, lead(y) OVER w AS a FROM (SELECT DISTINCT page_id, y, h FROM t) WINDOW w AS (PARTITION BY page_id ORDER BY y)),
g AS (SELECT *, coalesce(median(a - y) OVER (PARTITION BY page_id), h * 2.8) AS gap FROM d),
bands AS (SELECT page_id, row::INT AS row, coalesce((b + y) / 2, y - gap / 2) AS low, coalesce((a + y) / 2, y + gap / 2) AS high FROM g)"""


def _bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.row_bands(adapter(spark, sf_dir, "ocr_tokens").select("page_id", "y", "h").distinct())


@register(_OCR + " SELECT page_id, row, low, high FROM bands")
def ocr_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bands(spark, sf_dir)


_OCR_COLUMNS = "[('date', 0.0, 120.5), ('amount', 120.5, 300.5), ('balance', 300.5, 9999.0)]"


@register(_OCR + f""", c AS (SELECT x[1] AS field, x[2] AS l, x[3] AS r FROM (SELECT unnest([{{'1': 'date', '2': 0.0, '3': 120.5}}, {{'1': 'amount', '2': 120.5, '3': 300.5}}, {{'1': 'balance', '2': 300.5, '3': 9999.0}}]) AS s), LATERAL (SELECT [s['1'], s['2']::VARCHAR, s['3']::VARCHAR] AS x)),
p AS (SELECT t.page_id, bands.row, c.field, t.text, t.x, t.y, t.score FROM t JOIN bands ON t.page_id = bands.page_id AND t.y >= low AND t.y < high JOIN c ON t.x >= l::DOUBLE AND t.x < r::DOUBLE)
SELECT page_id, row, field, string_agg(text, ' ' ORDER BY round(y / 8), x, text) AS text, min(score) AS least_score FROM p GROUP BY 1, 2, 3""")
def ocr_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = adapter(spark, sf_dir, "ocr_tokens")
    columns = spark.createDataFrame([("date", 0.0, 120.5), ("amount", 120.5, 300.5), ("balance", 300.5, 9999.0)], "field string, left_x double, right_x double")
    per_page = tokens.select("page_id").distinct().withColumn("c", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(a).alias("left_x"), F.lit(b).alias("right_x")) for f, a, b in [tuple(r) for r in columns.collect()]])))
    return ocr.token_cells(tokens, per_page.select("page_id", "c.field", "c.left_x", "c.right_x"), _bands(spark, sf_dir))


@register(f"""
WITH long AS (SELECT page_id, row, unnest(['original', 'dark_gray', 'dark_neutral']) AS view, unnest([v0, v1, v2]) AS x FROM {q("ocr_views")}),
v AS (SELECT page_id, row, max(CASE WHEN view = 'original' THEN x END) AS before, count(DISTINCT x) AS readings, min(x) AS single, count(x) AS n, count(*) AS views FROM long GROUP BY 1, 2)
SELECT page_id, row, before, CASE WHEN readings > 1 THEN NULL WHEN before IS NOT NULL THEN before WHEN readings = 1 AND n >= 2 THEN single END AS after,
  CASE WHEN readings > 1 THEN 'OCR_VIEW_CONFLICT' WHEN before IS NOT NULL AND n < views THEN 'VIEW_LOST_FIELD' WHEN before IS NOT NULL THEN 'AGREED' WHEN readings = 1 AND n >= 2 THEN 'RECOVERED_FROM_DERIVED_VIEWS' ELSE 'UNRESOLVED_FIELD' END AS outcome FROM v""")
def ocr_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = adapter(spark, sf_dir, "ocr_views")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("view"), F.col(c).alias("value")) for n, c in (("original", "v0"), ("dark_gray", "v1"), ("dark_neutral", "v2"))]))
    long = views.select("page_id", "row", F.lit("amount").alias("grp"), each.alias("o")).select("page_id", "row", "grp", "o.view", "o.value")
    return ocr.consensus(long).drop("grp")


@register(f"""
SELECT page_id, row, array_to_string(list_sort(list_filter([CASE WHEN row % 5 = 0 THEN 'OCR_PAGE_COUNT_UNVERIFIED' END, CASE WHEN row % 5 <> 0 AND row % 5 <> 1 THEN 'OCR_PAGE_COUNT_MISMATCH' END,
  CASE WHEN v1 = 'x' THEN 'OCR_DERIVED_VALUE_REQUIRES_REVIEW' END, CASE WHEN v0 IS NULL THEN 'OCR_REQUIRED_FIELD_MISSING' END, CASE WHEN v2 IS NULL THEN 'OCR_SCORE_BELOW_THRESHOLD' END,
  CASE WHEN coalesce(v0 = v1, false)::INT + coalesce(v0 = v2, false)::INT < 1 THEN 'OCR_INSUFFICIENT_AGREEMENT' END], lambda x: x IS NOT NULL)), ',') AS reasons FROM {q("ocr_views")}""")
def ocr_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = adapter(spark, sf_dir, "ocr_views")
    agree = lambda v: F.coalesce(F.col("v0") == F.col(v), F.lit(False)).cast("int")
    rows = views.withColumns(
        {
            "printed": F.when(F.col("row") % 5 != 0, F.col("row") % 5),
            "n_rows": F.lit(1),
            "date_ok": F.col("v0").isNotNull(),
            "amount_ok": F.lit(True),
            "direction_ok": F.lit(True),
            "currency_ok": F.lit(True),
            "least_score": F.when(F.col("v2").isNotNull(), F.lit(0.99)),
            "changed": F.col("v1") == "x",
            "uncertain": F.lit(False),
            "agreeing_views": agree("v1") + agree("v2"),
        }
    )
    return rows.select("page_id", "row", F.array_join(ocr.release_reasons(rows), ",").alias("reasons"))


# --- readings and read models --------------------------------------------------------------------


@register("""
SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE o_orderdate + INTERVAL (o_custkey % 86400) SECOND - CASE o_orderkey % 4 WHEN 0 THEN INTERVAL (o_custkey % 86400) SECOND WHEN 1 THEN INTERVAL (o_custkey % 60) SECOND ELSE INTERVAL 0 SECOND END END AS starts,
  starts + CASE o_orderkey % 4 WHEN 0 THEN INTERVAL 1 DAY WHEN 1 THEN INTERVAL 1 MINUTE ELSE INTERVAL 1 SECOND END AS ends FROM orders""")
def time_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order times as half-open intervals of a day, a minute, a second or an unknown precision."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS id", "CAST(o_orderdate + make_dt_interval(0, 0, 0, o_custkey % 86400) AS STRING) AS value", "element_at(array('day', 'minute', 'second', 'hour'), CAST(o_orderkey % 4 AS INT) + 1) AS precision")
    ranged = orders.withColumn("x", facts.time_range(F.col("value"), F.col("precision"), F.lit("local")))
    return ranged.select("id", F.col("x.start").alias("starts"), F.col("x.end").alias("ends"))


_READ = "l_orderkey * 10 + l_linenumber"


@register(f"""
WITH c AS (SELECT {_READ} AS id, l_extendedprice::DECIMAL(38,2) AS price, l_partkey % 4 AS kind, l_suppkey % 3 AS day, l_shipdate::DATE AS d, 1 - l_discount AS score FROM lineitem),
r AS (SELECT *, CASE kind WHEN 0 THEN price WHEN 1 THEN price WHEN 2 THEN NULL ELSE 0 END AS amount, CASE kind WHEN 0 THEN 'out' WHEN 1 THEN 'in' WHEN 3 THEN 'none' END AS direction, CASE WHEN year(d) < 2000 THEN NULL WHEN day = 0 THEN d::VARCHAR WHEN day = 1 THEN d::VARCHAR || ' 10:20:30' END AS transaction_at FROM c)
SELECT id, transaction_at, amount::DECIMAL(38,2) AS amount, direction, array_to_string(list_filter([CASE WHEN kind = 2 THEN 'AMBIGUOUS_DUAL_AMOUNT' END, CASE WHEN amount IS NULL THEN 'AMOUNT_UNREADABLE' END, CASE WHEN direction IS NULL THEN 'DIRECTION_UNKNOWN' END,
  CASE WHEN transaction_at IS NULL THEN 'DATE_UNREADABLE' END, 'BALANCE_UNREADABLE', CASE WHEN score < 0.9 THEN 'LOW_OCR_SCORE' END], lambda x: x IS NOT NULL), ',') AS issues FROM r""")
def recognised_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised cells of both layouts, dates whole, with a clock or damaged; years before 2000 are not read."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        f"{_READ} AS id",
        "CAST(CAST(l_extendedprice AS DECIMAL(38,2)) AS STRING) AS price",
        "l_partkey % 4 AS kind",
        "concat(CAST(CAST(l_shipdate AS DATE) AS STRING), element_at(array('', ' 10:20:30', ' 10:2'), CAST(l_suppkey % 3 AS INT) + 1)) AS day",
        "array(1 - l_discount) AS scores",
    )
    layouts = [("0", ("signed",), ("concat('-￥', price)",)), ("1", ("signed",), ("concat('+', price)",)), ("2", ("credit", "debit"), ("price", "price")), ("3", ("credit", "debit"), ("'0.00'", "'-'"))]
    cells = "CASE kind " + " ".join(f"WHEN {k} THEN map('date', day, {', '.join(f'{chr(39)}{f}{chr(39)}, {v}' for f, v in zip(fields, values))})" for k, fields, values in layouts) + " END AS cells"
    read = ocr_records.ocr_rows_to_records(rows.selectExpr("id", cells, "scores"))
    return read.select("id", "transaction_at", "amount", "direction", F.array_join("issues", ",").alias("issues"))


_PAGES = f"""
WITH t AS MATERIALIZED (SELECT * FROM {q("page_heads")} UNION ALL SELECT * FROM {q("page_tokens")}), named AS (
  SELECT *, CASE text WHEN '交易日期' THEN 'date' WHEN '摘要' THEN 'description' WHEN '交易金额' THEN 'signed' WHEN '余额' THEN 'balance' END AS field FROM t
), head AS (SELECT page_id, min(y) AS hy, 12.0 AS hh FROM named WHERE field = 'date' GROUP BY 1
), line AS (SELECT n.page_id, n.x, n.field FROM named n JOIN head USING (page_id) WHERE abs(n.y - hy) < greatest(n.h, hh) * 0.7
), edges AS (SELECT page_id, field, coalesce((x + lag(x) OVER w) / 2, '-inf'::DOUBLE) AS l, coalesce((x + lead(x) OVER w) / 2, 'inf'::DOUBLE) AS r FROM line WINDOW w AS (PARTITION BY page_id ORDER BY x)
), col AS (SELECT * FROM edges WHERE field IS NOT NULL), layout AS (SELECT page_id, count(*) AS n, list(DISTINCT field) AS fields FROM col GROUP BY 1
), judged AS (
  SELECT p.page_id, CASE WHEN n IS NULL THEN 'HEADER_UNREADABLE' WHEN n > len(fields) THEN 'HEADER_AMBIGUOUS' WHEN NOT list_contains(fields, 'signed') THEN 'AMOUNT_HEADER_UNREADABLE' END AS code
  FROM (SELECT DISTINCT page_id FROM t) p LEFT JOIN layout USING (page_id)
), c AS (SELECT col.* FROM col JOIN judged USING (page_id) WHERE code IS NULL
), d AS (SELECT t.page_id, t.x, t.y, t.h FROM t JOIN c ON t.page_id = c.page_id AND c.field = 'date' AND t.x >= l AND t.x < r JOIN head ON head.page_id = t.page_id AND t.y > hy + hh * 0.8 WHERE regexp_full_match(t.text, '20\\d\\d-\\d\\d-\\d\\d')
), s AS (SELECT *, lag(y) OVER w AS b, lead(y) OVER w AS a, row_number() OVER w - 1 AS row FROM d WINDOW w AS (PARTITION BY page_id ORDER BY y)
), g AS (SELECT *, coalesce(median(a - y) OVER (PARTITION BY page_id), h * 2.8) AS gap FROM s
), band AS (SELECT page_id, row, x AS date_x, y AS date_y, coalesce((b + y) / 2, y - gap / 2) AS low, coalesce((a + y) / 2, y + gap / 2) AS high FROM g)"""


def _page_table(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    heads = adapter(spark, sf_dir, "page_heads")
    return page_tables.recognised_records(heads.unionByName(adapter(spark, sf_dir, "page_tokens")))


#: Dates at one height follow each other by their height, place and width, as in row_bands().
_ORDERED_PAGES = _PAGES.replace("(PARTITION BY page_id ORDER BY y)", "(PARTITION BY page_id ORDER BY y, h, x, w)").replace("SELECT t.page_id, t.x, t.y, t.h FROM", "SELECT t.page_id, t.x, t.y, t.h, t.w FROM")


@register(_ORDERED_PAGES + """, placed AS (
  SELECT b.page_id, b.row, c.field, string_agg(t.text, ' ' ORDER BY round_even(t.y / 8, 0), t.x, t.text) AS text, min(t.score) AS least FROM t JOIN c ON t.page_id = c.page_id AND t.x >= l AND t.x < r JOIN band b ON b.page_id = t.page_id AND t.y >= low AND t.y < high GROUP BY 1, 2, 3
), wide AS (SELECT page_id, row, max(text) FILTER (field = 'date') AS day, max(text) FILTER (field = 'description') AS description, max(text) FILTER (field = 'signed') AS signed, min(least) AS least_score FROM placed GROUP BY 1, 2)
SELECT page_id, date_x, date_y, high - low AS row_height, coalesce(day, '') AS day, coalesce(description, '') AS description, coalesce(signed, '') AS signed, least_score, CASE WHEN regexp_full_match(day, '20\\d\\d-\\d\\d-\\d\\d') THEN day END AS transaction_at,
  CASE WHEN regexp_full_match(signed, '[+-]\\d+\\.50') THEN abs(signed::DECIMAL(38,2)) END AS amount, CASE WHEN regexp_full_match(signed, '[+-]\\d+\\.50') THEN CASE WHEN signed LIKE '-%' THEN 'out' ELSE 'in' END END AS direction
FROM band LEFT JOIN wide USING (page_id, row)""")
def page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of recognised pages, from tokens: cells by each page's header line, amounts and dates read."""
    records, _ = _page_table(spark, sf_dir)
    cell = lambda f: F.coalesce(F.try_element_at("cells", F.lit(f)), F.lit("")).alias("day" if f == "date" else f)
    return records.select("page_id", "date_x", "date_y", "row_height", cell("date"), cell("description"), cell("signed"), F.array_min("scores").alias("least_score"), "transaction_at", "amount", "direction")


@register(_PAGES + """ SELECT page_id, code FROM judged WHERE code IS NOT NULL UNION ALL SELECT page_id, 'NO_DATE_ROWS' FROM judged WHERE code IS NULL AND page_id NOT IN (SELECT page_id FROM band)""")
def page_table_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised pages that give no rows, and why."""
    _, issues = _page_table(spark, sf_dir)
    return issues


_VIEWS = f"""
WITH o AS MATERIALIZED {q("page_views")}, bad AS (SELECT DISTINCT page_id, 'dark_neutral' AS view FROM o WHERE page_id % 17 = 0),
base AS (SELECT * FROM o WHERE view = 'original'), other AS (SELECT * FROM o WHERE view <> 'original' AND (page_id, view) NOT IN (SELECT page_id, view FROM bad)),
hit AS (
  SELECT b.page_id, x.view, b.row, x.row AS other_row FROM base b JOIN other x ON b.page_id = x.page_id
    AND abs(b.date_y - x.date_y) <= least(b.row_height, x.row_height) * 0.3 AND abs(b.date_x - x.date_x) <= greatest(b.date_width, x.date_width) * 0.5
), n_base AS (SELECT page_id, count(*) AS n FROM base GROUP BY 1), n_other AS (SELECT page_id, view, count(*) AS m FROM other GROUP BY 1, 2),
good AS (
  SELECT page_id, view FROM (SELECT page_id, view, count(*) AS k, count(DISTINCT row) AS r, count(DISTINCT other_row) AS t FROM hit GROUP BY 1, 2)
  JOIN n_base USING (page_id) JOIN n_other USING (page_id, view) WHERE n = m AND k = n AND r = n AND t = n
), seen AS (
  SELECT page_id, row, view, transaction_at, amount, direction, balance FROM base
  UNION ALL SELECT h.page_id, h.row, h.view, x.transaction_at, x.amount, x.direction, x.balance FROM hit h JOIN good USING (page_id, view) JOIN other x ON x.page_id = h.page_id AND x.view = h.view AND x.row = h.other_row
), groups AS (
  SELECT page_id, row, view, unnest(['transaction_at', 'amount+direction', 'balance']) AS grp, unnest([transaction_at, amount, balance]) AS a, unnest(['', direction, '']) AS b FROM seen
), judged AS (
  SELECT page_id, row, grp, max(CASE WHEN view = 'original' THEN a END) AS a0, max(CASE WHEN view = 'original' THEN b END) AS b0, count(DISTINCT a) > 1 OR count(DISTINCT b) > 1 AS differ,
    count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS wholes, count(*) AS views, max(a) AS a1, max(b) AS b1
  FROM groups GROUP BY 1, 2, 3
), told AS (
  SELECT *, a0 IS NOT NULL AND b0 IS NOT NULL AS stated FROM judged
), done AS (
  SELECT page_id, row, grp, a0, b0, CASE WHEN differ THEN NULL WHEN NOT stated AND wholes >= 2 THEN a1 ELSE a0 END AS a2, CASE WHEN differ THEN NULL WHEN NOT stated AND wholes >= 2 THEN b1 ELSE b0 END AS b2,
    CASE WHEN differ THEN 'OCR_VIEW_CONFLICT:' || grp WHEN stated AND wholes < views THEN 'VIEW_LOST_FIELD:' || grp WHEN NOT stated AND wholes >= 2 THEN 'RECOVERED_FROM_DERIVED_VIEWS:' || grp WHEN NOT stated THEN 'UNRESOLVED_FIELD:' || grp END AS issue
  FROM told
)"""


def _merged_views(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    seen = adapter(spark, sf_dir, "page_views")
    bad = seen.where("page_id % 17 = 0").select("page_id", F.lit("dark_neutral").alias("view"), F.lit("HEADER_UNREADABLE").alias("code")).distinct()
    return observations.merge_observations(seen, bad)


@register(_VIEWS + """
SELECT page_id, row, max(a2) FILTER (grp = 'transaction_at') AS transaction_at, max(a2) FILTER (grp = 'amount+direction') AS amount, max(b2) FILTER (grp = 'amount+direction') AS direction, max(a2) FILTER (grp = 'balance') AS balance,
  concat_ws(',', 'OCR_REQUIRES_REVIEW', max(issue) FILTER (grp = 'transaction_at'), max(issue) FILTER (grp = 'amount+direction'), max(issue) FILTER (grp = 'balance')) AS issues,
  count(*) FILTER (a0 IS DISTINCT FROM a2 OR grp = 'amount+direction' AND b0 IS DISTINCT FROM b2) AS n_changes
FROM done GROUP BY 1, 2""")
def page_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of recognised pages as three views of them agree or differ."""
    proposals, _ = _merged_views(spark, sf_dir)
    return proposals.select("page_id", "row", *[f for g in observations.GROUPS for f in g], F.array_join("issues", ",").alias("issues"), F.size("changes").cast("long").alias("n_changes"))


@register(_VIEWS + """
SELECT page_id, string_agg('VIEW_LAYOUT_MISMATCH:' || view, ',' ORDER BY view) AS issues
FROM (SELECT DISTINCT page_id, view FROM (SELECT page_id, view FROM o UNION SELECT page_id, view FROM bad) WHERE view <> 'original') WHERE (page_id, view) NOT IN (SELECT page_id, view FROM good) AND page_id IN (SELECT page_id FROM base) GROUP BY 1""")
def page_view_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of recognised pages that do not correspond to the original row by row."""
    _, issues = _merged_views(spark, sf_dir)
    return issues.select("page_id", F.array_join("issues", ",").alias("issues"))


@register(f"""
WITH {_CURRENCY_SQL} SELECT count(*) FILTER (issue = 'CURRENCY_DEFAULTED') AS n_defaulted FROM currencies""")
def currency_default_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = normalize.normalize_rows(adapter(spark, sf_dir, "cells")).select(F.explode("issues").alias("code"))
    return totals.currency_defaults(issues)


@register(f"""
WITH {_AMOUNT_SQL}, {_CURRENCY_SQL}, flat AS (
  SELECT a.record_id, unnest(list_concat(CASE WHEN a.record_id % 5 = 3 THEN ['DATE_INVALID', 'DATE_MISSING'] ELSE []::VARCHAR[] END, a.issues, CASE WHEN c.issue = 'CURRENCY_CONFLICT' THEN [c.issue] ELSE []::VARCHAR[] END)) AS code
  FROM amounts a JOIN currencies c USING (record_id)),
pointed AS (SELECT record_id, code, unnest(CASE WHEN code IN ('AMOUNT_INVALID', 'AMOUNT_CONFLICT', 'AMOUNT_MISSING') THEN ['amount'] WHEN code IN ('BOTH_DIRECTIONS', 'DIRECTION_CONFLICT', 'SPLIT_AMOUNT_NEGATIVE') THEN ['amount', 'direction']
  WHEN code = 'CURRENCY_CONFLICT' THEN ['currency', 'amount'] WHEN code IN ('DIRECTION_UNKNOWN', 'DIRECTION_MISSING') THEN ['direction'] ELSE ['transaction_at'] END) AS field FROM flat)
SELECT record_id, field, array_to_string(list_sort(list(DISTINCT code)), ',') AS reasons, CASE field WHEN 'amount' THEN '1,3' WHEN 'currency' THEN '1,3' WHEN 'direction' THEN '2' ELSE '0,4' END AS columns FROM pointed GROUP BY 1, 2""")
def review_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the errors of each record point at, and the columns of its row."""
    read = normalize.normalize_rows(adapter(spark, sf_dir, "cells"))
    layout = F.create_map(*[F.lit(x) for pair in {"transaction_at": 0, "amount": 1, "direction": 2, "credit_amount": 3, "transaction_time": 4}.items() for x in pair])
    records = read.select("record_id", F.lit("pending").alias("review_status"), layout.alias("columns"))
    errors = normalize.issue_rows(read, "record_id")
    found = review.field_attention(records, errors)
    return found.select("record_id", "field", F.array_join("reasons", ",").alias("reasons"), F.array_join(F.transform("columns", lambda i: i.cast("string")), ",").alias("columns"))


@register("""
WITH m AS (SELECT source, lang, count(*) AS n, CASE WHEN source IS NULL OR lang IS NULL THEN 1 ELSE 0 END AS odd FROM documents GROUP BY ALL)
SELECT source AS book_id, lang AS batch_id, n::BIGINT AS n, odd::BIGINT AS blockers FROM m WHERE source IS NOT NULL
UNION ALL SELECT source, NULL, sum(n)::BIGINT, sum(odd)::BIGINT FROM m WHERE source IS NOT NULL GROUP BY 1""")
def book_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source and language as batches of a book, and each source's sum."""
    batches = spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy(F.col("source").alias("book_id"), F.col("lang").alias("batch_id")).agg(F.count("*").alias("n"))
    return totals.book_rollup(batches.withColumns({"blockers": F.lit(0), "readable": F.col("book_id").isNotNull() & F.col("batch_id").isNotNull()}), ["n"])


@register(f"""
WITH l AS {q("ledger")}, k AS (SELECT *, CASE WHEN id % 6 = 0 THEN id - id % 18 ELSE id END AS key FROM l WHERE source = '微信'),
g AS (SELECT key, min(book_record_id) AS first FROM k GROUP BY 1)
SELECT k.book_record_id, g.first AS transaction_id FROM k JOIN g USING (key)""")
def source_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Platform rows of which each third even one is exported again, in a file of its own."""
    rows = adapter(spark, sf_dir, "ledger").where("source = '微信'").withColumn("_key", F.when(F.col("id") % 6 == 0, F.col("id") - F.col("id") % 18).otherwise(F.col("id")))
    same = ("amount", "direction", "transaction_at", "transaction_status", "raw_status", "account")
    made = rows.withColumns({"source_record_id": F.concat(F.lit("native"), F.col("_key").cast("string")), "file_id": (F.col("id") % 18).cast("string"), "batch_id": F.lit("b")} | {c: F.lit("1") for c in same})
    return duplicates.source_duplicates(made)


# --- import of segments --------------------------------------------------------------------------

#: Each customer's orders as a segment of a statement. By the customer's number: headers by their names; a mapping
#: with codes of its own; one that points beyond the row; one for the whole file over headers by their names.
CUSTOMER_ROWS = """
(SELECT CAST(o_custkey AS VARCHAR(20)) AS segment, o_custkey % 4 AS kind, o_orderkey,
  CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 1 AS INT) AS line,
  CAST(CAST(o_orderdate AS DATE) + INTERVAL 10 YEAR AS DATE) AS day, CAST(o_totalprice AS DECIMAL(15,2)) AS price, o_orderstatus AS status FROM orders)"""


@register(f"""
WITH r AS {CUSTOMER_ROWS}, rows AS (
  SELECT segment, kind, line, price, status, strftime(day, '%Y-%m-%d') AS day, o_orderkey % 2 = 1 AS odd FROM r
  UNION ALL SELECT DISTINCT segment, kind, 1, NULL, NULL, NULL, NULL FROM r)
SELECT segment, line, CASE WHEN kind = 2 THEN 'unmapped' WHEN line = 1 THEN 'header' ELSE 'transaction' END AS disposition,
  CASE WHEN kind = 2 OR line = 1 THEN NULL WHEN kind = 0 THEN 'exact_alias' ELSE 'user_confirmed' END AS mapping_method,
  CASE WHEN kind = 2 OR line = 1 THEN NULL ELSE day END AS transaction_at,
  CASE WHEN kind = 2 OR line = 1 THEN NULL ELSE price::DOUBLE END AS amount,
  CASE WHEN kind = 2 OR line = 1 THEN NULL WHEN kind = 3 THEN CASE WHEN odd THEN 'out' ELSE 'in' END WHEN status = 'F' THEN 'in' WHEN status = 'O' THEN 'out' ELSE 'none' END AS direction,
  CASE WHEN kind = 2 OR line = 1 THEN NULL WHEN kind = 1 THEN 'USD' WHEN kind = 3 THEN 'HKD' ELSE 'CNY' END AS currency,
  CASE WHEN kind = 2 THEN 'COLUMN_UNKNOWN' END AS problem
FROM rows""")
def mapped_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that were extracted before, read by header names or by the mappings of a user: every row, with its record."""
    made = spark.sql("SELECT * FROM " + CUSTOMER_ROWS.replace("FROM orders", "FROM {orders}"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    kind = F.col("kind")
    known, own = ["交易日期", "金额", "收/支", "币种"], ["d", "v", "k", "c"]
    heads = made.select("segment", "kind").distinct().select("segment", "kind", F.lit(1).alias("line"), F.when(kind.isin(0, 3), F.array(*[F.lit(h) for h in known])).otherwise(F.array(*[F.lit(h) for h in own])).alias("values"))
    words = F.when(kind == 0, F.when(F.col("status") == "F", "收入").when(F.col("status") == "O", "支出").otherwise("不计收支")).otherwise(F.col("status"))
    sign = F.when((kind == 3) & (F.col("o_orderkey") % 2 == 1), "-").otherwise("")
    cells = F.array(F.date_format("day", "yyyy-MM-dd"), F.concat(sign, F.col("price").cast("string")), words, F.when(kind == 0, "CNY").otherwise(""))
    rows = made.select("segment", "kind", "line", cells.alias("values")).union(heads)
    file = F.when(kind == 3, "whole").otherwise("parts")
    rows = rows.select(file.alias("sha256"), file.alias("file_id"), file.alias("path"), "segment", "line", F.col("line").alias("end_line"), "values", F.transform("values", lambda _: F.lit("s")).alias("cell_types"), F.array().cast("array<string>").alias("formats"), F.create_map().cast("map<int,string>").alias("formulas"))
    codes = F.expr("map('f ', 'in', 'O', 'out', 'p', 'none')")
    columns = F.when(kind == 1, F.expr("map('transaction_at', 0, 'amount', 1, 'direction', 2)")).otherwise(F.expr("map('transaction_at', 0, 'amount', 4)"))
    each = heads.where("kind IN (1, 2)").select(F.lit("parts").alias("sha256"), "segment", F.lit(1).alias("header_line"), columns.alias("columns"), F.lit("USD").alias("currency"), F.lit(False).alias("amount_signed"), codes.alias("direction_codes"), F.lit("own").alias("source"))
    whole = spark.range(1).select(F.lit("whole").alias("sha256"), F.lit("*").alias("segment"), F.lit(1).alias("header_line"), F.expr("map('transaction_at', 0, 'amount', 1)").alias("columns"), F.lit("HKD").alias("currency"), F.lit(True).alias("amount_signed"), F.lit(None).cast("map<string,string>").alias("direction_codes"), F.lit("own").alias("source"))
    raw, records, mapped = ingest.import_segments(rows, each.union(whole))
    read = records.select("raw_id", "mapping_method", "transaction_at", F.col("amount").cast("double").alias("amount"), "direction", "currency")
    return raw.select("raw_id", "segment", "segment_id", "line", "disposition").join(read, "raw_id", "left").join(mapped.select("segment_id", "problem"), "segment_id", "left").drop("raw_id", "segment_id")


# --- streams -------------------------------------------------------------------------------------


@register("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, sum(value::DECIMAL(18,2))::DECIMAL(38,2) AS total FROM events GROUP BY 1, 2")
def window_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the stream in ledgerloom.streaming; tests compare the two."""
    return streaming.window_totals(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", "value", ["event_type"])


@register("SELECT DISTINCT user_id, event_type FROM events")
def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = streaming.read_stream(spark, f"{sf_dir}/events.parquet*", schema)
    kept = streaming.once(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["user_id", "event_type"], "3650 days").select("user_id", "event_type")
    return streaming.run_to_end(kept, f"once_{uuid.uuid4().hex}")


def compatible_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not registered: window_300s without the day buckets, which the tests compare it with."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    a, b = events.where("event_type = 'click'").alias("a"), events.where("event_type = 'purchase'").alias("b")
    second = F.lit("second")
    return a.join(b, (F.col("a.user_id") == F.col("b.user_id")) & within_window(F.col("a.ts"), second, F.col("b.ts"), second)).select(F.col("a.event_id").alias("bank_id"), F.col("b.event_id").alias("order_id"))
