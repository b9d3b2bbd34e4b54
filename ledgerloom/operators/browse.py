"""Read models: unions of batches, record pages, searches, exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def book_records(batches: list[tuple[str, DataFrame]]) -> DataFrame:
    """The union of a book's batches; book_record_id is batch id and record id."""
    parts = [df.withColumns({"batch_id": F.lit(name), "book_record_id": F.concat_ws(":", F.lit(name), F.col("record_id").cast("string"))}) for name, df in batches]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def searchable(*columns: Column) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]))


def filter_records(records: DataFrame, text: str | None = None, columns: list[str] | None = None, source: str | None = None, status: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Records that hold a text, of a source and status, between two days (inclusive).

    Dates are compared as text; a record without a date passes only if no day is asked for.
    """
    day = F.substring(F.coalesce(F.nullif(F.col("transaction_at"), F.lit("")), F.col("booking_at")), 1, 10)
    out = records
    if text:
        out = out.where(F.contains(searchable(*[F.col(c) for c in columns or ["counterparty", "description"]]), F.lit(text.lower())))
    if source:
        out = out.where(F.col("source") == source)
    if status:
        out = out.where(F.col("review_status") == status)
    if start:
        out = out.where(day >= start)
    if end:
        out = out.where(day <= end)
    return out


def records_page(records: DataFrame, page: int = 1, size: int = 100) -> DataFrame:
    """One page of at most a hundred records, the latest first, then by the greatest id."""
    size = min(size, 100)
    when = F.coalesce(F.nullif(F.col("transaction_at"), F.lit("")), F.col("booking_at"), F.lit(""))
    return records.orderBy(when.desc(), F.col("book_record_id").desc()).offset((page - 1) * size).limit(size)


def candidates_page(proposals: DataFrame, page: int = 1, size: int = 100, show_all: bool = False) -> DataFrame:
    """One page of the open proposals, the greatest amount first."""
    shown = proposals if show_all else proposals.where("status IN ('suggested', 'stale')")
    return shown.orderBy(F.col("amount").desc(), "id").offset((page - 1) * size).limit(min(size, 100))


def source_label(sequence_cell: Column, row: Column, record_id: Column) -> Column:
    """How a person finds a record: its sequence cell, else its row in the file, else its id's end."""
    return F.coalesce(F.nullif(F.trim(sequence_cell), F.lit("")), F.concat(F.lit("row "), row.cast("string")), F.call_function("right", record_id, F.lit(8)))


def fingerprint(records: DataFrame) -> DataFrame:
    """One row: a digest of all rows that does not depend on their order: counts and sums of row hashes."""
    row = F.to_json(F.struct(*[F.col(c) for c in sorted(records.columns)]))
    hashes = [F.sum(F.conv(F.substring(F.sha2(row, 256), 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"h{i}") for i in range(4)]
    return records.agg(F.count("*").alias("n"), *hashes).select(F.sha2(F.concat_ws("-", "n", *[F.col(f"h{i}") for i in range(4)]), 256).alias("fingerprint"))


def coverage_gaps(records: DataFrame, transactions: DataFrame) -> DataFrame:
    """Invariant: each record's id is in just one transaction; rows are the ids for which it is not."""
    used = transactions.select(F.explode("source_ids").alias("book_record_id"))
    return records.select("book_record_id").exceptAll(used).withColumn("gap", F.lit("missing")).union(used.exceptAll(records.select("book_record_id")).withColumn("gap", F.lit("extra")))


def transactions_order(transactions: DataFrame) -> DataFrame:
    """Transactions as they are listed: the latest time text first, then the greatest id."""
    when = F.coalesce(F.nullif("transaction_at", F.lit("")), F.nullif("booking_at", F.lit("")), F.lit(""))
    return transactions.orderBy(when.desc(), F.col("id").desc())


def brief(transactions: DataFrame) -> DataFrame:
    """The columns of a transaction that a list shows."""
    shown = ("id", "transaction_at", "booking_at", "counterparty", "description", "money", "currency", "direction", "refund", "refund_linked", "included", "source_ids")
    return transactions.select(*[c for c in shown if c in transactions.columns])


def search_transactions(transactions: DataFrame, text: str) -> DataFrame:
    """Transactions whose counterparty or description holds a text."""
    return transactions.where(F.contains(searchable(F.col("counterparty"), F.col("description")), F.lit(text.lower())))


def with_verdicts(relations: DataFrame, verdicts: DataFrame, policy: str, fingerprint: str) -> DataFrame:
    """relations (id, dependencies map) with verdict: the newest one of a policy and input, if its
    records are still the same.

    verdicts: (relation_id, job, policy, fingerprint, verdict, dependencies); a greater job is newer.
    """
    valid = verdicts.where((F.col("policy") == policy) & (F.col("fingerprint") == fingerprint))
    latest = valid.groupBy("relation_id").agg(F.max_by(F.struct("verdict", F.col("dependencies").alias("seen")), "job").alias("_v"))
    joined = relations.join(latest, F.col("id") == F.col("relation_id"), "left")
    same = F.array_sort(F.map_entries("dependencies")) == F.array_sort(F.map_entries("_v.seen"))
    return joined.withColumn("verdict", F.when(same, F.col("_v.verdict"))).drop("relation_id", "_v")


def latest_jobs(jobs: DataFrame, most: int = 20) -> DataFrame:
    """The newest jobs, at most so many."""
    return jobs.orderBy(F.col("job").desc()).limit(most)


def record_lineage(records: DataFrame, raw_rows: DataFrame, files: DataFrame) -> DataFrame:
    """records with the cells of their row and the name and digest of their file; all records stay."""
    raw = raw_rows.select("raw_id", F.col("values").alias("raw_values"), F.col("disposition").alias("raw_disposition"))
    named = files.select("file_id", F.col("path").alias("file_path"), "sha256")
    return records.join(raw, "raw_id", "left").join(named, "file_id", "left")


def document_text(segments: DataFrame) -> DataFrame:
    """(file_id, text): the texts outside of tables in reading order, a line each.

    segments: (file_id, place, line, values). A file's text is one row; files are limited in size.
    """
    lines = segments.select("file_id", "place", "line", F.posexplode("values").alias("at", "value")).where("value IS NOT NULL")
    ordered = lines.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("place", "line", "at", "value"))).alias("all"))
    return ordered.select("file_id", F.array_join(F.transform("all", lambda x: x["value"]), "\n").alias("text"))
