"""Statement files as DataFrames: format by magic bytes, and delimited text with its physical lines."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Limits of a statement file.
MOST_BYTES, MOST_ROWS, MOST_COLUMNS = 50 * 1024 * 1024, 200_000, 256
DELIMITERS = (",", "\t", ";", "，")
#: First bytes (hex) of the formats.
MAGIC = (("25504446", "pdf"), ("89504E470D0A1A0A", "png"), ("FFD8FF", "jpeg"), ("D0CF11E0A1B11AE1", "xls"), ("504B0304", "xlsx"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content, sha256) of the files under a path, read by Spark wherever they are."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", "content", F.sha2("content", 256).alias("sha256"))


def file_format(path: Column, content: Column, length: Column) -> Column:
    """struct(format, issue): by the first bytes; text formats by the extension."""
    head = F.hex(F.substring(content, 1, 8))
    extension = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    fmt = None
    for magic, name in MAGIC:
        fmt = F.when(head.startswith(magic), name) if fmt is None else fmt.when(head.startswith(magic), name)
    fmt = fmt.when(extension.isin("csv", "tsv", "txt"), "csv")
    image = F.when(extension == "jpg", "jpeg").when(extension.isin("tsv", "txt"), "csv").otherwise(extension)
    issue = F.when(length > MOST_BYTES, "FILE_TOO_LARGE").when(fmt.isNull(), "FORMAT_MISMATCH").when(fmt != image, "EXTENSION_MISMATCH")
    return F.struct(F.when(length <= MOST_BYTES, fmt).alias("format"), issue.alias("issue"))


def new_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose bytes were not read before, each content once: the first path of it."""
    fresh = files.join(known.select("sha256"), "sha256", "left_anti")
    first = fresh.groupBy("sha256").agg(F.min("path").alias("path"))
    return fresh.join(first, ["sha256", "path"], "left_semi")


def decode(content: bytes) -> str | None:
    if content[:2] in (b"\xff\xfe", b"\xfe\xff"):
        encodings = ("utf-16",)
    else:
        encodings = ("utf-8-sig", "gb18030")
    for encoding in encodings:
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            continue
    return None


def table_rows(text: str) -> tuple[list[tuple[int, int, list[str]]], str | None]:
    """(rows, issue) of a delimited text: (first line, last line, cells); strict about quotes.

    The delimiter is the one under which most of the first 200,000 characters' rows have three cells
    or more, the first of equals.
    """

    def wide(delimiter: str) -> int:
        try:
            return sum(len(r) >= 3 for r in csv.reader(io.StringIO(text[:200_000]), delimiter=delimiter))
        except csv.Error:
            return -1

    delimiter = max(DELIMITERS, key=wide)
    reader, rows, before = csv.reader(io.StringIO(text), delimiter=delimiter, strict=True), [], 0
    try:
        for cells in reader:
            rows.append((before + 1, reader.line_num, cells))
            before = reader.line_num
            if len(rows) > MOST_ROWS or len(cells) > MOST_COLUMNS:
                return [], "TABLE_TOO_LARGE"
    except csv.Error:
        return [], "CSV_SYNTAX"
    return rows, None


def csv_rows(files: DataFrame) -> DataFrame:
    """(path, line, end_line, values, issue): the rows of delimited files; a file that cannot be read
    gives one row with its issue. A file is a task's work at most 50 MiB at a time."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                text = decode(bytes(content))
                rows, issue = ([], "ENCODING_UNKNOWN") if text is None else table_rows(text)
                found = [(path, a, b, v, None) for a, b, v in rows] or [(path, 0, 0, [], issue or "NO_TRANSACTIONS")]
                yield pd.DataFrame(found, columns=["path", "line", "end_line", "values", "issue"])

    return files.select("path", "content").mapInPandas(run, "path string, line int, end_line int, values array<string>, issue string")


#: Versions of a bundle that can be read.
BUNDLE_VERSIONS = ("1.0", "1.1")


def write_bundle(tables: dict[str, DataFrame], folder: str, status: str = "completed") -> None:
    """Each table as Parquet under a folder that must not hold it yet, then the manifest, which says
    that the bundle is whole: rows of each table, version and status."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}")
    spark = next(iter(tables.values())).sparkSession
    counts = [(name, spark.read.schema(df.schema).parquet(f"{folder}/{name}").count()) for name, df in tables.items()]
    manifest = [("schema_version", BUNDLE_VERSIONS[-1]), ("status", status), *[(f"rows:{name}", str(n)) for name, n in counts]]
    spark.createDataFrame(manifest, "key string, value string").coalesce(1).write.mode("errorifexists").json(f"{folder}/manifest")


def load_records(spark: SparkSession, folder: str, ready_only: bool = True, allow_partial: bool = False) -> DataFrame:
    """A whole bundle's records; the status filter reaches the Parquet scan.

    ValueError for a bundle of an unknown version, or with errors unless they are allowed; a bundle
    without a manifest was not written to its end.
    """
    try:
        manifest = {r.key: r.value for r in spark.read.schema("key string, value string").json(f"{folder}/manifest").collect()}
    except AnalysisException as error:
        raise ValueError("the bundle was not written to its end") from error
    if manifest.get("schema_version") not in BUNDLE_VERSIONS:
        raise ValueError("a bundle of an unknown version")
    if manifest.get("status") != "completed" and not allow_partial:
        raise ValueError("a bundle with errors: check it, or allow partial ones")
    records = spark.read.parquet(f"{folder}/records")
    return records.where("parse_status = 'ready'") if ready_only else records


def evidence_file(spark: SparkSession, folder: str, relative: str, assets: DataFrame) -> DataFrame:
    """(path, content) of a bundle's evidence file if its digest is that of assets (path, sha256).

    ValueError for a path that is not one below the bundle's evidence folder.
    """
    parts = relative.split("/")
    if "\\" in relative or ":" in relative or parts[0] != "evidence" or len(parts) < 2 or any(p in ("", ".", "..") for p in parts):
        raise ValueError("evidence is named by a relative path below evidence/")
    found = spark.read.format("binaryFile").load(f"{folder}/{relative}").select(F.lit(relative).alias("path"), "content", F.sha2("content", 256).alias("sha256"))
    return found.join(assets, ["path", "sha256"], "left_semi").select("path", "content")


def export_cells(raw_rows: DataFrame, longest: int = 30_000) -> DataFrame:
    """One row per cell, long cells in numbered parts: the raw-cell sheet of an export."""
    cells = raw_rows.select("path", "line", F.posexplode("values").alias("column", "value"))
    starts = F.sequence(F.lit(1), F.greatest(F.length("value"), F.lit(1)), F.lit(longest))
    parts = cells.select("path", "line", "column", "value", F.posexplode(starts).alias("part", "start"))
    return parts.select("path", "line", "column", "part", F.substring("value", F.col("start"), F.lit(longest)).alias("value"))
