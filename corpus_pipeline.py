"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's input.

quality rules -> line dedup -> SimHash near-dedup -> mixing sources -> best-fit packing. All stages
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import Scratch
from ledgerloom.llm.line_dedup import dedup_lines
from ledgerloom.llm.mixing import mix_sources
from ledgerloom.llm.packing import pack_documents
from ledgerloom.llm.quality_rules import judge_quality
from ledgerloom.llm.simhash import simhash_groups


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or whose posterior quality is below one half go."""
    return judge_quality(docs).where("_qr_kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document that loses all its lines stays as an empty one."""
    cleaned = dedup_lines(docs)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*[F.col(f"`{c}`") for c in docs.columns])


def with_rows(docs: DataFrame, name: str) -> DataFrame:
    """docs, saved, with a number of its own for each row: ids may be null or shared."""
    return Scratch(docs.sparkSession).save(docs.withColumn(name, F.monotonically_increasing_id()))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one row stays: the least doc_id, null last, then text hash."""
    rows = with_rows(docs, "_sd_row")
    groups = simhash_groups(rows, "_sd_row").select("_sd_row", "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "_sd_row")
    least = rows.select("_sd_row", order.alias("place")).join(groups, "_sd_row").groupBy("component_id").agg(F.min("place").alias("place"))
    return rows.join(least.select("place._sd_row"), "_sd_row", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes: none to three."""
    rows = with_rows(docs, "_mx_row")
    taken = mix_sources(rows, row_col="_mx_row").where("taken > 0").select("_mx_row", (F.col("taken") / F.col("size")).cast("int").alias("_mx_copies"))
    joined = rows.join(taken, "_mx_row").withColumn("_mx_copy", F.explode(F.sequence(F.lit(1), F.col("_mx_copies"))))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 4096 tokens."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: The fingerprints, the sketches of lines and the tokenizer have no SQL equivalent.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed corpus that starts as documents."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
