"""The subpackage's queries, each an operator applied to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align_tokenizers
from .common import WORD, let, table, words
from .embeddings import link_vectors
from .language_mix import identify_languages
from .line_crf import classify_quality
from .line_dedup import dedup_lines
from .lm_scoring import cross_entropy_difference
from .mixing import mix_sources
from .packing import pack_documents
from .quality_rules import judge_quality
from .simhash import simhash_groups
from .site_style_tree import extract_main_text
from .tandem_runs import tandem_runs
from .token_counts import count_section_tokens


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = link_vectors(table(spark, sf_dir, "embeddings"))
    return linked.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    extracted = extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return extracted.select("page_id", "url", F.col("_sst_text").alias("text"), F.length("_sst_text").cast("long").alias("n_chars"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_quality(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select("doc_id", *[F.col(f"_qr_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_section_tokens(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many were removed, and the MD5 of what is left (empty for null)."""
    cleaned = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", F.col("_ld_lines").alias("n_lines"), F.col("_ld_removed").alias("n_removed"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target model is that of the documents labelled as of good quality."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return cross_entropy_difference(table(spark, sf_dir, "documents"), good)


def op9_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    scored = classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    found = identify_languages(docs.select("doc_id", "text", "lang"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth document, by its hash, repeats a part of itself from a word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeat(w):
        n = F.size(w)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        copies = F.ceil((n - a) / p).cast("int")
        return F.array_join(F.slice(F.concat(F.slice(w, 1, a), F.flatten(F.array_repeat(F.slice(w, a + 1, p), copies))), 1, n), " ")

    docs = table(spark, sf_dir, "documents").select("doc_id", F.when((h % 10 == 0) & F.col("text").rlike(WORD), let(words(F.col("text")), repeat)).otherwise(F.col("text")).alias("text"))
    found = tandem_runs(docs)
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))
    found = found.withColumn("longest", F.array_min(order))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    length, period = -F.col("longest.less"), F.col("longest.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("longest.start").alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = align_tokenizers(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=lambda groups: F.sha2(groups, 256))
    digest = F.when(F.col("n_a") > 0, F.col("groups")).otherwise("")
    return aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


QUERIES = {f.__name__: f for f in (op1_embedding_near_dedup, op2_simhash_near_dedup, op3_html_extraction, op4_quality_rules, op5_best_fit_packing, op6_token_counts, op7_line_dedup, op8_lm_scoring, op9_line_crf_quality, op10_source_mixing, op11_language_id, op12_periodic_runs, op13_tokenizer_alignment)}

OP10_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(doc_id::VARCHAR) AS key
  FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS source_rank
  FROM sized GROUP BY source
), lev AS (
  SELECT *, ((source_rank - 1) % 3 + 1)::DOUBLE AS weight, source_size * 3 AS cap FROM src
), lev2 AS (
  SELECT *, row_number() OVER w AS place, (sum(source_size) OVER ())::BIGINT AS total,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS full_before,
    sum(weight) OVER (ORDER BY cap / weight, source_rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
  FROM lev WINDOW w AS (ORDER BY cap / weight, source_rank)
), first AS (
  SELECT place AS f, total - full_before AS left_over, weight_left AS share FROM lev2
  WHERE (total - full_before)::DOUBLE * weight / weight_left <= cap ORDER BY place LIMIT 1
), tgt AS (
  SELECT source, source_rank, source_size, CASE WHEN place < f THEN cap::DOUBLE ELSE left_over::DOUBLE * weight / share END AS target
  FROM lev2, first
), queued AS (
  SELECT d.doc_id, d.source, d.size, t.source_rank, t.source_size, t.target,
    (sum(d.size) OVER (PARTITION BY t.source_rank ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING))::BIGINT AS cum
  FROM sized d JOIN tgt t ON d.source IS NOT DISTINCT FROM t.source
), copies AS (
  SELECT doc_id, size, source_rank, cum, (source_size * e + cum)::DOUBLE / target AS finish
  FROM queued, (SELECT unnest([0, 1, 2]) AS e) WHERE size > 0
), served AS (
  SELECT doc_id, size, sum(size) OVER (ORDER BY finish, source_rank, cum ROWS UNBOUNDED PRECEDING) AS upto FROM copies
), took AS (
  SELECT doc_id, sum(size) AS taken FROM served WHERE upto <= (SELECT sum(size) FROM sized) GROUP BY doc_id
)
SELECT q.doc_id, q.source, q.size, q.source_size, q.target, coalesce(t.taken, 0)::BIGINT AS taken
FROM queued q LEFT JOIN took t USING (doc_id)
"""

ORACLE_SQL = {"op10_source_mixing": OP10_SQL}
