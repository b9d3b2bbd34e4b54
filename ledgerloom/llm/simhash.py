"""SimHash near-duplicates by pigeonring filtering.

Cut 64 bits into five segments on a ring and allow four differing bits: some segment starts a chain
whose first k segments differ in at most k * 4 / 5 bits, rounded down, for every k. The first two
conditions (an equal segment, then one bit at most in the next) are the bucket key; the longer
chains are checked before the full Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import Scratch, id_back, id_text
from .linking import connected_components, link_components

BITS, SEGMENTS, RADIUS = 64, 5, 4
WIDTHS = (13, 13, 13, 13, 12)
STARTS = (0, 13, 26, 39, 52)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) >= shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, n, votes = xxhash.xxh64_intdigest, len(starts), np.zeros(BITS, np.int64)
    for at in range(0, n, 8192):
        hashes = [digest(joined[s:e], 42) for s, e in zip(starts[at : at + 8192].tolist(), ends[at : at + 8192].tolist())]
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8)).reshape(-1, BITS)
        votes += bits.sum(axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch["text"]], np.uint64).astype(np.int64)
            yield pd.DataFrame({"id": batch["id"], "fp": found})

    made = docs.select(id_text(docs, id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id string, fp long")
    return made.select(id_back(docs, id_col, F.col("id")).alias("id"), "fp")


def _shift(x: Column, by) -> Column:
    return F.call_function("shiftrightunsigned", x, by if isinstance(by, Column) else F.lit(by))


def _segment(fp: Column, i: int) -> Column:
    return _shift(fp, STARTS[i]).bitwiseAND(F.lit((1 << WIDTHS[i]) - 1))


def ring_keys(fp: Column) -> Column:
    """The 64 bucket keys of a fingerprint: segment i whole, the next one but for its bit j."""
    keys = []
    for i in range(SEGMENTS):
        after = (i + 1) % SEGMENTS
        for j in range(WIDTHS[after]):
            rest = _segment(fp, after).bitwiseAND(F.lit((1 << 13) - 1 - (1 << j)))
            keys.append(F.lit((i * 16 + j) << 26).bitwiseOR(F.shiftleft(_segment(fp, i), 13)).bitwiseOR(rest))
    return F.array(*keys)


def leader_links(distinct: DataFrame) -> DataFrame:
    """(src, dst): the links of fingerprints (fp) to the least one with which they have two equal segments.

    They join most of a dense group, whose members then need not meet in each of their 64 buckets.
    """
    pairs = [(i, j) for i in range(SEGMENTS) for j in range(i)]
    fp = F.col("fp")
    keys = [F.lit(k << 26).bitwiseOR(F.shiftleft(_segment(fp, i), 13)).bitwiseOR(_segment(fp, j)) for k, (i, j) in enumerate(pairs)]
    named = distinct.select("fp", F.explode(F.array(*keys)).alias("bucket"))
    leaders = named.groupBy("bucket").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").select("bucket", "low")
    near = (fp != F.col("low")) & (F.bit_count(fp.bitwiseXOR(F.col("low"))) <= RADIUS)
    return named.join(leaders, "bucket").where(near).select(fp.alias("src"), F.col("low").alias("dst")).distinct()


def in_chain(bucket: Column, a: Column, b: Column) -> Column:
    """Whether the chain that starts at the bucket's segment holds all the way round."""
    x = a.bitwiseXOR(b)
    first = F.shiftright(bucket, 30)
    held = None
    for i in range(SEGMENTS):
        mask, checks = 0, F.lit(True)
        for k in range(1, SEGMENTS + 1):
            at = (i + k - 1) % SEGMENTS
            mask |= ((1 << WIDTHS[at]) - 1) << STARTS[at]
            signed = mask - (1 << 64) if mask >> 63 else mask
            checks = checks & (F.bit_count(x.bitwiseAND(F.lit(signed))) <= k * RADIUS // SEGMENTS)
        held = F.when(first == i, checks) if held is None else held.when(first == i, checks)
    return held


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """Per row: id, fp (signed long) and component_id, the least id among the documents that its
    fingerprint reaches by links of at most four differing bits, itself included.

    Null, empty and blank texts have fingerprint 0 and link like others. Equal fingerprints are one
    item, so exact copies are never paired. A null id takes part and is never the least unless all
    are null. An empty table gives an empty result. All words of a text count, however long it is.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    found = scratch.save(fingerprints(docs, id_col, text_col, shingle))
    prints = scratch.count
    distinct = scratch.save(found.groupBy("fp").agg(F.min("id").alias("least")))
    known = connected_components(leader_links(distinct), scratch)
    placed = distinct.join(known.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    keys = placed.select(F.explode(ring_keys(F.col("fp"))).alias("bucket"), F.col("fp").alias("id"), "component")
    linked = link_components(keys, in_chain, scratch, known=known)
    group = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    group = scratch.save(group)
    least = group.groupBy("component").agg(F.min("least").alias("component_id"))
    # One row per fingerprint: a fingerprint with very many documents is split on their side by Spark.
    named = scratch.save(group.join(least, "component").select("fp", "component_id"))
    scratch.keep(prints, scratch.count)
    return found.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")
