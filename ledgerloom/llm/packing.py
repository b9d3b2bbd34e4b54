"""Best-fit-decreasing packing of token pieces into sequences of a fixed capacity.

Best fit looks only at lengths. The corpus is therefore reduced to a histogram of piece lengths, at
most one entry per length up to the capacity whatever the number of documents, and packed by runs:
equal pieces that go into equally filled bins are placed together. A segment tree over remaining
capacities finds the tightest open bins. The plan says where the k-th piece of a length goes; pieces
are ranked in their length by a distributed prefix sum and join the plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..shipping import ship
from .common import Scratch, id_back, id_text
from .vocab import chunks, encoder, word_bpe

#: Ranges over which the pieces of one length are ranked.
RANK_RANGES = 256


class CapacityTree:
    """Which remaining capacities have open bins: the least one that is at least a given length."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)

    def set(self, at: int, value: bool) -> None:
        at += self.size
        while at and self.any[at] != value:
            self.any[at] = value
            at //= 2
            value = bool(at) and (self.any[2 * at] or self.any[2 * at + 1])

    def least(self, length: int) -> int | None:
        at = length + self.size
        if self.any[at]:
            return length
        while at > 1:  # up until a right neighbour has open bins
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def best_fit_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first bin, pieces a bin, offset in the bin), longest first.

    Just as best fit decreasing, one piece at a time, would place them: a bin that stays the tightest
    one takes further pieces of the length before the next bin does.
    """
    tree, open_bins, runs, bins = CapacityTree(capacity), {}, [], 0

    def put(room: int, start: int, count: int) -> None:
        if count and room:
            if not open_bins.get(room):
                open_bins[room] = []
                tree.set(room, True)
            open_bins[room].append((start, count))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.least(length)
            if room is None:
                room, start, count = capacity, bins, -(-left // (capacity // length))
                bins += count
            else:
                start, count = open_bins[room].pop()
                if not open_bins[room]:
                    tree.set(room, False)
            each = room // length
            used = min(count, -(-left // each))
            put(room, start + used, count - used)
            pieces = min(left, used * each)
            runs.append((length, rank, pieces, start, each, capacity - room))
            short = used * each - pieces  # the last bin of the run may take fewer
            put(room - each * length, start, used - (short > 0))
            if short:
                put(room - (each - short) * length, start + used - 1, 1)
            rank, left = rank + pieces, left - pieces
    return runs


def token_pieces(docs: DataFrame, capacity: int, id_col: str, text_col: str, tokenizer: str, end_id: int, keep_ids: bool) -> DataFrame:
    """Encode each whole document once, end it with end_id, cut it at multiples of the capacity."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = encoder(tokenizer)
        for batch in batches:
            texts = ["" if t is None else t for t in batch["text"]]
            names = batch["id"].to_numpy()
            for first, end in chunks(texts):
                rows = []
                for name, ids in zip(names[first:end], codec.batch(texts[first:end])):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        rows.append((name, piece, start, len(part), zlib.crc32(part.tobytes()), *([part.astype(np.int64)] * keep_ids)))
                out = pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids])
                yield out

    schema = "id string, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * keep_ids
    return docs.select(id_text(docs, id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(encode, schema)


def pack_documents(
    docs: DataFrame,
    capacity: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = 1,
    keep_ids: bool = False,
) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if kept).

    A null or empty text is the end token alone. A longer text than the capacity gives pieces of just
    the capacity and a last one that may be shorter. Rows that share an id are documents of their own,
    told apart by nothing in the result. Pieces of a length are ranked by a hash of the row, so reruns
    agree up to the order of equal rows. An empty table gives an empty result. tokenizer is the path
    of a vocabulary file that every executor has.
    """
    spark = docs.sparkSession
    ship(spark)
    pieces = Scratch(spark).save(token_pieces(docs, capacity, id_col, text_col, tokenizer or word_bpe(), end_id, keep_ids))
    pieces = pieces.withColumn("range", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(RANK_RANGES)).cast("int"))
    counts = pieces.groupBy("length", "range").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    runs = spark.createDataFrame(best_fit_plan(histogram, capacity), "length long, first_rank long, n_run long, first_bin long, each long, base long")

    earlier = Window.partitionBy("length").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    local = Window.partitionBy("length", "range").orderBy("id", "piece", "ids_crc32")
    ranked = pieces.join(before, ["length", "range"]).withColumn("rank", F.col("before") + F.row_number().over(local) - 1)
    nth = F.col("rank") - F.col("first_rank")
    placed = ranked.join(runs, "length").where((nth >= 0) & (nth < F.col("n_run")))
    return placed.select(
        id_back(docs, id_col, F.col("id")).alias(id_col),
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("first_bin") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("base") + nth % F.col("each") * F.col("length")).cast("long").alias("offset"),
        *["ids"] * keep_ids,
    )
