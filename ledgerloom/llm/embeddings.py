"""Embedding near-duplicates by collision counting over one-dimensional projections.

A vector is projected on many random directions. In each direction the vectors are sorted, and a
window centred on a query collides with the vectors inside it. A pair at the threshold distance
falls into one window with a known probability, so the number of windows that a true pair shares is
binomial: pairs that share at least the recall-calibrated number are verified by cosine.

So that windows stay short on any corpus, vectors are first dealt into cells by the signs of some
more directions, over enough rounds of cells that a true pair shares one with the same recall. A
pair counts in the first round in which it shares a cell, so no pair has to be deduplicated, and each
cell gives per-vector sums and a spanning star of its links rather than its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import Scratch, binomial_tail
from .linking import connected_components

#: One-dimensional projections, the half-window in units of the threshold distance, and the recall of
#: each of the two filters for a pair just at the threshold.
PROJECTIONS, HALF_WINDOW, RECALL = 24, 1.25, 0.985
#: Vectors wanted in a cell, and the most that one task gets of each of two blocks.
CELL, BLOCK = 512, 1024


def least_collisions(projections: int = PROJECTIONS, half_window: float = HALF_WINDOW, recall: float = RECALL) -> int:
    """The greatest count that a pair at the threshold reaches with the probability recall."""
    p = math.erf(half_window / math.sqrt(2))
    return max(k for k in range(projections + 1) if binomial_tail(projections, p, k) >= recall)


def rounds_of_cells(signs: int, cosine: float, recall: float = RECALL) -> int:
    """Rounds after which a pair at the threshold has shared a cell with the probability recall."""
    same = (1 - math.acos(cosine) / math.pi) ** signs
    return 1 if same >= recall else math.ceil(math.log(1 - recall) / math.log(1 - same))


def _directions(seed: int, dims: int, count: int) -> np.ndarray:
    return np.random.default_rng([seed, dims]).standard_normal((dims, count))


def _window_counts(queries: np.ndarray, others: np.ndarray, width: float) -> np.ndarray:
    """Collisions of each query with each other vector: sorted projections, query-centred windows."""
    counts = np.zeros((len(queries), len(others)), np.uint8)
    for d in range(queries.shape[1]):
        order = np.argsort(others[:, d], kind="stable")
        ranked = others[order, d]
        low = np.searchsorted(ranked, queries[:, d] - width, "left")
        high = np.searchsorted(ranked, queries[:, d] + width, "right")
        for q in range(len(queries)):
            counts[q, order[low[q] : high[q]]] += 1
    return counts


def _star(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node of its component under the links a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new[root]
    return root


def link_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = 0.93,
    seed: int = 7,
) -> DataFrame:
    """Per row: id, n_links (other rows linked directly) and component_id (least id reachable).

    Rows link when labels are equal and not null, lengths are equal and the cosine, in double
    precision, is at least the threshold. Vectors that are null, zero, or hold null or non-finite
    components, and rows without a label, link with nothing. Equal vectors of a label are one item,
    so copies are never paired. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    kind = vectors.schema[id_col].dataType.simpleString()
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("ok", F.coalesce(valid, F.lit(False)))
    # -0.0 and 0.0 are one value to the cosine
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))

    # Equal vectors are found by their values; a saved table's numbers name the items, two hashes find them again.
    both = {"h1": F.xxhash64("label", "v"), "h2": F.xxhash64(F.lit(1), "label", "v")}
    items = scratch.save(rows.where("ok").groupBy("label", "v").agg(F.count("*").alias("copies"), F.min("id").alias("least")).withColumns(both | {"item": F.monotonically_increasing_id()}))
    largest = items.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    signs = max(0, math.ceil(math.log2(max(1, largest) / CELL)))
    rounds = rounds_of_cells(signs, cosine)
    need, width = least_collisions(), HALF_WINDOW * math.sqrt(2 - 2 * cosine)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for n, part in batch.groupby(batch["v"].map(len)):
                x = np.stack(part["v"].to_numpy())
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                above = (x @ _directions(seed, n, max(1, signs * rounds)) >= 0)[:, : signs * rounds].reshape(len(x), rounds, signs)
                cells = (above * (1 << np.arange(signs, dtype=np.int64))).sum(axis=2)
                yield pd.DataFrame({"item": part["item"], "label": part["label"], "dims": n, "copies": part["copies"], "v": list(x), "cells": list(cells)})

    unit = items.select("item", "label", "copies", "v").mapInPandas(deal, "item long, label string, dims int, copies long, v array<double>, cells array<long>")
    unit = scratch.save(unit)
    dealt = unit.select("*", F.posexplode("cells").alias("round", "cell"))
    sizes = unit.select("label", "dims", F.posexplode("cells").alias("round", "cell")).groupBy("label", "dims", "round", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1")
    # A large cell is cut into blocks; each pair of blocks is a group of its own.
    blocks = dealt.join(sizes.drop("n"), ["label", "dims", "round", "cell"]).withColumn("mine", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int"))
    paired = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("low", F.least("mine", "other")).withColumn("high", F.greatest("mine", "other"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        low, high, at = int(group["low"].iat[0]), int(group["high"].iat[0]), int(group["round"].iat[0])
        group = group.sort_values("item", ignore_index=True)
        x, cells = np.stack(group["v"].to_numpy()), np.stack(group["cells"].to_numpy())
        mine, copies, names = group["mine"].to_numpy(), group["copies"].to_numpy(np.int64), group["item"].to_numpy(np.int64)
        shadow = x @ _directions(seed + 1, x.shape[1], PROJECTIONS)
        links, left, right = np.zeros(len(x), np.int64), [], []
        across = low != high
        from_, to = np.flatnonzero(mine == low), np.flatnonzero(mine == high)
        for start in range(0, len(from_), 256):
            q = from_[start : start + 256]
            a, b = np.nonzero(_window_counts(shadow[q], shadow[to], width) >= need)
            a, b = q[a], to[b]
            keep = np.ones(len(a), bool) if across else a < b
            if at:  # counted in an earlier round that shares a cell
                keep &= ~(cells[a, :at] == cells[b, :at]).any(axis=1)
            a, b = a[keep], b[keep]
            close = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
            a, b = a[close], b[close]
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            left.append(a)
            right.append(b)
        root = _star(len(x), np.concatenate(left or [np.zeros(0, np.int64)]), np.concatenate(right or [np.zeros(0, np.int64)]))
        found = links > 0
        return pd.DataFrame({"item": names[found], "links": links[found], "root": names[root[found]]})

    found = paired.select("label", "dims", "round", "cell", "low", "high", "mine", "item", "copies", "v", "cells").groupBy("label", "dims", "round", "cell", "low", "high").applyInPandas(compare, "item long, links long, root long")
    found = scratch.save(found)
    links = found.groupBy("item").agg(F.sum("links").alias("links"))
    components = connected_components(found.select(F.col("item").alias("src"), F.col("root").alias("dst")), scratch)
    named = items.select("item", "h1", "h2", "copies", "least").join(links, "item", "left").join(components.withColumnRenamed("node", "item"), "item", "left").withColumn("component", F.coalesce("component", "item"))
    named = scratch.save(named)
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    final = named.join(least, "component").select("h1", "h2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    final = scratch.save(final)
    keyed = rows.where("ok").withColumns(both).select("id", "h1", "h2")
    # An item with very many copies is split on the copies' side by Spark: final has one row per item.
    out = keyed.join(final, ["h1", "h2"]).select("id", "n_links", "component_id")
    alone = rows.where("NOT ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(alone).select(F.col("id").cast(kind).alias(id_col), "n_links", "component_id")
