"""Linking without listing a group's pairs, in DataFrame operations only.

A blocking puts items into buckets so that any two items that link share a bucket. The connected
components of the links come out exactly, in two steps:

1. each item is compared with the leader of each of its buckets, its least item, which joins a dense
   group by as many links as it has members; the leader has then met its whole bucket and leaves it;
2. of buckets whose items are in several components, those outside the largest one are compared with
   all, behind a sketch that the join itself checks. A caller may have a pair made in one of its buckets only, and
   give a bound on the items themselves that the join checks as well.

A pair inside one component is never made.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for the nodes of edges (src, dst): component is the least node reachable.

    Alternating stars: each node's greater neighbours move to its least neighbour (large star), then
    the lesser ones do (small star), until nothing changes. Each round is one job with two exchanges, each
    followed by a window over the sorted neighbours of a node, and is written to the shared folder. Its rows
    say whether it found anything but stars, and hold the roots as well, so that the round that finds
    nothing more is the result. Null nodes are not allowed; no edge gives no row.
    """
    edge = lambda src, dst: F.struct(src.alias("src"), dst.alias("dst"))
    src, dst, low, node = F.col("src"), F.col("dst"), F.col("low"), F.col("node")
    current, number = edges, None
    while True:
        around = current.where(src != dst).select(F.explode(F.array(edge(src, dst), edge(dst, src))).alias("e")).select("e.*")
        sorted_around = Window.partitionBy("src").orderBy("dst")
        large = _once(around.withColumn("low", F.least("src", F.first("dst").over(sorted_around))), "dst", sorted_around)
        # A node without a lesser neighbour is a root so far, which its first row tells.
        root = F.col("first") & (src == low)
        moved = F.when(dst > src, F.array(edge(dst, low), edge(low, low)))
        large = large.select(F.explode(F.when(root, moved).otherwise(F.slice(moved, 1, 1))).alias("e"), (src != low).alias("open"))
        lesser = large.select(F.col("e.src").alias("node"), F.col("e.dst").alias("dst"), "open")
        sorted_lesser = Window.partitionBy("node").orderBy("dst", F.desc("open"))
        small = _once(lesser.withColumn("low", F.first("dst").over(sorted_lesser)), "dst", sorted_lesser)
        # The row of the least neighbour is the node's own edge, each other one is the edge of that neighbour.
        current = scratch.save(small.select(F.when(dst == low, node).otherwise(dst).alias("src"), low.alias("dst"), (F.col("open") | (dst != low)).alias("open")))
        if number:
            scratch.drop(number)
        number = scratch.count
        if not current.agg(F.max("open")).first()[0]:
            break
    return current.select(src.alias("node"), dst.alias("component"))


def _once(rows: DataFrame, name: str, window: WindowSpec) -> DataFrame:
    """The rows of a window without those that repeat a value, and whether a row is its window's first."""
    marked = rows.withColumn("before", F.lag(name).over(window))
    return marked.where(F.col("before").isNull() | (F.col("before") != F.col(name))).withColumn("first", F.col("before").isNull()).drop("before")


def link_components(
    keys: DataFrame,
    close: Callable[[Column, Column, Column], Column],
    scratch: Scratch,
    sketches: DataFrame | None = None,
    confirmer: Callable[[DataFrame], Callable[[DataFrame], DataFrame]] | None = None,
    rounds: int = 1,
    known: DataFrame | None = None,
    finer: tuple[Callable[[DataFrame], DataFrame], Callable[[Column, Column], Column]] | None = None,
) -> DataFrame:
    """(node, component) of the items that link with another one.

    keys: (bucket, id), whole numbers; repeated rows count once. close(bucket, a, b) says whether two
    sketches may link; sketches: (id, sketch), rows of one id alike (None: the id is its own sketch).
    confirmer gets the items (id) that share a bucket at all and gives a function that keeps those of
    the candidate pairs (src, dst) that do link (None: all). More rounds of leaders find dense groups
    that no single item links with; the result is the same. known: (node, component) of links found before;
    keys then name each item's component in a column, and buckets inside one component are left out.
    finer, if close says the same in every bucket: what gives items (id) a detail (id, detail), and whether two
    details may link. Step 2 then holds pairs to it too, and makes each in the least bucket that both were in.
    """
    if known is None:
        keys = keys.withColumn("component", F.col("id"))
    # Partial minima come before the shuffle, so that one bucket with very many items is no hot group.
    shared = keys.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("bucket")
    rest = scratch.save(keys.join(scratch.save(shared), "bucket", "left_semi").distinct())
    if sketches is None:
        rest = rest.withColumn("sketch", F.col("id"))
    else:
        needed = scratch.save(rest.select("id").distinct())
        rest = scratch.save(rest.join(sketches.join(needed, "id", "left_semi").dropDuplicates(["id"]), "id"))
    confirm = confirmer(rest.select("id").distinct()) if confirmer else lambda pairs: pairs
    whole = rest
    for _ in range(rounds):
        leaders = rest.groupBy("bucket").agg(F.min(F.struct("id", "sketch", "component")).alias("low"))
        stars = rest.join(leaders, "bucket").where((F.col("component") != F.col("low.component")) & close(F.col("bucket"), F.col("sketch"), F.col("low.sketch")))
        found = confirm(stars.select(F.col("id").alias("src"), F.col("low.id").alias("dst")).distinct())
        known, rest = _contract(known, found, rest.join(leaders.select("bucket", "low.id"), ["bucket", "id"], "left_anti"), scratch)
    # A bucket's largest component is not compared with itself: only what is outside of it meets the bucket.
    sizes = rest.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("largest"))
    rest = scratch.save(rest.join(largest, "bucket"))
    once = (F.col("b.component") == F.col("b.largest")) | (F.col("a.component") < F.col("b.component"))
    apart = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.component") != F.col("b.component")) & once & close(F.col("a.bucket"), F.col("a.sketch"), F.col("b.sketch"))
    if finer:
        # A bucket that both were in and are not now is one component, or one of them led it and has met the other there.
        detail, may = finer
        ids = scratch.save(rest.select("id").distinct())
        own = whole.join(ids, "id", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set("bucket")).alias("own"))
        rest = scratch.save(rest.join(own.join(detail(ids), "id"), "id"))
        apart &= (F.col("a.bucket") == F.array_min(F.array_intersect("a.own", "b.own"))) & may(F.col("a.detail"), F.col("b.detail"))
    left = rest.where("component <> largest").alias("a").join(rest.alias("b"), apart).select(F.col("b.id").alias("src"), F.col("a.id").alias("dst"))
    left = left if finer else left.distinct()
    # Every pair of a bucket is now in one component or has been compared.
    return connected_components(_edges(known).union(confirm(left).select("src", "dst")), scratch)


def _edges(known: DataFrame) -> DataFrame:
    return known.select(F.col("node").alias("src"), F.col("component").alias("dst"))


def _contract(known: DataFrame | None, found: DataFrame, rest: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The components with the links found, and what is left of the buckets."""
    edges = found.select("src", "dst") if known is None else _edges(known).union(found.select("src", "dst"))
    known = connected_components(edges, scratch)
    named = rest.drop("component").join(known.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = scratch.save(named)
    split = named.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("bucket")
    left = scratch.save(named.join(split, "bucket", "left_semi"))
    return known, left
