"""What the findings of round 3 asked for, on small tables."""

from __future__ import annotations

import os
import random

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import alignment, line_dedup, linking, simhash
from ledgerloom.llm.common import Scratch


def test_line_dedup_links_a_dense_group_behind_an_unlike_leader(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("bcdfghklmnprst", k=6))
    passage = [word() for _ in range(30)]
    alike = [" ".join([*passage, *[word() for _ in range(4)]]) for _ in range(24)]
    unlike = [" ".join([*passage[:18], *[word() for _ in range(16)]]) for _ in range(300)]
    hashes = {r.s: r.h for r in spark.createDataFrame([(s,) for s in alike + unlike], "s string").select("s", F.xxhash64("s").alias("h")).collect()}
    first = min(unlike, key=hashes.get)
    assert hashes[first] < min(map(hashes.get, alike))
    compared = []

    def counted(keys, close, scratch, sketches, confirmer, *rest):
        def counting(needed):
            confirm = confirmer(needed)
            return lambda pairs: compared.append(pairs.count()) or confirm(pairs)

        return linking.link_components(keys, close, scratch, sketches, counting, *rest)

    folders = []
    monkeypatch.setattr(line_dedup, "link_components", counted)
    monkeypatch.setattr(line_dedup, "Scratch", lambda s: folders.append(Scratch(s)) or folders[-1])
    docs = spark.createDataFrame([(i, s) for i, s in enumerate([first, *alike])], "doc_id long, text string")
    got = {r.doc_id: r._ld_removed for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {0: 0, 1: 0, **dict.fromkeys(range(2, 25), 1)}
    # Not the 276 pairs of the group: a leader that is unlike costs one comparison with each.
    assert sum(compared) < 5 * len(alike)
    # Only what the result reads is left in the shared folder.
    assert len(os.listdir(folders[0].root.removeprefix("file://"))) == 1


def test_simhash_groups_do_not_meet_in_their_buckets(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 1 << 63))
    prints = [base, *{base ^ (1 << int(i)) ^ (1 << int(j)) for i, j in rng.choice(63, (120, 2)) if i != j}]
    far = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    frame = spark.createDataFrame([(p, p) for p in prints + far], "id long, fp long")
    kept = []

    def counted(keys, close, scratch, *rest, **named):
        split = keys.groupBy("bucket").agg(F.countDistinct("component").alias("n")).where("n > 1")
        kept.append(keys.join(split, "bucket", "left_semi").count())
        return linking.link_components(keys, close, scratch, *rest, **named)

    monkeypatch.setattr(simhash, "fingerprints", lambda *_: frame)
    monkeypatch.setattr(simhash, "link_components", counted)
    docs = spark.createDataFrame([(0, "")], "doc_id long, text string")
    got = {r.fp: r.component_id for r in simhash.simhash_groups(docs).collect()}
    assert got == {**dict.fromkeys(prints, min(prints)), **{p: p for p in far}}
    # All but a few of some 6,000 rows of the group's buckets are in one component before.
    assert kept[0] < 600


def test_overlaps_of_a_batch_are_those_of_each_text():
    a = np.array([2, 0, 3]), np.array([7, 5, 1, 2, 3]), np.array([2, 4, 1, 2, 5])
    b = np.array([2, 0, 2]), np.array([9, 8, 4, 6]), np.array([3, 4, 2, 5])
    (n, last_a), (_, last_b), (n_links, links) = alignment.overlaps(a, b, 4)
    assert n.tolist() == [1, 0, 2] and last_a.tolist() == [1, 1, 2] and last_b.tolist() == [1, 0, 1]
    assert n_links.tolist() == [3, 0, 3]
    assert links.tolist() == [5 << 4 | 8, 5 << 4 | 9, 7 << 4 | 9, 1 << 4 | 4, 2 << 4 | 4, 3 << 4 | 6]
