"""What the second reading of the findings of round 3 asked for, on small tables."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerloom.llm import alignment, common, line_dedup, linking


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_lines_that_quote_a_passage_meet_once_and_only_if_their_letters_allow(spark, monkeypatch):
    rng = random.Random(11)
    word = lambda letters: "".join(rng.choices(letters, k=6))
    passage = [word("bcdfghkl") for _ in range(24)]
    heads = ["aeiou", "mnpqr", "stvwx", "éüßçñ"]
    lines = [" ".join([*[word(heads[k % 4]) for _ in range(8)], *passage]) for k in range(48)]
    hashes = {r.h: r.s for r in spark.createDataFrame([(s,) for s in lines], "s string").select("s", F.xxhash64("s").alias("h")).collect()}
    compared = []

    def counted(keys, close, scratch, sketches, confirmer, *rest):
        def counting(needed):
            confirm = confirmer(needed)

            def seen(pairs):
                compared.append([(r.src, r.dst) for r in pairs.collect()])
                return confirm(pairs)

            return seen

        return linking.link_components(keys, close, scratch, sketches, counting, *rest)

    monkeypatch.setattr(line_dedup, "link_components", counted)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.doc_id: r._ld_removed for r in line_dedup.dedup_lines(docs).collect()}

    # Without the bound, which is the last argument, the same lines go.
    monkeypatch.setattr(line_dedup, "link_components", lambda *args: linking.link_components(*args[:6]))
    assert got == {r.doc_id: r._ld_removed for r in line_dedup.dedup_lines(docs).collect()} and sum(got.values()) > 3
    last = [tuple(sorted(p)) for p in compared[-1]]
    assert last and len(last) == len(set(last))
    # Heads of unlike letters are 48 edits and more apart, 39 are allowed: no such pair is compared.
    kind = lambda h: next(k for k, x in enumerate(heads) if hashes[h][0] in x)
    assert all(kind(a) == kind(b) for a, b in last)



def test_letters_leave_out_no_similar_pair(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(300):
        a = "".join(rng.choices("abc déü", k=rng.randint(1, 40)))
        b = list(a)
        for _ in range(rng.randint(0, 10)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = rng.choices(["", "x", "é"])
        rows.append((a, "".join(b)))
    judged = spark.createDataFrame(rows, "a string, b string").select("a", "b", line_dedup.within_letters(line_dedup.letters(F.col("a")), line_dedup.letters(F.col("b")), 0.8).alias("may"))
    got = judged.collect()
    near = [r.may for r in got if distance(r.a, r.b) <= int(0.2 * max(len(r.a), len(r.b)) + 1e-9)]
    assert all(near) and len(near) > 50 and not all(r.may for r in got)


def test_group_texts_of_a_batch_are_those_of_each_text():
    a = np.array([2, 0, 3]), np.array([7, 5, 1, 2, 3], np.int32), np.array([2, 4, 1, 2, 5])
    b = np.array([2, 0, 2]), np.array([9, 8, 4, 6], np.int32), np.array([3, 4, 2, 5])
    *lasts, _ = alignment.overlaps(a, b, 4)
    texts = pa.array([f"{i}{c}" for end in ("|", "") for i in range(10) for c in (",", end)])
    assert alignment.group_texts(a, b, lasts, texts, 20).to_pylist() == ["7,5|9,8", "1,2|4", "3|6"]
    none = np.array([0, 0]), np.array([], np.int32), np.array([], np.int32)
    assert alignment.group_texts(none, none, alignment.overlaps(none, none, 4)[:2], texts, 20).to_pylist() == []


def test_components_of_stars_take_one_round_and_two_exchanges(spark, monkeypatch):
    plans = []

    def planned(self, df, *rest):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return save(self, df, *rest)

    save = common.Scratch.save
    monkeypatch.setattr(common.Scratch, "save", planned)
    star = [(0, k) for k in range(1, 200)] + [(k, 500) for k in range(501, 600)] + [(k, 500) for k in range(501, 600)]
    got = linking.connected_components(spark.createDataFrame(star, "src long, dst long"), common.Scratch(spark))
    assert sorted(map(tuple, got.collect())) == [*((k, 0) for k in range(200)), *((k, 500) for k in range(500, 600))]
    # What every round costs is its exchanges, whatever the size: these are stars, so one round says so.
    assert len(plans) == 1 and plans[0].count("Exchange") == 2


def test_components_that_repeat_edges_and_chain_are_found_whole(spark):
    rng = random.Random(4)
    chain = rng.sample(range(-300, 300), 400)
    hubs = [(h, k) for k in range(1000, 1200) for h in (900, 901, 902)]
    edges = [*zip(chain, chain[1:]), *hubs, *hubs, (2000, 2000)]
    got = linking.connected_components(spark.createDataFrame(edges, "src long, dst long"), common.Scratch(spark))
    want = {**dict.fromkeys(chain, min(chain)), **dict.fromkeys([900, 901, 902, *range(1000, 1200)], 900)}
    assert sorted(map(tuple, got.collect())) == sorted(want.items())


def test_aligned_lines_cost_at_least_their_distance_and_near_copies_little_more(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 7)))
    rows = []
    for k in range(160):
        a = [word() for _ in range(rng.randint(24, 60))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(b))
            b[at : at + rng.choice([0, 1, 2])] = [word() for _ in range(rng.choice([0, 1, 1]))]
        if k % 4 == 1:  # a block of words that only one of the two has
            b[5:5] = [word() for _ in range(4)]
            del b[20:23]
        if k % 4 == 2:  # one passage, unlike otherwise
            b = [word() for _ in range(10)] + a[8:20] + [word() for _ in range(10)]
        rows.append((" ".join(a), " ".join(b), k % 4 == 2))
    longest = F.greatest(F.length("a"), F.length("b"))
    allowed = F.floor(longest * 0.2 + 1e-9).cast("int")
    frame = spark.createDataFrame(rows, "a string, b string, unlike boolean")
    words = [F.split(c, " ") for c in ("a", "b")]
    both = [line_dedup.similar(F.col("a"), F.col("b"), 0.8, alike).alias(n) for n, alike in (("alike", True), ("whole", False))]
    got = frame.select("a", "b", "unlike", allowed.alias("allowed"), line_dedup.aligned(*words, allowed).alias("cost"), *both).collect()
    found = 0
    for r in got:
        d = distance(r.a, r.b)
        assert r.cost >= d and r.alike == r.whole == (d <= r.allowed), (r.a, r.b)
        found += r.cost <= r.allowed
    # Aligning alone finds nearly all that are similar, without comparing the lines as a whole.
    assert found >= 0.9 * sum(r.whole for r in got) > 80
