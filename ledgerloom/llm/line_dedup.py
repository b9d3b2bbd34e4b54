"""Fuzzy line dedup, in DataFrame operations only.

Equal normalised lines are one item. Candidates are lines that share a key, are about as long and have
enough of their greatest features in common; they are verified by edit similarity, and one occurrence of
each connected group stays. Lines that quote one passage and are unlike otherwise still meet pair by pair: each pair
once, if its letters leave it a chance.

A line's features are its different pairs of neighbouring words, hashed and sorted. Its keys are runs of hashes
that follow each other in that order, taken as a ring: two lines share one if their features agree
between two points of the ring. Lines of four to seven words have what is left of them without one word
(without two, from six on) as keys as well, which finds every pair that differs in no more words.
This stands for a SimHash, blocks of which find nine of ten similar lines only together with thousands
of unlike ones a line (figures in the README).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, let
from .linking import link_components

#: Hashes in a run for lines of few and of many features; lines between get both.
SHORT, LONG = 2, 3
SHORT_TO, LONG_FROM = 14, 10
#: A line's keys are the runs that start at so many of its least hashes.
RUNS = 12
#: Of the greatest hashes, so many of which are compared, this share of the line with fewer has to be in common.
SKETCHED, LEAST_SHARE = 16, 0.3
#: Rounds of leaders: a quoted passage leads lines together that are unlike it, and the first leader may be one.
LEADERS = 3
#: Characters that are counted each, before pairs that no leader brought together are compared.
LETTERS = " abcdefghijklmnopqrstuvwxyz"
#: Lines of so many words have keys of words left out, two words from the third number on.
FEWEST, MOST, TWO_FROM = 4, 7, 6
#: Lines of so many characters are aligned before they are compared as a whole; words may be shifted by so many
#: places, by a block of so many at the start of a gap; gaps of up to so many characters are compared.
ALIGNED_FROM, SHIFT, BLOCK, EXACT_GAP = 128, 6, 64, 64
#: Longer words, as of scripts without spaces, count as their character trigrams.
LONGEST_WORD = 20


def normalised(line: Column) -> Column:
    """Lower case, with runs of ASCII characters other than letters and digits made one space."""
    return F.trim(F.regexp_replace(F.lower(line), r"[\x00-/:-`{-\x7F]+", " "))


def features(norm: Column) -> Column:
    """The different hashes of a line's pairs of neighbouring words, and of its last word; of long words, character pairs."""

    def pieces(word: Column) -> Column:
        doubles = lambda cs: F.zip_with(F.slice(cs, 1, F.size(cs) - 1), F.slice(cs, 2, F.size(cs) - 1), lambda a, b: F.concat(a, b))
        return F.when(F.length(word) <= LONGEST_WORD, F.array(word)).otherwise(let(F.split(word, ""), doubles))

    words = F.split(norm, " ")
    words = F.when(norm.rlike(f"[^ ]{{{LONGEST_WORD + 1}}}"), F.flatten(F.transform(words, pieces))).otherwise(words)
    pairs = let(words, lambda ws: F.zip_with(ws, F.slice(ws, 2, F.size(ws)), lambda a, b: F.xxhash64(a, b)))
    # Each once: a pair that fills a line would be most of its sketch, and a run of its own.
    return F.array_distinct(pairs)


def runs(hashes: Column, length: int) -> Column:
    """The hash of each run of so many of the least of the sorted hashes; if these are all, they go round."""
    ring = lambda hs: F.concat(hs, F.slice(hs, 1, length - 1))
    starts = F.slice(hashes, 1, RUNS)
    return let(ring(F.slice(hashes, 1, RUNS + length - 1)), lambda hs: F.transform(starts, lambda h, i: F.xxhash64(F.lit(length), h, *[F.get(hs, i + k) for k in range(1, length)])))


def with_words_left_out(words: Column) -> Column:
    """The hash of the line, of the line without each word and, of lines of more words, without each two."""
    n = F.size(words)
    without = lambda i, j: F.array_join(F.filter(words, lambda w, k: (k != i) & (k != j)), " ")
    second = lambda i: F.sequence(F.when(n >= TWO_FROM, i).otherwise(n), n)
    return F.flatten(F.transform(F.sequence(F.lit(0), n), lambda i: F.transform(second(i), lambda j: F.xxhash64(F.lit("words"), without(i, j)))))


def sketched(lines: DataFrame) -> DataFrame:
    """lines (with a column norm) and sketch (struct of the greatest features as bits, and length) and keys."""
    hashed = lines.withColumn("_h", F.sort_array(features(F.col("norm"))))
    few = F.regexp_count("norm", F.lit(" ")).between(FEWEST - 1, MOST - 1) & ~F.col("norm").rlike(f"[^ ]{{{LONGEST_WORD + 1}}}")
    short, long = runs(F.col("_h"), SHORT), runs(F.col("_h"), LONG)
    n = F.size("_h")
    keys = F.when(n < LONG_FROM, short).when(n > SHORT_TO, long).otherwise(F.concat(short, long))
    keys = F.when(F.col("few"), F.concat(keys, let(F.split("norm", " "), with_words_left_out))).otherwise(keys)
    one = F.lit(1).cast("long")
    bit = lambda h: F.call_function("shiftleft", one, h.bitwiseAND(F.lit(63)).cast("int"))
    # The greatest hashes, which say something new of lines that share a run of the least ones.
    # Lines with words left out may differ in most of their features: they have no bits, and are not held to any.
    most = F.when(F.col("few"), F.slice("_h", 1, 0)).otherwise(F.slice("_h", F.greatest(n - SKETCHED + 1, F.lit(1)), SKETCHED))
    bits = lambda half: F.aggregate(F.filter(most, lambda h: h.bitwiseAND(F.lit(64)) == half), one - one, lambda s, h: s.bitwiseOR(bit(h)))
    sketch = F.struct(bits(0).alias("low"), bits(64).alias("high"), F.length("norm").alias("length"))
    return hashed.withColumn("few", few).withColumns({"sketch": sketch, "keys": F.array_distinct(keys)}).drop("_h", "few")


def agree(a: Column, b: Column, similarity: float) -> Column:
    """Whether two sketches have enough features in common and lengths near enough for the similarity."""
    ones = lambda x, y: F.bit_count(x["low"].bitwiseAND(y["low"])) + F.bit_count(x["high"].bitwiseAND(y["high"]))
    near = F.least(a["length"], b["length"]) >= similarity * F.greatest(a["length"], b["length"]) - 1e-9
    return near & (ones(a, b) >= LEAST_SHARE * F.least(ones(a, a), ones(b, b)))


def letters(norm: Column) -> Column:
    """How often a line has each of the letters of LETTERS, and all other characters."""
    counts = [F.length(norm) - F.length(F.replace(norm, F.lit(c), F.lit(""))) for c in LETTERS]
    return F.array(*counts, reduce(Column.__sub__, counts, F.length(norm)))


def within_letters(a: Column, b: Column, least: float) -> Column:
    """Whether two lines have enough letters in common, at any place, for the similarity: a line that is so many
    edits away has all but as many of the letters, so this leaves out no similar pair."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda s, v: s + v)
    longest = F.greatest(total(a), total(b))
    return longest - total(F.zip_with(a, b, lambda p, q: F.least(p, q))) <= F.floor(longest * (1 - least) + 1e-9)


def aligned(a: Column, b: Column, allowed: Column) -> Column:
    """At least the edit distance of two lines, given as their words: what one way of turning one into the other costs.

    The words of a are met in turn: one that stands in b as far from the last pair of equal words as in a is paired
    with it; failing that, one whose next word is the same too, a few places off. What is left between two
    pairs is turned into what is left there of the other line. Once that costs more than allowed or too many words
    have no pair, the rest is one gap.
    """
    pairs = lambda ws: F.zip_with(ws, F.slice(ws, 2, F.size(ws)), lambda v, w: F.xxhash64(v, w))
    # A space after each word of both lines leaves their distance as it is.
    gap = lambda ws, start, end: F.when(end > start, F.concat(F.array_join(F.slice(ws, start + 1, end - start), " "), F.lit(" "))).otherwise("")
    longest = lambda g: F.greatest(F.length(g["p"]), F.length(g["q"]))
    turned = lambda g: F.when(longest(g) <= EXACT_GAP, F.levenshtein(g["p"], g["q"])).otherwise(longest(g))
    state = lambda i, pa, pb, cost: F.struct(i.cast("int").alias("i"), pa.cast("int").alias("a"), pb.cast("int").alias("b"), cost.cast("int").alias("cost"))

    def cost(x: Column, s: Column, i: Column, j: Column) -> Column:
        gaps = F.struct(gap(x["a"], s["a"], i).alias("p"), gap(x["b"], s["b"], j).alias("q"))
        return F.when((i == s["a"]) & (j == s["b"]), s["cost"]).otherwise(s["cost"] + let(gaps, turned))

    def way(x: Column) -> Column:
        def step(s: Column, w: Column) -> Column:
            at = s["b"] + s["i"] - s["a"]
            pair = F.get(x["as"], s["i"])
            # Place by place: a slice would read the whole line.
            places = [at + k for far in range(1, SHIFT + 1) for k in (far, -far)]
            fits = lambda p: F.get(x["bs"], p) == pair
            # A block that only a has ends where b was left; one that only b has is looked for at the start of a gap.
            block = F.when(fits(s["b"]), s["b"]).when(s["i"] <= s["a"] + 1, F.get(F.filter(F.sequence(at + SHIFT + 1, at + BLOCK), fits), 0))
            shifted = F.coalesce(*[F.when((p >= s["b"]) & fits(p), p) for p in places], block)
            j = F.when(F.get(x["b"], at) == w, at).otherwise(shifted).cast("int")
            moved = let(j, lambda j: F.when(j.isNull(), state(s["i"] + 1, s["a"], s["b"], s["cost"])).otherwise(state(s["i"] + 1, s["i"] + 1, j + 1, cost(x, s, s["i"], j))))
            # So many words without a pair are hardly within what is allowed.
            return F.when((s["cost"] > x["allowed"]) | (8 * (s["i"] - s["a"]) > x["allowed"]), s).otherwise(moved)

        none = F.lit(0)
        return F.aggregate(x["a"], state(none, none, none, none), step, lambda s: cost(x, s, F.size(x["a"]), F.size(x["b"])))

    return let(F.struct(a.alias("a"), b.alias("b"), pairs(a).alias("as"), pairs(b).alias("bs"), allowed.alias("allowed")), way)


def similar(a: Column, b: Column, least: float, alike: bool = True) -> Column:
    """Whether 1 - edit distance / greater length is at least so much. alike: most pairs are, so it pays to align long ones.

    Lines with as many words are within the sum of their differing words' lengths of each other; if
    that is too much, or the words are not as many, one way of turning longer lines into each other may be near enough. If
    not, the equal words at either end are taken off, which leaves the edit distance as it is, and the rest is compared.
    """

    def judged(x: Column) -> Column:
        n, m = F.size(x["a"]), F.size(x["b"])
        longest = F.greatest(F.length(a), F.length(b))
        allowed = F.floor(longest * (1 - least) + 1e-9).cast("int")
        gap = lambda p, q: F.when(p == q, 0).otherwise(F.greatest(F.length(p), F.length(q)))
        by_words = F.aggregate(F.zip_with(x["a"], x["b"], gap), F.lit(0), lambda s, v: s + v)

        def rest(y: Column) -> Column:
            middle = lambda ws, k: F.array_join(F.slice(ws, y["head"] + 1, F.greatest(k - y["head"] - y["tail"], F.lit(0))), " ")
            # -1 beyond the limit, which also bounds the work: near copies are within an eighth of it.
            within = lambda z, limit: F.call_function("levenshtein", z["p"], z["q"], limit) >= 0
            middles = F.struct(middle(x["a"], n).alias("p"), middle(x["b"], m).alias("q"))
            return let(middles, lambda z: F.when(within(z, F.floor(allowed / 8).cast("int")), True).otherwise(within(z, allowed)))

        equal = lambda p, q: F.zip_with(p, q, lambda v, w: F.coalesce(v == w, F.lit(False)))
        first = lambda flags: F.coalesce(F.nullif(F.array_position(flags, False), F.lit(0)) - 1, F.least(n, m)).cast("int")
        head = first(equal(x["a"], x["b"]))
        tail = first(equal(F.reverse(x["a"]), F.reverse(x["b"])))
        ends = let(head, lambda h: F.struct(h.alias("head"), F.least(tail, F.least(n, m) - h).alias("tail")))
        near = F.abs(F.length(a) - F.length(b)) <= allowed
        whole = let(ends, rest)
        if alike:
            whole = F.when((longest >= ALIGNED_FROM) & (aligned(x["a"], x["b"], allowed) <= allowed), True).otherwise(whole)
        return F.when(~near, False).when((n == m) & (by_words <= allowed), True).otherwise(whole)

    return let(F.struct(F.split(a, " ").alias("a"), F.split(b, " ").alias("b")), judged)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5, similarity: float = 0.8, min_chars: int = 20) -> DataFrame:
    """docs with repeated lines taken out of text_col, and columns _ld_lines and _ld_removed (long).

    Lines are split at line feeds. Every line with a letter or digit is judged: all for equal lines,
    those with min_words normalised words or min_chars characters for similar ones too. Of a
    group of equal or similar lines, the one with the least (id, text hash, position) stays. A null
    text stays null; a text all of whose lines go becomes empty, its row stays. Rows with equal id
    and text lose the same lines. Lines are equal if two 64-bit hashes are. An empty table gives an
    empty result. Columns named like those made here, id, line or norm, do no harm.
    """
    scratch = Scratch(docs.sparkSession)

    def lines() -> DataFrame:
        # Normalised inside the array, so that the regular expression runs once a line.
        norms = F.transform(F.split(text_col, "\n"), normalised)
        text = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.posexplode(norms).alias("at", "norm"))
        return text.where(F.col("norm") != "").withColumns({"line": F.xxhash64("norm"), "check": F.xxhash64("norm", F.lit(1))})

    long_enough = (F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit(""))) >= min_words - 1) | (F.length("norm") >= min_chars)
    place = F.struct("id", "text_hash", "at")
    judged = sketched(lines().withColumn("fuzzy", long_enough))
    fuzzy = lambda c: F.when(F.col("fuzzy"), F.col(c)).alias(c)
    spots = scratch.save(judged.select("line", "check", place.alias("spot"), fuzzy("sketch"), fuzzy("keys")))

    held: list[DataFrame] = []

    def confirmer(needed: DataFrame):
        needed = scratch.save(needed.withColumnRenamed("id", "line"))
        texts = scratch.save(lines().select("line", "norm").join(needed, "line", "left_semi").dropDuplicates(["line"]))
        held.append(texts)
        named = lambda end: texts.select(F.col("line").alias(end), F.col("norm").alias(f"{end}_norm"))

        # Those of the first leaders are mostly similar, what is left after them mostly not.
        alike = iter([True])

        def confirm(pairs: DataFrame) -> DataFrame:
            both = pairs.join(named("src"), "src").join(named("dst"), "dst")
            return both.where(similar(F.col("src_norm"), F.col("dst_norm"), similarity, next(alike, False))).select("src", "dst")

        return confirm

    keys = spots.where("keys IS NOT NULL").select(F.explode("keys").alias("bucket"), F.col("line").alias("id"))
    sketches = spots.where("keys IS NOT NULL").select(F.col("line").alias("id"), "sketch")
    counted = lambda ids: held[-1].withColumnRenamed("line", "id").join(ids, "id", "left_semi").select("id", letters(F.col("norm")).alias("detail"))
    finer = counted, lambda a, b: within_letters(a, b, similarity)
    linked = link_components(keys, lambda bucket, a, b: agree(a, b, similarity), scratch, sketches, confirmer, LEADERS, None, finer).withColumnRenamed("node", "line")
    places = spots.groupBy("line", "check").agg(F.min("spot").alias("first"), F.count("*").alias("n"))
    # Lines that link with no other are told apart by both hashes.
    own = F.struct(F.coalesce("component", "line").alias("line"), F.when(F.col("component").isNull(), F.col("check")).alias("check"))
    groups = places.join(linked, "line", "left").select("line", "check", own.alias("group"), "first", "n").where("n > 1 OR `group`.check IS NULL")
    groups = scratch.save(groups)
    kept = groups.groupBy("group").agg(F.min("first").alias("kept"))
    repeated = scratch.save(groups.join(kept.withColumnRenamed("group", "_g"), F.col("group").eqNullSafe(F.col("_g"))).select("line", "check", "kept"))
    # A line found very often is split on the occurrences' side by Spark: repeated has one row per line.
    gone = spots.select("line", "check", "spot").join(repeated, ["line", "check"]).where(F.col("spot") != F.col("kept"))
    dropped = gone.select("spot.id", "spot.text_hash", "spot.at").groupBy("id", "text_hash").agg(F.collect_set("at").alias("_ld_at"))
    # Saved, so that Spark knows whether it is small enough to go to the documents.
    dropped = scratch.save(dropped.withColumnsRenamed({"id": "_ld_i", "text_hash": "_ld_h"}))
    scratch.keep(scratch.count)

    d = docs.withColumns({"_ld_id": F.col(id_col), "_ld_hash": F.xxhash64(text_col)})
    joined = d.join(dropped, F.col("_ld_id").eqNullSafe(F.col("_ld_i")) & (F.col("_ld_hash") == F.col("_ld_h")), "left")
    at = lambda xs: F.array_except(F.sequence(F.lit(0), F.size(xs) - 1), F.col("_ld_at"))
    stays = let(F.split(text_col, "\n"), lambda xs: F.transform(at(xs), lambda i: F.get(xs, i)))
    text = F.when(F.col("_ld_at").isNull(), F.col(text_col)).otherwise(F.array_join(stays, "\n"))
    counts = {"_ld_lines": F.when(F.col(text_col).isNull(), 0).otherwise(F.size(F.split(text_col, "\n"))).cast("long"), "_ld_removed": F.when(F.col("_ld_at").isNull(), 0).otherwise(F.size("_ld_at")).cast("long")}
    return joined.withColumns(counts).withColumn(text_col, text).select(*[F.col(f"`{c}`") for c in docs.columns], "_ld_lines", "_ld_removed")
