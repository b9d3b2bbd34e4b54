"""Weak supervision of quality rules, in DataFrame operations only.

Each rule votes good (1), bad (-1) or abstains (0) on a document. The votes are reduced to a
histogram of vote patterns, of at most 3 ** rules rows whatever the corpus. Expectation-maximisation
over the histogram estimates how each rule votes on good and on bad documents; a document is kept
when its posterior probability of being good is at least one half.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, let, words

#: Function words of the four languages, as whole lower-case words.
FUNCTION_WORDS = ("the", "of", "and", "to", "in", "is", "that", "der", "die", "und", "das", "den", "le", "la", "de", "les", "et", "des", "el", "los", "que", "y", "en")

#: Votes: (rule, good if, bad if) over the columns of document_features(). Most rules know a fault and
#: abstain where they do not find it; that a fault is absent says little.
RULES: tuple[tuple[str, str, str], ...] = (
    ("symbols", "false", "n_symbols > 0.2 * n_words"),
    ("symbol_runs", "false", "n_symbols > 0.8 * n_words"),
    ("repeats", "false", "n_repeat_words > 0.3 * n_words"),
    ("capitals", "false", "n_upper > 0.5 * word_chars"),
    ("exclaims", "false", "n_exclaims > 0.2 * n_words"),
    ("dup_lines", "false", "n_dup_lines > 0.3 * n_lines"),
    ("variety", "false", "n_words >= 50 AND n_distinct < 0.2 * n_words"),
    ("function_words", "n_function >= 0.03 * n_words", "n_words >= 20 AND n_function < 0.005 * n_words"),
    ("word_length", "word_chars BETWEEN 2.5 * n_words AND 12 * n_words", "word_chars < 1.5 * n_words OR word_chars > 20 * n_words"),
)
#: The start of expectation-maximisation: how a rule votes on good and on bad documents.
START_PRIOR = 0.8
START_FAULT = {"good": {1: 0.0, 0: 0.98, -1: 0.02}, "bad": {1: 0.0, 0: 0.7, -1: 0.3}}
START_BOTH = {"good": {1: 0.7, 0: 0.28, -1: 0.02}, "bad": {1: 0.4, 0: 0.3, -1: 0.3}}


def _without(text: Column, letters: str) -> Column:
    return F.translate(text, letters, "")


def _repeated_words(ws: Column) -> Column:
    """Words of a list that stand in a window of three words found twice or more in the list.

    Only lists that hold the hash of a window twice are sorted by window, with the exact words.
    """

    def covered(w: Column) -> Column:
        n = F.size(w) - 2
        windows = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)).alias("key"), i.alias("at")))

        def marked(s: Column) -> Column:
            key = lambda i: F.element_at(s, i)["key"]
            found = F.filter(F.sequence(F.lit(1), n), lambda i: ((i > 1) & (key(F.greatest(i - 1, F.lit(1))) == key(i))) | ((i < n) & (key(F.least(i + 1, n)) == key(i))))
            starts = F.transform(found, lambda i: F.element_at(s, i)["at"])
            return let(starts, lambda p: F.size(F.array_distinct(F.concat(p, F.transform(p, lambda x: x + 1), F.transform(p, lambda x: x + 2)))))

        return let(F.array_sort(windows), marked)

    def body(w: Column) -> Column:
        n = F.size(w) - 2
        hashes = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))
        return F.when(n < 2, F.lit(0)).when(F.size(F.array_distinct(hashes)) == n, F.lit(0)).otherwise(covered(w))

    return let(ws, body)


def document_features(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with the counts that the rules use, each column's name behind prefix.

    n_words, word_chars (code points in words), n_symbols, n_lines (lines with a word), n_dup_lines,
    n_repeat_words, n_distinct (distinct words), n_upper, n_exclaims, n_function. A null text has 0
    of everything.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    p = prefix
    listed = docs.withColumn(f"{p}words", words(text)).withColumn(f"{p}lines", F.filter(F.split(text, "\n"), lambda x: F.length(_without(x, " \t\x0b\x0c\r")) > 0))
    ws, lines = F.col(f"{p}words"), F.col(f"{p}lines")
    letters = _without(text, " \t\n\x0b\x0c\r")
    counts = {
        "n_words": F.size(ws),
        "word_chars": F.length(letters),
        "n_symbols": F.length(text) - F.length(_without(text, "#*$%&|<>")),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": _repeated_words(ws),
        "n_distinct": F.size(F.array_distinct(ws)),
        "n_upper": F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", "")),
        "n_exclaims": F.length(text) - F.length(_without(text, "!")),
        "n_function": F.size(F.filter(ws, lambda w: w.isin(*FUNCTION_WORDS))),
    }
    return listed.withColumns({f"{p}{k}": v.cast("long") for k, v in counts.items()}).drop(f"{p}words", f"{p}lines")


def rule_votes(featured: DataFrame, rules=RULES, prefix: str = "") -> DataFrame:
    """featured with one vote column per rule (prefix vote_<rule>): 1, -1, or 0 to abstain."""
    put = lambda rule: F.expr(re.sub(r"\b(n_\w+|word_chars)\b", rf"`{prefix}\1`", rule))
    votes = {f"{prefix}vote_{name}": F.when(F.col(f"{prefix}n_words") == 0, 0).when(put(bad), -1).when(put(good), 1).otherwise(0) for name, good, bad in rules}
    return featured.withColumns(votes)


def _posterior(names: list[str], model: dict) -> Column:
    """P(good | votes) under the model, by Bayes' rule over independent rules."""

    def joint(side: str, prior: float) -> Column:
        total = F.lit(prior)
        for name in names:
            p = model[side][name]
            total = total * F.when(F.col(name) == 1, p[1]).when(F.col(name) == -1, p[-1]).otherwise(p[0])
        return total

    good, bad = joint("good", model["prior"]), joint("bad", 1 - model["prior"])
    return good / (good + bad)


def fit_votes(voted: DataFrame, names: list[str], scratch: Scratch, rules=RULES, rounds: int = 12) -> dict:
    """Expectation-maximisation over the vote patterns of all rows.

    A round is one aggregation of the histogram; its result is one row. Each probability is smoothed
    by one vote of each kind, so an empty table gives a model as well. The sides keep their names
    because good documents start as the more common ones that rules vote good on.
    """
    histogram = scratch.save(voted.groupBy(*names).agg(F.count("*").cast("double").alias("n")))
    first = {n: START_FAULT if rule[1] == "false" else START_BOTH for n, rule in zip(names, rules)}
    model = {"prior": START_PRIOR} | {side: {n: first[n][side] for n in names} for side in ("good", "bad")}
    for _ in range(rounds):
        weighed = histogram.withColumn("g", F.col("n") * _posterior(names, model)).withColumn("b", F.col("n") - F.col("g"))
        sums = [F.sum(side).alias(side) for side in ("g", "b")]
        sums += [F.sum(F.when(F.col(name) == v, F.col(side)).otherwise(0.0)).alias(f"{side}{i}_{v + 1}") for i, name in enumerate(names) for v in (1, 0, -1) for side in ("g", "b")]
        got = {k: v or 0.0 for k, v in weighed.agg(*sums).first().asDict().items()}
        model = {"prior": (got["g"] + 1) / (got["g"] + got["b"] + 2)} | {
            side: {name: {v: (got[f"{s}{i}_{v + 1}"] + 1) / (got[s] + 3) for v in (1, 0, -1)} for i, name in enumerate(names)} for side, s in (("good", "g"), ("bad", "b"))
        }
    return model


def judge_quality(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, prefix: str = "_qr_") -> DataFrame:
    """The columns keep of docs (None: all) with, behind prefix, features, votes, base_failed,
    posterior (double) and kept.

    base_failed: fewer than 50 words, or over half of them in repeated windows of three. kept: not
    base_failed, and posterior >= 0.5. A text without words casts no vote. Null texts count as empty;
    rows that share an id are judged alone; an empty table gives an empty result.
    """
    p = prefix
    scratch = Scratch(docs.sparkSession)
    names = [f"{p}vote_{r[0]}" for r in RULES]
    featured = rule_votes(document_features(docs, text_col, p), prefix=p)
    made = [c for c in featured.columns if c.startswith(p)]
    voted = scratch.save(featured.select(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)], *made))
    model = fit_votes(voted, names, scratch)
    failed = (F.col(f"{p}n_words") < 50) | (100 * F.col(f"{p}n_repeat_words") > 50 * F.col(f"{p}n_words"))
    judged = voted.withColumn(f"{p}base_failed", failed).withColumn(f"{p}posterior", _posterior(names, model))
    return judged.withColumn(f"{p}kept", ~F.col(f"{p}base_failed") & (F.col(f"{p}posterior") >= 0.5))
