"""Language identification by inference over mixtures of languages.

Training counts the character trigrams (within a word and its two borders) of every labelled text by language, in
a fixed number of cells; these counts, a fixed size for each language, are all that reaches the driver and,
as a broadcast, the tasks. A word's likelihood in a language is the product of its trigrams' probabilities.

A document is a mixture: each word with a letter comes from one language, drawn by the document's proportions.
Expectation-maximisation finds the proportions over all languages. The set of languages then grows from the
best single one by the next in proportion, as long as the log-likelihood rises by more than half the
logarithm of the number of words for each language (the Bayesian information criterion). The largest
proportion within the chosen set names the language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import id_back, id_text
from .vocab import chunks

#: Cells of the trigram table of a language; different trigrams may share one.
CELLS = 1 << 15
#: Added to each cell's count.
SMOOTHING = 0.5
#: Numbers that a worker's table of known words holds (words times languages) before it starts anew.
KEPT_NUMBERS = 4_000_000
ROUNDS, CLOSE = 60, 1e-4
UNKNOWN = "und"


def trigram_cells(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(cell, place) of the trigram around each character of lower-case words that single spaces part."""
    codes = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = (codes[:-2] * np.uint64(0x9E3779B1) + codes[1:-1]) * np.uint64(0x85EBCA77) + codes[2:]
    h = (h * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(49)
    place = np.flatnonzero(codes[1:-1] != 32)
    return h[place].astype(np.int64), place


def count_trigrams(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """lang, cells array<struct<cell, n>>: one row per language, at most CELLS cells in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for lang in set(langs):
                own = [" ".join(t.lower().split()) for t, g in zip(texts, langs) if g == lang]
                for a, b in chunks(own):
                    found = np.bincount(trigram_cells(" ".join(own[a:b]))[0], minlength=CELLS)
                    table[lang] = table[lang] + found if lang in table else found
        for lang, found in table.items():
            cell = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cell), pa.string()), pa.array(cell, pa.int64()), pa.array(found[cell], pa.int64())], ["lang", "cell", "n"])

    rows = docs.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "lang string, cell long, n long")
    summed = rows.groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    return summed.groupBy("lang").agg(F.collect_list(F.struct("cell", "n")).alias("cells"))


def fit(docs: DataFrame, text_col: str, lang_col: str) -> tuple[list[str], np.ndarray]:
    """The languages by code point and the log-probability of each cell in each."""
    rows = sorted(count_trigrams(docs.where(F.col(f"`{lang_col}`").isNotNull()), text_col, lang_col).collect(), key=lambda r: r["lang"])
    counts = np.full((CELLS, len(rows)), SMOOTHING)
    for k, row in enumerate(rows):
        at = np.array([(c["cell"], c["n"]) for c in row["cells"]], np.int64).reshape(-1, 2)
        counts[at[:, 0], k] += at[:, 1]
    return [r["lang"] for r in rows], np.log(counts / counts.sum(axis=0)).astype(np.float32)


class Words:
    """Log-likelihoods of words by language, each distinct word scored once while it is known."""

    def __init__(self, log_p: np.ndarray) -> None:
        self.log_p = log_p
        self.most = max(20_000, KEPT_NUMBERS // max(1, log_p.shape[1]))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.scores, self.lettered = np.zeros((0, self.log_p.shape[1]), np.float32), np.zeros(0, bool)

    def places(self, words: list[str]) -> np.ndarray:
        if len(self.known) > self.most:
            self._forget()
        new = list(set(words).difference(self.known))
        if new:
            cells, place = trigram_cells(" ".join(new))
            starts = np.cumsum([0, *(len(w) + 1 for w in new[:-1])])
            firsts = np.searchsorted(place, starts)
            self.scores = np.concatenate([self.scores, np.add.reduceat(self.log_p[cells], firsts, axis=0)])
            self.lettered = np.concatenate([self.lettered, np.array([w.isalpha() or any(map(str.isalpha, w)) for w in new])])
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))


def mixture(score: np.ndarray, times: np.ndarray, owner: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, log-likelihood) of each document over its allowed languages.

    score: log-likelihoods of words by language; times and owner: how often the word stands in which document.
    Each document has a word, and its words are together.
    """
    best = np.where(allowed[owner], score, -np.inf).max(axis=1)
    chance = np.maximum(np.exp(score - best[:, None]), 1e-300)
    shares = allowed / allowed.sum(axis=1, keepdims=True)
    total = np.zeros(len(allowed))
    open_ = np.arange(len(allowed))
    c, t, o, b = chance, times, owner, best
    for step in range(ROUNDS + 1):
        starts = np.flatnonzero(np.append(True, o[1:] != o[:-1]))
        local = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(o))))
        own = shares[open_]
        r = c * own[local]
        s = r.sum(axis=1)
        total[open_] = np.add.reduceat(t * (np.log(s) + b), starts)
        new = np.add.reduceat(r * (t / s)[:, None], starts, axis=0)
        new /= new.sum(axis=1, keepdims=True)
        moving = np.abs(new - own).max(axis=1) > CLOSE
        if step < ROUNDS:
            shares[open_] = new
        if step == ROUNDS or not moving.any():
            break
        if not moving.all():
            keep = moving[local]
            open_, c, t, o, b = open_[moving], c[keep], t[keep], o[keep], b[keep]
    return shares, total


def choose(score: np.ndarray, times: np.ndarray, owner: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(proportions within the chosen set, number of words) of each document; owner covers all of range(n_docs)."""
    n_langs = score.shape[1]
    starts = np.searchsorted(owner, np.arange(n_docs))
    n = np.add.reduceat(times, starts)
    alone = np.add.reduceat(score * times[:, None], starts, axis=0)
    single = alone.argmax(axis=1)
    shares = np.zeros((n_docs, n_langs))
    shares[np.arange(n_docs), single] = 1
    value, price = alone.max(axis=1), np.log(np.maximum(n, 2)) / 2
    full, most = mixture(score, times, owner, np.ones((n_docs, n_langs), bool))
    chosen = shares > 0
    ranked = np.argsort(-np.where(chosen, np.inf, full), axis=1, kind="stable")
    for size in range(2, n_langs + 1):
        # No set does better than all languages together.
        open_ = np.flatnonzero((chosen.sum(axis=1) == size - 1) & (most - price * (size - 1) > value))
        if not len(open_):
            break
        wider = chosen[open_]
        wider[np.arange(len(open_)), ranked[open_, size - 1]] = True
        place = np.full(n_docs, -1)
        place[open_] = np.arange(len(open_))
        own = place[owner] >= 0
        found, reached = mixture(score[own], times[own], place[owner[own]], wider)
        better = reached - price[open_] * (size - 1) > value[open_]
        at = open_[better]
        shares[at], chosen[at], value[at] = found[better], wider[better], (reached - price[open_] * (size - 1))[better]
    return shares, n


def identify_languages(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: id, lang_pred, score, shares map<language, proportion> of the chosen set.

    train: which rows may be learned from (null: not); those without a label are not. Texts without a letter, null
    ones, and all if nothing was learned get UNKNOWN, 0 and an empty map. score is the language's proportion with
    one word's weight spread over all languages, so a word or two never give certainty. Ties go to the language
    that is first by code point. Every row gives one row, also if its id is null or shared.
    """
    spark = docs.sparkSession
    ship(spark)
    langs, log_p = fit(docs.where(train), text_col, lang_col)
    model = spark.sparkContext.broadcast((langs, log_p))

    def one(texts: list[str], words: Words, names: list[str]) -> tuple[list, list, list]:
        split = [t.lower().split() for t in texts]
        at = words.places([w for ws in split for w in ws])
        owner = np.repeat(np.arange(len(texts)), [len(ws) for ws in split])
        both = (owner << 32 | at)[words.lettered[at]]
        both, times = np.unique(both, return_counts=True)
        doc, word = both >> 32, both & 0xFFFFFFFF
        has, owner = np.unique(doc, return_inverse=True)
        pred, score, parts = [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
        if len(has):
            shares, n = choose(words.scores[word].astype(float), times.astype(float), owner, len(has))
            best = shares.argmax(axis=1)
            sure = (shares.max(axis=1) * n + 1 / len(names)) / (n + 1)
            for i, b, s, row in zip(has.tolist(), best.tolist(), sure.tolist(), shares.tolist()):
                pred[i], score[i], parts[i] = names[b], s, [(names[k], x) for k, x in enumerate(row) if x > 0]
        return pred, score, parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, log_p = model.value
        words = Words(log_p)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in chunks(texts, 1_000_000):
                pred, score, parts = one(texts[a:b], words, names) if names else ([UNKNOWN] * (b - a), [0.0] * (b - a), [[]] * (b - a))
                columns = [batch.column("id").slice(a, b - a), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(parts, pa.map_(pa.string(), pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "lang_pred", "score", "shares"])

    found = docs.select(id_text(docs, id_col).alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "id string, lang_pred string, score double, shares map<string, double>")
    return found.select(id_back(docs, id_col, F.col("id")).alias(id_col), "lang_pred", "score", "shares")
