"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad; its features are its own, its neighbours' and a few of the whole document.
The field is trained on a bounded sample of labelled documents whose lines inherit the label. A
document's score is the mean of its lines' forward-backward marginals, weighted by line length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import id_back, id_text
from .quality_rules import FUNCTION_WORDS

_FUNCTION = frozenset(FUNCTION_WORDS)
_SYMBOLS = str.maketrans("", "", "#*$%&|<>@^~=+{}[]\\_")
#: Features of a line, then of the document.
OWN, WHOLE = 12, 4
#: Lines, padding counted, that are scored together unless one document alone has more.
MOST_CELLS = 200_000


def line_parts(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines x own features, features of the whole, characters of each line) of a whole text.

    A text has one line at least. All lines are read, however many they are.
    """
    lines = text.split("\n")
    own = np.zeros((len(lines), OWN))
    seen: dict[str, int] = {}
    total, distinct, again = 0, set(), 0
    for i, line in enumerate(lines):
        ws = line.split()
        n = len(ws)
        total += n
        unique = set(ws)
        distinct |= unique
        if n:
            again += line in seen
            seen[line] = 1
        k = max(n, 1)
        own[i] = (
            np.log1p(len(line)),
            np.log1p(n),
            min((len(line) - len(line.translate(_SYMBOLS))) / k, 4),
            sum(map(str.isupper, ws)) / k,
            min(line.count("!") / k, 3),
            line.count("|") / k,
            min(sum(map(len, ws)) / k, 30) / 10,
            len(unique) / k,
            sum(map(eq, ws, ws[1:])) / k,
            sum(map(_FUNCTION.__contains__, ws)) / k,
            sum(map(str.isdigit, ws)) / k,
            line.rstrip()[-1:] in (".", "?", ":", '"'),
        )
    whole = np.array([len(distinct) / max(total, 1), again / len(lines), np.log1p(total), np.log1p(len(lines))])
    return own, whole, np.array([max(len(line), 1) for line in lines], np.float64)


def line_features(text: str) -> np.ndarray:
    """Lines x features: a line's own, those of the line before and after it, the whole's, and one."""
    own, whole, _ = line_parts(text)
    pad = np.zeros((1, OWN))
    return np.concatenate([own, np.concatenate([pad, own[:-1]]), np.concatenate([own[1:], pad]), np.repeat(whole[None], len(own), 0), np.ones((len(own), 1))], axis=1)


@dataclass
class LineField:
    """A trained field: standardisation, weights of the two states, transitions."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    moves: np.ndarray

    def unary(self, own: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """The lines' scores of the two states, without a table of all features in memory."""
        pull = self.weights / self.scale[:, None]
        mine, before, after, of_all = pull[:OWN], pull[OWN : 2 * OWN], pull[2 * OWN : 3 * OWN], pull[3 * OWN : 3 * OWN + WHOLE]
        out = own @ mine + (whole @ of_all + pull[-1] - self.mean @ pull)
        out[1:] += own[:-1] @ before
        out[:-1] += own[1:] @ after
        return out


def _messages(unary: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log messages of padded sequences (documents x lines x 2)."""
    n, longest, _ = unary.shape
    forward, backward = np.zeros_like(unary), np.zeros_like(unary)
    forward[:, 0] = unary[:, 0]
    for t in range(1, longest):
        step = forward[:, t - 1, :, None] + moves
        forward[:, t] = np.logaddexp(step[:, 0], step[:, 1]) + unary[:, t]
    for t in range(longest - 2, -1, -1):
        step = moves + (unary[:, t + 1] + backward[:, t + 1])[:, None, :]
        backward[:, t] = np.where((t + 1 < lengths)[:, None], np.logaddexp(step[:, :, 0], step[:, :, 1]), 0)
    return forward, backward


def marginals(unary: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """P(line good) of padded sequences; what stands behind a sequence's end means nothing."""
    forward, backward = _messages(unary, lengths, moves)
    return 1 / (1 + np.exp(np.clip((forward + backward)[:, :, 0] - (forward + backward)[:, :, 1], -50, 50)))


def _padded(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for p in parts])
    out = np.zeros((len(parts), int(lengths.max()), parts[0].shape[1]))
    for row, p in zip(out, parts):
        row[: len(p)] = p
    return out, lengths


def train(features: list[np.ndarray], labels: list[int], steps: int = 120, rate: float = 0.1, decay: float = 1e-3) -> LineField:
    """Maximum likelihood with weight decay by Adam; the two labels weigh the same."""
    flat = np.concatenate(features) if features else np.zeros((0, 3 * OWN + WHOLE + 1))
    mean, scale = (flat.mean(0), flat.std(0)) if len(flat) else (np.zeros(flat.shape[1]), np.ones(flat.shape[1]))
    mean[-1], scale[-1] = 0, 1
    field = LineField(mean, np.where(scale < 1e-6, 1, scale), np.zeros((flat.shape[1], 2)), np.zeros((2, 2)))
    if len(set(labels)) < 2:
        field.weights[-1, 1] = 4.0 * (labels[0] if labels else 0.5) - 2.0  # one label, or none, is all that is known
        return field
    order = sorted(range(len(features)), key=lambda i: len(features[i]))
    share = {y: 0.5 / labels.count(y) for y in (0, 1)}
    groups = []
    for start in range(0, len(order), 256):
        rows = order[start : start + 256]
        x, lengths = _padded([(features[i] - field.mean) / field.scale for i in rows])
        y = np.array([labels[i] for i in rows])
        mask = np.arange(x.shape[1]) < lengths[:, None]
        groups.append((x, lengths, y, mask, np.array([share[v] for v in y]) / lengths))
    params = [field.weights, field.moves]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        grads = [decay * p for p in params]
        for x, lengths, y, mask, weight in groups:
            unary = x @ field.weights
            forward, backward = _messages(unary, lengths, field.moves)
            both = forward + backward
            good = 1 / (1 + np.exp(np.clip(both[:, :, 0] - both[:, :, 1], -50, 50)))
            gap = (good - y[:, None]) * mask * weight[:, None]
            pull = np.einsum("nld,nl->d", x, gap)
            grads[0] += np.stack([-pull, pull], axis=1)
            pair = forward[:, :-1, :, None] + field.moves + (unary[:, 1:] + backward[:, 1:])[:, :, None, :]
            if pair.shape[1]:
                peak = pair.max(axis=(2, 3), keepdims=True)
                p = np.exp(pair - peak)
                p /= p.sum(axis=(2, 3), keepdims=True)
                w = mask[:, 1:] * weight[:, None]
                grads[1] += np.einsum("nlab,nl->ab", p, w)
                for v in (0, 1):
                    grads[1][v, v] -= (w * (y == v)[:, None]).sum()
        for p, g, m, v in zip(params, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return field


def document_scores(field: LineField, texts: list[str]) -> np.ndarray:
    """Length-weighted mean marginal of each whole text."""
    scores = np.zeros(len(texts))
    start = 0
    while start < len(texts):
        parts, weights, size = [], [], 0
        end = start
        while end < len(texts) and size < 2_000_000:
            own, whole, chars = line_parts(texts[end])
            parts.append(field.unary(own, whole))
            weights.append(chars)
            size += len(texts[end])
            end += 1
        order = sorted(range(len(parts)), key=lambda i: len(parts[i]))
        at = 0
        while at < len(order):
            # Padding makes each document as long as the longest of its group, so long ones go alone.
            stop = at + 1
            while stop < len(order) and stop - at < 128 and (stop + 1 - at) * len(parts[order[stop]]) <= MOST_CELLS:
                stop += 1
            rows = order[at:stop]
            at = stop
            padded, lengths = _padded([parts[i] for i in rows])
            good = marginals(padded, lengths, field.moves)
            for i, g in zip(rows, good):
                scores[start + i] = float(np.average(g[: len(weights[i])], weights=weights[i]))
        start = end
    return scores


def fit_field(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = 1000, most_lines: int = 2000) -> LineField:
    """Train on at most per_label documents of each label (the bound of the sample).

    They are those with the least md5(id) among the labelled rows that are usable; documents of more
    than most_lines lines are left out of the sample. Executors make the features; 2 * per_label *
    most_lines feature rows bound what the driver holds. Null or other labels than 0 and 1 are ignored.
    """
    known = labels.where(usable & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_crf_id"), F.col(label_col).cast("int").alias("_crf_label"))
    key = F.md5(F.col("_crf_id").cast("string"))
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("_crf_label") == y).distinct().orderBy(key, "_crf_id").limit(per_label)
        chosen = part if chosen is None else chosen.union(part)
    # at most 2 * per_label rows of two numbers: small by the parameter
    sample = docs.select(F.col(id_col).alias("_crf_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_crf_id")
    sample = sample.where(F.size(F.split(F.coalesce("text", F.lit("")), "\n")) <= most_lines)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [line_features("" if t is None else t) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["_crf_id"].astype(str), "label": batch["_crf_label"], "lines": [len(x) for x in made], "x": [x.astype("<f4").tobytes() for x in made]})

    rows = sample.mapInPandas(features, "id string, label int, lines int, x binary").collect()
    rows.sort(key=lambda r: (r.id, r.label, r.x))
    return train([np.frombuffer(r.x, "<f4").reshape(r.lines, -1).astype(np.float64) for r in rows], [r.label for r in rows])


def score_documents(docs: DataFrame, field: LineField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and score in 0..1. A null text is an empty one, which is a single empty line."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "score": document_scores(field, ["" if t is None else t for t in batch["text"]])})

    scored = docs.select(id_text(docs, id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id string, score double")
    return scored.select(id_back(docs, id_col, F.col("id")).alias(id_col), "score")


def classify_quality(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Per row of docs: id, score, predicted (1 if score >= 0.5). Only rows of labels that are usable
    train; without any the score is 0.5. Rows that share an id are scored alone; an empty table gives
    an empty result."""
    ship(docs.sparkSession)
    field = fit_field(docs, labels, usable, id_col, text_col, label_col)
    return score_documents(docs, field, id_col, text_col).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
