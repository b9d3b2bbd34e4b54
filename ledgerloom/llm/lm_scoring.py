"""Cross-entropy difference of a target and a background bigram model.

Both models count bigrams of one vocabulary, that of a public tokenizer file: the target model those
of the marked documents, the background model those of all others. They are matched: the larger
model's counts are scaled down to the smaller one's number of tokens, both are smoothed alike,
P(b | a) = (c(a, b) + s) / (c(a) + s * V), and a document's own counts are taken out of the model
that it is part of. A document's score is its mean per-token loss under the target model less that
under the background model: the lower, the closer to the target.

A chunk of documents asks for each distinct bigram once, with its own counts, packed by ranges of a
hash of the bigram; the answer is the counts over all chunks, packed in the same order. So a frequent
bigram is one entry per chunk, not per occurrence, no group of the shuffle is hot, and no model is
ever held in one place: it is as wide as the corpus makes it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import Scratch, id_back, id_text
from .vocab import chunks, encoder, word_bpe

#: Ids of 16 bits: the start of a document, and the mark of a context count.
BEGIN, CONTEXT = 65534, 65535
SMOOTHING = 0.1
#: Characters in a chunk of documents, and characters of the corpus for each range of bigrams.
CHUNK, RANGE = 2_000_000, 8_000_000


def pack(*columns: np.ndarray) -> bytes:
    """Columns of as many whole numbers, each as wide as its greatest needs, compressed together."""
    parts = [np.uint32(len(columns[0])).tobytes()]
    for x in columns:
        width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
        parts += [bytes([width]), np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    """The columns of pack(), as 64-bit numbers."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    rows, at, out = int(raw[:4].view("<u4")[0]), 4, []
    while at < len(raw):
        width = int(raw[at])
        wide = np.zeros((rows, 8), np.uint8)
        wide[:, :width] = raw[at + 1 : at + 1 + width * rows].reshape(width, rows).T
        out.append(wide.view("<i8").ravel())
        at += 1 + width * rows
    return out


def _grams(lengths: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct bigrams and context marks of a chunk, sorted, and where each token's two stand."""
    before = np.concatenate([[BEGIN], ids[:-1]]).astype(np.int64) if len(ids) else ids
    before[(np.cumsum(lengths) - lengths)[lengths > 0]] = BEGIN
    unique, at = np.unique(np.concatenate([before << 16 | ids, before << 16 | CONTEXT]), return_inverse=True)
    return unique, at.reshape(2, -1)


def _ranges(grams: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams' places in the order of their ranges, and where each range starts in it."""
    number = (grams * 0x9E3779B1 & 0xFFFFFFFF) * ranges >> 32
    order = np.argsort(number, kind="stable")
    return order, np.searchsorted(number[order], np.arange(ranges + 1))


def cross_entropy_difference(docs: DataFrame, target: Column | DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Per row: id, n_tokens long, target_loss, background_loss, score (double, nats per token).

    target marks the documents of the target model: a condition (null: not), or a table whose first
    column holds their ids. Ids meet the chunks' lists of ids, so a table of them never makes Spark
    move the texts. A text without tokens (null, empty, blank) has n_tokens 0 and score 0. Rows that
    share an id are scored alone; a null id is never of the target of a table. Counts come from whole
    texts of all rows; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    path = tokenizer or word_bpe()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = encoder(path)
        for batch in batches:
            texts = ["" if t is None else t for t in batch["text"]]
            for a, b in chunks(texts, CHUNK):
                ids = codec.batch(texts[a:b])
                row = {"docs": batch["id"].iloc[a:b].tolist(), "lengths": [len(x) for x in ids], "marked": np.flatnonzero(batch["target"].iloc[a:b].to_numpy(bool)).tolist()}
                yield pd.DataFrame([row | {"n_chars": sum(map(len, texts[a:b])), "ids": pack(np.concatenate(ids))}])

    condition = F.lit(False) if isinstance(target, DataFrame) else target
    source = docs.select(id_text(docs, id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(condition.cast("boolean"), F.lit(False)).alias("target"))
    held = source.mapInPandas(encode, "docs array<string>, lengths array<long>, marked array<long>, n_chars long, ids binary")
    held = marked = scratch.save(held.withColumn("chunk", F.monotonically_increasing_id()))
    if isinstance(target, DataFrame):
        wanted = target.select(id_text(target, target.columns[0]).alias("id")).distinct()
        places = held.select("chunk", F.posexplode("docs").alias("at", "id")).join(wanted, "id").groupBy("chunk").agg(F.collect_list(F.col("at").cast("long")).alias("marked"))
        # Saved, so that Spark knows how small it is: a number for each target document.
        marked = held.drop("marked").join(scratch.save(places), "chunk", "left")

    of_target = F.aggregate(F.coalesce("marked", F.array()), F.lit(0).cast("long"), lambda s, i: s + F.get("lengths", i.cast("int")))
    total = F.aggregate("lengths", F.lit(0).cast("long"), lambda s, n: s + n)
    sums = marked.agg(F.sum("n_chars").alias("chars"), F.sum(of_target).alias("t"), F.sum(total).alias("n")).first()
    ranges = max(1, -(-(sums.chars or 0) // RANGE))
    target_size, other_size = sums.t or 0, (sums.n or 0) - (sums.t or 0)
    smaller = min(target_size, other_size)
    scales = (smaller / max(target_size, 1), smaller / max(other_size, 1))
    vocabulary = len(encoder(path).n_bytes)

    def flags(row) -> np.ndarray:
        found = np.zeros(len(row.lengths), bool)
        found[np.asarray(row.marked if row.marked is not None else (), np.int64)] = True
        return found

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                lengths = np.asarray(row.lengths, np.int64)
                unique, at = _grams(lengths, unpack(row.ids)[0])
                if not len(unique):
                    continue
                n = np.bincount(at.ravel(), minlength=len(unique))
                t = np.bincount(at.ravel(), weights=np.tile(np.repeat(flags(row), lengths), 2), minlength=len(unique)).astype(np.int64)
                order, cuts = _ranges(unique, ranges)
                rows = []
                for k in np.flatnonzero(np.diff(cuts)):
                    which = order[cuts[k] : cuts[k + 1]]
                    rows.append((k, row.chunk, pack(np.diff(unique[which], prepend=0), n[which], t[which])))
                yield pd.DataFrame(rows, columns=["range", "chunk", "asked"])

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(x) for x in group["asked"]]
        unique, at = np.unique(np.concatenate([np.cumsum(p[0]) for p in parts]), return_inverse=True)
        n, t = (np.bincount(at, weights=np.concatenate([p[k] for p in parts]), minlength=len(unique)).astype(np.int64) for k in (1, 2))
        ends = np.cumsum([len(p[0]) for p in parts])
        packed = [pack(n[at[e - len(p[0]) : e]], t[at[e - len(p[0]) : e]]) for p, e in zip(parts, ends)]
        return pd.DataFrame({"range": group["range"], "chunk": group["chunk"], "found": packed})

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"id": [], "n_tokens": [], "target_loss": [], "background_loss": [], "score": []})]
        for row in left.itertuples():
            lengths = np.asarray(row.lengths, np.int64)
            unique, at = _grams(lengths, unpack(row.ids)[0])
            order, cuts = _ranges(unique, ranges)
            n, t = np.zeros(len(unique), np.int64), np.zeros(len(unique), np.int64)
            for k, found in zip(right["range"], right["found"]):
                which = order[cuts[k] : cuts[k + 1]]
                n[which], t[which] = unpack(found)
            owner = np.repeat(np.arange(len(lengths)), lengths)
            mine = flags(row)[owner]
            losses = np.zeros((2, len(owner)))
            for sign, where, mass in ((-1, at[0], SMOOTHING), (1, at[1], SMOOTHING * vocabulary)):
                _, same, own = np.unique(owner * len(unique) + where, return_inverse=True, return_counts=True)
                own = own[same]
                counts = (t[where] - own * mine, n[where] - t[where] - own * ~mine)
                for k in (0, 1):
                    losses[k] += sign * np.log(scales[k] * counts[k] + mass)
            mean = [np.bincount(owner, weights=losses[k], minlength=len(lengths)) / np.maximum(lengths, 1) for k in (0, 1)]
            out.append(pd.DataFrame({"id": row.docs, "n_tokens": lengths, "target_loss": mean[0], "background_loss": mean[1], "score": mean[0] - mean[1]}))
        return pd.concat(out)

    asked = marked.select("chunk", "lengths", "marked", "ids").mapInPandas(ask, "range long, chunk long, asked binary")
    answers = asked.groupBy("range").applyInPandas(answer, "range long, chunk long, found binary")
    scored = marked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(score, "id string, n_tokens long, target_loss double, background_loss double, score double")
    return scored.select(id_back(docs, id_col, F.col("id")).alias(id_col), "n_tokens", "target_loss", "background_loss", "score")
