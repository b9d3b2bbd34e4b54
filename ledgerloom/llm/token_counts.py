"""Token counts per field or section, from one encoding of the whole document.

The document is encoded once; each token's character span is joined to the section spans. Rule for
a token that crosses a boundary: it counts for the section that holds most of its characters, for
the earlier one if that is even. A token in no section counts for none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import id_back, id_text
from .vocab import chunks, encoder, word_bpe


def line_sections(text: str, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of a text's lines, lines longer than so many characters cut at multiples of it."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    feeds = np.flatnonzero(codes == 10)
    starts, ends = np.concatenate([[0], feeds + 1]), np.concatenate([feeds, [len(codes)]])
    pieces = np.maximum(1, -(-(ends - starts) // longest))
    nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = np.repeat(starts, pieces) + nth * longest
    return first, np.minimum(first + longest, np.repeat(ends, pieces))


def attribute(token_start: np.ndarray, token_end: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, of these those that cross the section's boundary) per section; sections in order, apart."""
    n = len(start)
    tokens, crossing = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n or not len(token_start):
        return tokens, crossing
    # The sections that a token meets are those from the first that ends after its start.
    first = np.searchsorted(end, token_start, "right")
    last = np.searchsorted(start, token_end, "left") - 1
    best, held = np.full(len(token_start), -1), np.zeros(len(token_start), np.int64)
    for step in range(int((last - first).max(initial=-1)) + 1):
        at = first + step
        ok = (at <= last) & (at < n)
        at = np.where(ok, at, 0)
        share = np.where(ok, np.minimum(end[at], token_end) - np.maximum(start[at], token_start), 0)
        better = share > held
        best[better], held[better] = at[better], share[better]
    inside = best >= 0
    np.add.at(tokens, best[inside], 1)
    cut = inside & (held < token_end - token_start)
    np.add.at(crossing, best[cut], 1)
    return tokens, crossing


def count_section_tokens(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None, longest: int = 1000, tokenizer: str | None = None
) -> DataFrame:
    """Per document and section: id, section (from 0), start, end, n_tokens, n_crossing (long).

    sections_col holds array<struct<start, end>> of code-point spans, in order and apart; without it
    a section is a line, cut at multiples of longest code points. A null text counts as empty, which is
    a single empty section. Rows that share an id are told apart by nothing in the result.
    """
    ship(docs.sparkSession)
    path = tokenizer or word_bpe()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = encoder(path)
        for batch in batches:
            names, texts, given = batch["id"].to_numpy(), ["" if t is None else t for t in batch["text"]], batch["sections"] if sections_col else None
            for a, b in chunks(texts):
                parts = []
                for i, ids in zip(range(a, b), codec.batch(texts[a:b])):
                    if given is None:
                        start, end = line_sections(texts[i], longest)
                    else:
                        spans = given.iat[i] if given.iat[i] is not None else ()
                        start, end = np.array([s["start"] for s in spans], np.int64), np.array([s["end"] for s in spans], np.int64)
                    tokens, crossing = attribute(*codec.spans(texts[i], ids), start, end)
                    parts.append((np.repeat(names[i : i + 1], len(start)), np.arange(len(start)), start, end, tokens, crossing))
                columns = [np.concatenate(x) for x in zip(*parts)]
                yield pd.DataFrame(dict(zip(("id", "section", "start", "end", "n_tokens", "n_crossing"), columns)))

    columns = [id_text(docs, id_col).alias("id"), F.col(text_col).alias("text"), *([F.col(sections_col).alias("sections")] if sections_col else [])]
    counted = docs.select(*columns).mapInPandas(run, "id string, section long, start long, end long, n_tokens long, n_crossing long")
    return counted.select(id_back(docs, id_col, F.col("id")).alias(id_col), "section", "start", "end", "n_tokens", "n_crossing")
