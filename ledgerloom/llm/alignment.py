"""Alignment of two tokenizers over the same bytes.

A task tokenises each text once with both vocabularies and compares the ends of a batch's tokens:

* the ends that both tokenizers share cut a text's tokens into groups, each written once, which Spark's array
  functions count and join;
* the union of their ends names the links: each stretch between neighbouring ends lies in one token of
  either side, and those two overlap; no other pair does;
* the number of documents that hold an id pair linked is a grouped count over each document's distinct
  pairs, which is combined before the shuffle;
* the counts meet the documents in slices of a fixed number of pairs, each slice broadcast to the
  documents' exploded links. The number of slices follows from the number of distinct pairs, which the two
  vocabularies bound, so the documents' own links are never shuffled.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from ..shipping import ship
from .common import Scratch, id_back, id_text
from .tandem_runs import ranges
from .vocab import _byte_letters, chunks

#: Tokens of known words that a worker keeps; beyond, it starts anew with the next batch.
KEPT_TOKENS = 2_000_000
#: Pairs in a slice of counts that is broadcast: 32 MB as rows.
SLICE = 2_000_000
#: The piece vocabulary's sign for a space.
_BLANK = "▁"


class BothEncoders:
    """Ids and byte lengths of a text's tokens, with a space before it, by a byte-level BPE file and a piece model.

    Neither tokenizer has a token that goes on over a space after another character (checked for the piece
    model when it is loaded; the byte-level pattern starts a new pre-token at each space). A text whose spaces
    are single and inside is therefore encoded word by word, each distinct word once while it is known.
    """

    def __init__(self, byte_bpe: str, piece_bpe: str) -> None:
        ranks = Tokenizer.from_file(byte_bpe).get_vocab(with_added_tokens=False)  # its ids are in the order of its merges
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
        byte_of = {letter: b for b, letter in _byte_letters().items()}
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token)
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks={x: i for i, x in enumerate(self.a_bytes)}, special_tokens={})
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in xs], np.int32) for xs in (self.a_bytes, self.b_bytes))
        self.id_texts = pa.array([f"{i}{c}" for xs, end in ((self.a_bytes, "|"), (self.b_bytes, "")) for i in range(len(xs)) for c in (",", end)], pa.string())
        self.by_word = not any(" " in p.lstrip(" ") for p in (x.decode(errors="replace") for x in self.b_bytes))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}  # word: its place in the lists below
        self.tokens = array("i"), array("i")
        self.ends = array("q", [0]), array("q", [0])  # of each word's tokens
        self.fits = bytearray()  # whether both give the word's bytes back

    def _encode(self, text: str) -> tuple[np.ndarray, np.ndarray, bool]:
        """Ids of both for a space and the text, and whether each side's bytes are those of that."""
        a = self.a.encode_ordinary(" " + text)  # strings of special tokens in a text are plain text
        b = self.b.encode(text, num_threads=1)
        whole = (" " + text).encode()
        fits = all(b"".join(map(table.__getitem__, ids)) == whole for table, ids in ((self.a_bytes, a), (self.b_bytes, b)))
        return np.array(a, np.int32), np.array(b, np.int32), fits

    def _add(self, sides: tuple[np.ndarray, np.ndarray], cuts: tuple[np.ndarray, np.ndarray], fits: bool) -> None:
        """Words whose tokens are sides, the last of each before cuts."""
        for tokens, ends, ids, cut in zip(self.tokens, self.ends, sides, cuts):
            ends.frombytes((cut + len(tokens)).astype(np.int64).tobytes())
            tokens.frombytes(ids.astype(np.int32).tobytes())
        self.fits.extend(bytes([fits]) * len(cuts[0]))

    def _learn(self, words: list[str]) -> None:
        """Words without spaces, all new."""
        for at in range(0, len(words), 20_000):
            some = words[at : at + 20_000]
            a, b, fits = self._encode(" ".join(some))
            if fits:
                stops = np.cumsum([len(w.encode()) + 1 for w in some])
                cuts = tuple(np.searchsorted(np.cumsum(size[ids]), stops) + 1 for size, ids in ((self.a_size, a), (self.b_size, b)))
                self._add((a, b), cuts, True)
            else:
                for word in some:
                    a, b, fits = self._encode(word)
                    self._add((a, b), (np.array([len(a)]), np.array([len(b)])), fits)
            self.known.update(zip(some, range(len(self.known), len(self.known) + len(some))))

    def batch(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For either side: how many tokens each text has, their ids, and their ends in bytes; none for a text
        that is empty or that a side does not give back."""
        if max(len(self.tokens[0]), len(self.tokens[1])) > KEPT_TOKENS:
            self._forget()
        plain = [self.by_word and t != "" and "  " not in t and t[0] != " " and t[-1] != " " for t in texts]
        words = [t.split(" ") if p else [] for t, p in zip(texts, plain)]
        flat = list(chain.from_iterable(words))
        self._learn(list(set(flat).difference(self.known)))
        place = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        owner = np.repeat(np.arange(len(texts)), [len(ws) for ws in words])
        unfit = np.bincount(owner, np.frombuffer(self.fits, np.uint8)[place] == 0, len(texts)) > 0
        whole = [i for i, t in enumerate(texts) if t and (unfit[i] or not plain[i])]
        if whole:
            more = [(i, *self._encode(texts[i])) for i in whole]
            keep = ~np.isin(owner, whole)
            place, owner = [place[keep]], [owner[keep]]
            for i, a, b, fits in more:
                if fits:  # a text of its own, under a name that no word has
                    place.append([len(self.known)])
                    owner.append([i])
                    self.known[f" {len(self.known)}"] = len(self.known)
                    self._add((a, b), (np.array([len(a)]), np.array([len(b)])), True)
            place, owner = np.concatenate(place).astype(np.int64), np.concatenate(owner).astype(np.int64)
            order = np.argsort(owner, kind="stable")
            place, owner = place[order], owner[order]
        out = []
        for tokens, ends, size in zip(self.tokens, self.ends, (self.a_size, self.b_size)):
            ends = np.frombuffer(ends, np.int64)
            n = ends[place + 1] - ends[place]
            ids = np.frombuffer(tokens, np.int32)[ranges(ends[place], n)]
            counts = np.bincount(owner, n, len(texts)).astype(np.int64)
            stops = np.cumsum(size[ids], dtype=np.int64)
            before = np.append(0, stops)[np.cumsum(counts) - counts]  # bytes of the texts before
            out.append((counts, ids, (stops - np.repeat(before, counts)).astype(np.int32)))
        return out


@lru_cache(maxsize=2)
def encoders(byte_bpe: str, piece_bpe: str) -> BothEncoders:
    """One per Python worker and pair of files."""
    return BothEncoders(byte_bpe, piece_bpe)


def overlaps(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], b_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of a batch of texts, whose tokens a and b give as counts, ids and ends: the place in the text of each group's
    last token, for a and for b, and the linked id pairs in order; each with its number per text."""
    n = len(a[0])
    owners = [np.repeat(np.arange(n, dtype=np.int64), side[0]) for side in (a, b)]
    keys = [owner << 32 | side[2] for owner, side in zip(owners, (a, b))]
    common, cuts = np.intersect1d(*keys, assume_unique=True), np.union1d(*keys)
    per_text = lambda at: np.bincount(at >> 32, minlength=n)
    lasts = [np.searchsorted(key, common) - (np.cumsum(side[0]) - side[0])[common >> 32] for key, side in zip(keys, (a, b))]
    # The byte before a cut lies in the first token that ends there or later.
    ids_a, ids_b = (side[1][np.searchsorted(key, cuts)].astype(np.int64) for key, side in zip(keys, (a, b)))
    links = ids_a << b_bits | ids_b
    links = links[np.lexsort((links, cuts >> 32))]
    return [*((per_text(common), x.astype(np.int32)) for x in lasts), (per_text(cuts), links)]


def group_texts(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], lasts: list[tuple[np.ndarray, np.ndarray]], texts: pa.Array, first_b: int) -> pa.Array:
    """Each group's 'a1,a2|b1,b2', of all texts of a batch in order: texts has what an id writes inside of a group, at
    2 * id, and at its end, at 2 * id + 1; those of b from first_b on. Texts' tokens are in groups without a rest."""
    ends = [last + np.repeat(np.cumsum(side[0]) - side[0], n) + 1 for side, (n, last) in zip((a, b), lasts)]
    sizes = [np.diff(end, prepend=0) for end in ends]
    codes = np.empty(len(a[1]) + len(b[1]), np.int32)
    before = ends[0], ends[1] - sizes[1]  # of the other side, before a group's own tokens of b and of a
    for side, end, size, other, first in zip((a, b), ends, sizes, before[::-1], (0, first_b)):
        code = side[1] * 2 + first
        code[end - 1] += 1
        codes[np.arange(len(code)) + np.repeat(other, size)] = code
    taken = texts.take(pa.array(codes))
    cuts = np.frombuffer(taken.buffers()[1], np.int32)[np.append(0, ends[0] + ends[1])]
    return pa.StringArray.from_buffers(len(ends[0]), pa.py_buffer(cuts), taken.buffers()[2])


def tokenise(docs: DataFrame, id_col: str, text_col: str, byte_bpe: str, piece_bpe: str, b_bits: int) -> DataFrame:
    """id as text; n_a, n_b: how many tokens; groups: each group's text; links: id pairs, a << b_bits | b, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = encoders(byte_bpe, piece_bpe)
        lists = lambda counts, values: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), values)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for start, end in chunks(texts, 1_000_000):
                a, b = both.batch(texts[start:end])
                *lasts, links = overlaps(a, b, b_bits)
                groups = group_texts(a, b, lasts, both.id_texts, 2 * len(both.a_bytes))
                columns = [batch.column("id").slice(start, end - start), pa.array(a[0]), pa.array(b[0]), lists(lasts[0][0], groups), lists(links[0], pa.array(links[1]))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_a", "n_b", "groups", "links"])

    whole = lambda name, kind: T.StructField(name, T.ArrayType(kind, containsNull=False))
    fields = [T.StructField("id", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("n_a", "n_b")], whole("groups", T.StringType()), whole("links", T.LongType())]
    return docs.select(id_text(docs, id_col).alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, T.StructType(fields))


def align(tokens: DataFrame, keep: Callable[[Column], Column]) -> DataFrame:
    """tokens as id, n_a, n_b, n_groups, n_links, groups (what keep makes of their text) and links."""
    sizes = [F.size(x).cast("long").alias(n) for x, n in (("groups", "n_groups"), ("links", "n_links"))]
    return tokens.select("id", "n_a", "n_b", *sizes, keep(F.array_join("groups", ";")).alias("groups"), "links")


def align_tokenizers(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_bpe: str | None = None, piece_bpe: str | None = None,
    keep: Callable[[Column], Column] = lambda groups: groups, slice_rows: int = SLICE,
) -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum (long), groups.

    groups: 'a1,a2|b1;a3|b2,b3', or what keep makes of that text (a digest saves writing it). A pair's count is the number of rows that hold it linked; count_sum adds it
    over a row's links, n_best counts the links whose count is the highest of their A id. Texts that are null,
    empty, or not given back by either tokenizer have no tokens: zeros and an empty text. Every row gives one
    row and counts as a document of its own, also if its id is null or shared; other columns do not matter.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    paths = byte_bpe or public_tokenizers.path("byte_bpe_50k.json"), piece_bpe or public_tokenizers.path("piece_bpe_32k.model")
    both = encoders(*paths)
    b_bits = len(both.b_bytes).bit_length()
    tokens = tokenise(docs, id_col, text_col, *paths, b_bits)
    saved = scratch.save(align(tokens, keep).withColumn("row", F.monotonically_increasing_id()))

    counted = scratch.save(saved.select(F.explode(F.array_distinct("links")).alias("pair")).groupBy("pair").agg(F.count("*").alias("held")))
    a_of = F.shiftright("pair", b_bits)
    most = counted.groupBy(a_of.alias("a")).agg(F.max("held").alias("most"))
    known = scratch.save(counted.join(most, a_of == F.col("a")).select("pair", "held", (F.col("held") == F.col("most")).cast("long").alias("best")))
    n_slices = max(1, -(-known.count() // slice_rows))
    own = saved.select("row", F.explode("links").alias("pair"))
    slices = [known if n_slices == 1 else known.where(F.pmod(F.xxhash64("pair"), F.lit(n_slices)) == k) for k in range(n_slices)]
    met = [own.join(F.broadcast(s), "pair").groupBy("row").agg(F.sum("best").alias("n_best"), F.sum("held").alias("count_sum")) for s in slices]
    sums = reduce(DataFrame.unionAll, met)
    if n_slices > 1:
        sums = sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = saved.drop("links").join(sums, "row", "left")
    none = F.lit(0).cast("long")
    return out.select(id_back(docs, id_col, F.col("id")).alias(id_col), "n_a", "n_b", "n_groups", "n_links", *[F.coalesce(c, none).alias(c) for c in ("n_best", "count_sum")], "groups")
