"""Encoding with a public vocabulary file, a distinct word at a time.

The vocabulary drops white space before any merge, so a word between white space has the same ids
wherever it stands. A task therefore encodes each word once while it is in use and looks it up after.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

#: Fixed value: the split pattern that the vocabulary file states.
WORD_BPE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Fixed value: the mark that the vocabulary puts on the last token of a pre-token.
WORD_END = "</w>"

#: Code points whose case, class and white space are old enough that Python's tables and the tokenizer
#: library's agree. A text with any other one goes through the library as a whole.
_AGREED = (
    "\t-\r\x20-\x7e\xa0-\xffĀ-įĲ-ňŊ-žΑ-ΡΤ-ωА-яא-תء-غف-ي"
    "‐-‧‰-⁞₠-₵、-〃〈-】ぁ-ゖァ-ヺ一-龥가-힣！-／：-＠"
)
_OTHER = regex.compile(f"[^{_AGREED}]")
#: Words in each of the two generations of the table. A full younger one takes the place of the older;
#: words that are still met come over, so frequent words are never learned again and memory is bounded.
GENERATION = 700_000
#: Words learned in one call of the library.
_TOGETHER = 20_000


def _byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: itself if printable, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """ids(text) as Tokenizer.encode(text, add_special_tokens=False) gives them."""

    def __init__(self, path: str, generation: int = GENERATION) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.generation = generation
        self.merges = Tokenizer(self.tokenizer.model)  # the merges alone, for pre-tokens between spaces
        self.merges.pre_tokenizer = WhitespaceSplit()
        self.split = regex.compile(WORD_BPE_SPLIT).findall
        self.letters = _byte_letters()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.n_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        self.ends = np.zeros(len(self.n_bytes), bool)
        for token, i in vocab.items():
            self.n_bytes[i] = len(token.removesuffix(WORD_END))
            self.ends[i] = token.endswith(WORD_END)
        #: word: its ids, as unsigned 16- or 32-bit numbers
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.kind = np.dtype("<u2" if len(self.n_bytes) <= 1 << 16 else "<u4")

    def plain(self, text: str) -> bool:
        """Whether words alone decide the ids: no special token's string, no disputed character."""
        if any(s in text for s in self.special) or _OTHER.search(text):
            return False
        return text.isascii() or unicodedata.is_normalized("NFC", text)

    def _missing(self, words: set[str]) -> list[str]:
        """Those words that neither generation has; those of the older one come over."""
        old, young, new = self.old, self.young, []
        for word in words.difference(young):
            if (found := old.get(word)) is None:
                new.append(word)
            else:
                young[word] = found
        return new

    def _learn(self, words: set[str]) -> None:
        new = self._missing(words)
        parts = {w: self.split(w) for w in new if not w.isalpha()}
        pieces = self._missing({w for w in new if w not in parts}.union(*parts.values()))
        for at in range(0, len(pieces), _TOGETHER):
            some = pieces[at : at + _TOGETHER]
            line = " ".join(some)
            if not line.isascii():
                line = line.encode().decode("latin-1").translate(self.letters | {32: " "})
            ids = np.array(self.merges.encode_batch_fast([line], add_special_tokens=False)[0].ids, self.kind)
            cuts = [0, *((np.flatnonzero(self.ends[ids]) + 1) * self.kind.itemsize).tolist()]  # a marked token ends a pre-token
            raw = ids.tobytes()
            self.young.update(zip(some, [raw[a:b] for a, b in zip(cuts, cuts[1:])], strict=True))
        known = self.young.__getitem__
        self.young.update({w: b"".join(map(known, ps)) for w, ps in parts.items()})

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, unsigned 32-bit."""
        if len(self.young) >= self.generation:
            self.old, self.young = self.young, {}
        words = [t.lower().split() if self.plain(t) else None for t in texts]
        self._learn(set().union(*(ws for ws in words if ws)))
        known = self.young.__getitem__
        whole = lambda t: np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
        return [whole(t) if ws is None else np.frombuffer(b"".join(map(known, ws)), self.kind).astype(np.uint32) for t, ws in zip(texts, words)]

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character, and the one after the last, of each token; ids are those of batch().

        The tokens' bytes in turn are the bytes of the lower-case text without white space.
        """
        lower = text.lower()
        if not self.plain(text) or len(lower) != len(text):
            offsets = np.array(self.tokenizer.encode(text, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
            return offsets[:, 0], offsets[:, 1]
        codes = np.frombuffer(lower.encode("utf-32-le"), np.uint32)
        n = np.ones(len(codes), np.int64) + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
        n[_SPACE[np.minimum(codes, len(_SPACE) - 1)]] = 0
        char_of = np.repeat(np.arange(len(codes)), n)
        end = np.cumsum(self.n_bytes[ids])
        return char_of[end - self.n_bytes[ids]], char_of[end - 1] + 1


#: Which code points are white space; none is from U+3001 on.
_SPACE = np.array([chr(c).isspace() for c in range(0x3002)])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file."""
    return Encoder(path)


def word_bpe() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def chunks(texts: list[str], characters: int = 2_000_000):
    """Index ranges of texts with about so many characters, one text at least."""
    start = total = 0
    for i, text in enumerate(texts):
        total += len(text)
        if total >= characters:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
