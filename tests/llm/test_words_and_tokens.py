"""Language mixtures, repeated-word runs and tokenizer alignment against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import alignment, language_mix, tandem_runs
from ledgerloom.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, runs string, pair long, row long"
STRANGE = [
    None, "", " ", "\n\t ", "one", "a  b", "  two spaces", "end ", "a\n b", "x \n\n y", "a\r\n  b", "▁ab c", "a ▁b", "<|endoftext|> <s> </s>", "é é ﬁ 日本語 テスト 🙂",
    "a\x00b \x1c \x85 c", "it's 'tis we'll", "12345 678,90 -- !!", "la " * 40, "a b " * 9, "na na na na na na na na na na na na batman", "word " * 5000, "aaaa" * 3000,
]


@pytest.fixture(scope="module")
def small(spark, sf_dir, tmp_path_factory):
    """Short documents of the table, then strange, very long, repeated and unnamed ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars < 2500").orderBy("doc_id").limit(70)
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()]
    rows += [(1000 + i, t, None if i % 2 else "en", "odd", 0) for i, t in enumerate(STRANGE)]
    chance = random.Random(3)
    rows += [(2000 + i, " ".join(chance.choice("ab") for _ in range(60)), "en", "ab", 0) for i in range(40)]
    rows += [(3000 + i, "one two three four five six seven eight nine ten " * 3, "en", "ten", 0) for i in range(40)]
    rows += [rows[0], rows[0], (None, "no id at all", "en", "src0", 0), (None, "no id at all", None, None, None)]
    folder = str(tmp_path_factory.mktemp("small"))
    spark.createDataFrame([(*r, "x", "y", 7, 8) for r in rows], SCHEMA).repartition(5).write.parquet(f"{folder}/documents.parquet")
    return folder, rows


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    return folder


def plain_runs(words: list, least: int) -> list[tuple[int, int, int]]:
    """Every (start, length, period), straight from the definition."""
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, 2 * q) and not any(all(words[x] == words[x + d] for x in range(i, i + length - d)) for d in range(1, q)):
                found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found)


def plain_periodic_row(doc_id, text) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words, 12)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(((-length, s, q) for s, length, q in runs), default=None)
    longest = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *longest, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_periodic_runs_are_those_of_the_definition(spark, small):
    folder, rows = small
    found = QUERIES["op12_periodic_runs"](spark, folder)
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    cheap = [r for r in rows if len((r[1] or "").split()) < 1000]
    expected = Counter(plain_periodic_row(r[0], r[1]) for r in cheap)
    got = Counter(tuple(r) for r in found.collect())
    assert expected - got == Counter() and (got - expected).total() == len(rows) - len(cheap)
    assert sum(n for row, n in expected.items() if row[1]) > 40
    long = [r for r in found.where("doc_id = 1021").collect()]
    assert [(r.n_runs, r.start, r.length, r.period) for r in long] == [(1, 0, 5000, 1)]


def test_runs_of_sequences_in_one_tree():
    rng = np.random.default_rng(5)
    for _ in range(250):
        docs = []
        for _ in range(int(rng.integers(1, 5))):
            if rng.random() < 0.5:
                docs.append(rng.integers(0, int(rng.integers(1, 4)), int(rng.integers(0, 60))))
            else:
                docs.append(np.concatenate([np.tile(rng.integers(0, 6, int(rng.integers(1, 9))), int(rng.integers(1, 5))) for _ in range(3)]))
        for least in (2, 5, 12):
            text, *run = tandem_runs.batch_runs(np.concatenate(docs).astype(np.int32), np.array([len(d) for d in docs]), least)
            got = [sorted(zip(*(x[text == i].tolist() for x in run))) for i in range(len(docs))]
            assert got == [plain_runs(d.tolist(), least) for d in docs]


def test_vocabulary_is_every_primitive_square():
    rng = np.random.default_rng(6)
    for _ in range(100):
        symbols = np.append(rng.integers(0, 2, 40), 9)
        tree = tandem_runs.SuffixTree(symbols)
        start, half = tandem_runs.leftmost_squares(tree, symbols)
        ok = tandem_runs.primitive(tree, start, half)
        lo, _, q = tandem_runs.vocabulary(tree, start[ok], half[ok])
        got = sorted(tuple(symbols[tree.order[a] : tree.order[a] + 2 * b]) for a, b in zip(lo, q))
        s = symbols.tolist()
        squares = {tuple(s[i : i + 2 * k]) for k in range(1, 21) for i in range(42 - 2 * k) if s[i : i + k] == s[i + k : i + 2 * k]}
        power = lambda w: any(len(w) % d == 0 and w == w[:d] * (len(w) // d) for d in range(1, len(w)))
        assert got == sorted(w for w in squares if not power(w[: len(w) // 2]))


def plain_alignment(rows) -> Counter:
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}
    texts, held = [], defaultdict(int)
    for doc_id, text, *_ in rows:
        ids_a, ids_b = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            texts.append((doc_id, [], [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        links, j = [], 0
        for i, e in enumerate(ends_a):
            start = ends_a[i - 1] if i else 0
            links += [(ids_a[i], ids_b[k]) for k, f in enumerate(ends_b[max(0, j - 1) : j + 40 + e], max(0, j - 1)) if f > start and (ends_b[k - 1] if k else 0) < e]
            while j < len(ends_b) and ends_b[j] <= e:
                j += 1
        cut, groups = 0, []
        for e in sorted(set(ends_a) & set(ends_b)):
            groups.append("|".join(",".join(str(x) for x, f in zip(ids, ends) if cut < f <= e) for ids, ends in ((ids_a, ends_a), (ids_b, ends_b))) if len(ends_a) < 3000 else "")
            cut = e
        for pair in set(links):
            held[pair] += 1
        texts.append((doc_id, ids_a, ids_b, groups, links))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    return Counter((d, len(x), len(y), len(g), len(k), sum(held[p] == most[p[0]] for p in k), sum(held[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if x and len(x) < 3000 else "" if not x else None) for d, x, y, g, k in texts)


def test_alignment_is_that_of_the_definition(spark, small):
    folder, rows = small
    found = QUERIES["op13_tokenizer_alignment"](spark, folder)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = Counter((*r[:7], r[7] if r[1] < 3000 else None) for r in found.collect())
    assert got == plain_alignment(rows)
    assert sum(n for r, n in got.items() if r[1] != r[3]) > 50


def test_alignment_in_slices_is_the_same(spark, small):
    docs = spark.read.parquet(f"{small[0]}/documents.parquet")
    columns = ["doc_id", "n_best", "count_sum"]
    whole, sliced = (Counter(map(tuple, alignment.align_tokenizers(docs, slice_rows=n).select(columns).collect())) for n in (1 << 20, 700))
    assert whole == sliced


def test_group_lists_show_all_tokens(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars < 1500").limit(20)
    for row in alignment.align_tokenizers(docs).collect():
        sides = [[x for part in row.groups.split(";") for x in part.split("|")[k].split(",")] for k in (0, 1)]
        assert [len(s) for s in sides] == [row.n_a, row.n_b] and row.groups.count(";") == row.n_groups - 1
        assert row.n_links == row.n_a + row.n_b - row.n_groups


def test_languages_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text")
    joined = QUERIES["op11_language_id"](spark, sf).join(docs, "doc_id").where("held_out")
    rows = joined.collect()
    lettered = [r for r in rows if any(c.isalpha() for c in r.text or "")]
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang == r.lang_pred for r in lettered) >= 0.99 * len(lettered) > 300


def test_language_query_on_strange_rows(spark, small):
    folder, rows = small
    found = QUERIES["op11_language_id"](spark, folder)
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = found.collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    named = {r.doc_id: r for r in got}
    for doc_id, text, *_ in rows:
        assert (named[doc_id].lang_pred == "und") == (not any(c.isalpha() for c in text or "")), text
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


@pytest.mark.parametrize("name", ["op11_language_id", "op12_periodic_runs", "op13_tokenizer_alignment"])
def test_empty_tables_give_empty_results(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


def test_nothing_learned_names_nothing(spark):
    docs = spark.createDataFrame([(1, "some words here", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {tuple(r)[1:3] for r in language_mix.identify_languages(docs, F.lit(True)).collect()} == {("und", 0.0)}


def test_mixtures_are_found(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    by = {g: " ".join(r.text for r in docs.where(f"lang = '{g}' AND n_chars BETWEEN 1000 AND 4000").limit(3).collect()).split()[:400] for g in ("en", "fr", "de")}
    mixed = [(1, " ".join(by["en"][:300] + by["fr"][:100]), None), (2, " ".join(by["de"][:200] + by["fr"][:100] + by["en"][:100]), None), (3, " ".join(by["fr"]), None)]
    both = docs.select((F.col("doc_id") + 10).alias("doc_id"), "text", "lang").union(spark.createDataFrame(mixed, "doc_id long, text string, lang string"))
    found = {r.doc_id: r for r in language_mix.identify_languages(both, F.col("lang").isNotNull()).where("doc_id < 4").collect()}
    assert [found[i].lang_pred for i in (1, 2, 3)] == ["en", "de", "fr"]
    # Short words are likely in all languages, so shares come out up to a seventh too even.
    assert set(found[1].shares) == {"en", "fr"} and abs(found[1].shares["fr"] - 0.25) < 0.15
    assert set(found[2].shares) == {"de", "en", "fr"} and abs(found[2].shares["de"] - 0.5) < 0.15
    assert set(found[3].shares) == {"fr"}


def test_mixture_is_plain_expectation_maximisation():
    rng = np.random.default_rng(2)
    sizes, langs = [5, 1, 30], 3
    score, times = rng.normal(-20, 6, (sum(sizes), langs)), rng.integers(1, 5, sum(sizes)).astype(float)
    owner = np.repeat(np.arange(3), sizes)
    shares, total = language_mix.mixture(score, times, owner, np.ones((3, langs), bool))
    for d in range(3):
        p, own, t = np.full(langs, 1 / langs), np.exp(score[owner == d]), times[owner == d]
        for _ in range(2000):
            r = own * p
            p = ((t / r.sum(axis=1))[:, None] * r).sum(axis=0) / t.sum()
        best = (t * np.log((own * p).sum(axis=1))).sum()
        assert np.abs(shares[d] - p).max() < 0.05 and best - 0.05 < total[d] <= best + 1e-6
