"""Operators against plain versions of themselves, on small tables with the odd cases in them."""

from __future__ import annotations

import collections
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm import embeddings, line_crf, line_dedup, linking, lm_scoring, mixing, packing, quality_rules, simhash, site_style_tree, token_counts, vocab
from ledgerloom.llm.common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 997}" for i in range(30_000))
BASE = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
TEXTS = [
    None,
    "",
    "  \n\t ",
    "one",
    BASE,
    BASE,
    BASE.upper(),
    BASE.replace("kappa", "Kappa,"),
    BASE + "\n" + BASE.replace("nu xi", "nu xy") + "\nshort line",
    "a b c a b c a b c",
    "é ü 日本語 テスト x <|endoftext|> \U0001f600 it's 12",
    LONG,
    LONG + " tail",
]


@pytest.fixture(scope="module")
def docs(spark):
    """Ids with a null and a repeat; extra columns whose names the operators use inside."""
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 11]
    rows = [(i, t, f"s{i % 3}" if i % 4 else None, i, "x") for i, t in zip(ids, TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, id long, size string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def components(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_connected_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(i, i + 1) for i in range(300, 340)]
    frame = spark.createDataFrame([(a * 7 - 500, b * 7 - 500) for a, b in edges], "src long, dst long")
    want = components(400, edges)
    got = {(r.node + 500) // 7: (r.component + 500) // 7 for r in linking.connected_components(frame, Scratch(spark)).collect()}
    assert got == {x: want[x] for e in edges for x in e if e[0] != e[1]} | {k: want[k] for k in got}
    assert linking.connected_components(frame.where("false"), Scratch(spark)).count() == 0


def plain_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    for text in TEXTS[:11]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_simhash_groups(spark, docs, empty):
    prints = [plain_fingerprint(t) for t in TEXTS[:11]] + [simhash.fingerprint(t) for t in TEXTS[11:]]
    edges = [(a, b) for a in range(13) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    want = components(13, edges)
    ids = [*range(12), 11]
    got = collections.Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.simhash_groups(docs).collect())
    assert got == collections.Counter((ids[k], prints[k], ids[want[k]]) for k in range(13))
    assert simhash.simhash_groups(empty).count() == 0


def test_ring_finds_every_pair_in_reach(spark):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 1 << 63, 60)]
    prints = list(dict.fromkeys(base + [b ^ sum(1 << int(k) for k in rng.choice(64, int(rng.integers(1, 7)), replace=False)) for b in base for _ in range(6)]))
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    keys = frame.select(F.explode(simhash.ring_keys(F.col("fp"))).alias("bucket"), F.col("fp").alias("id"), F.col("fp").alias("sketch"))
    got = {r.node % (1 << 64): r.component % (1 << 64) for r in linking.link_components(keys, simhash.in_chain, Scratch(spark)).collect()}
    want = components(len(prints), [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4])
    groups = lambda label: {frozenset(k for k in label if label[k] == v) for v in set(label.values())}
    assert groups(got) == {g for g in groups(dict(zip(prints, want))) if len(g) > 1}


def test_mixing_shares_and_caps(spark, docs, empty):
    rows = {r.source: r for r in mixing.mix_sources(docs).collect()}
    mixed = mixing.mix_sources(docs).collect()
    total = sum(r.size for r in mixed)
    assert abs(sum(rows[s].target for s in rows) - total) < 1e-6 * max(total, 1)
    assert all(r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0) for r in mixed)
    assert all(rows[s].target <= 3 * rows[s].source_size + 1e-9 for s in rows)
    assert sum(r.taken for r in mixed) <= total
    assert mixing.mix_sources(empty).count() == 0


def test_mixing_comes_near_targets(spark):
    rows = [(i, "w " * (1 + i * 37 % 90), f"s{min(i % 10, 3)}") for i in range(4000)]
    mixed = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in mixed.groupBy("source", "target").agg(F.sum("taken").alias("taken")).collect():
        assert abs(r.taken - r.target) < 0.01 * r.target
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, mixed.repartition(5).collect()))


def plain_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = min((b for b in range(len(bins)) if bins[b] >= n), key=lambda b: bins[b], default=None)
        if fit is None:
            bins.append(capacity - n)
        else:
            bins[fit] -= n
    return sorted(bins)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    lengths = [int(x) for x in rng.integers(1, 101, int(rng.integers(1, 400)))]
    room = collections.defaultdict(lambda: 100)
    spans = collections.defaultdict(list)
    seen = collections.Counter()
    for length, rank, n, first, each, base in packing.best_fit_plan(dict(collections.Counter(lengths)), 100):
        assert rank == seen[length]
        seen[length] += n
        for k in range(n):
            room[first + k // each] -= length
            spans[first + k // each].append((base + k % each * length, length))
    assert seen == collections.Counter(lengths)
    assert sorted(room.values()) == plain_best_fit(lengths, 100)
    for placed in spans.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length


def test_packing_round_trip(spark, docs, empty):
    rows = packing.pack_documents(docs, capacity=4096, keep_ids=True).collect()
    codec = vocab.Encoder(vocab.word_bpe())
    want = collections.Counter()
    for i, t in zip([*range(12), 11], TEXTS):
        ids = [*codec.tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            want[i, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
            assert any(r.doc_id == i and r.ids == part for r in rows)
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by_sequence = collections.defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for placed in by_sequence.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack_documents(empty).count() == 0


def test_ids_beside_a_null_stay_whole(spark):
    """pandas would make doubles of whole numbers beside a null, and another id of 2**53 + 1."""
    big = 2**53 + 1
    rows = spark.createDataFrame([(None, BASE, "a", 1), (big, BASE + " x", "b", 0), (3, None, None, None)], "doc_id long, text string, source string, quality int").coalesce(1)
    ids = lambda df: sorted(r.doc_id or 0 for r in df.select("doc_id").distinct().collect())
    labels = rows.select("doc_id", "quality")
    vectors = spark.createDataFrame([(None, [1.0, 0.0], 1), (big, [1.0, 0.0], 1), (3, None, 1)], "doc_id long, embedding array<float>, label int").coalesce(1)
    pages = rows.select("doc_id", F.lit("http://a.b/c").alias("url"), F.col("text").alias("html"))
    for found in (
        simhash.simhash_groups(rows),
        packing.pack_documents(rows),
        token_counts.count_section_tokens(rows),
        lm_scoring.cross_entropy_difference(rows, F.col("quality") == 1),
        line_crf.classify_quality(rows, labels, F.lit(True)),
        quality_rules.judge_quality(rows),
        line_dedup.dedup_lines(rows),
        mixing.mix_sources(rows),
        embeddings.link_vectors(vectors, id_col="doc_id"),
        site_style_tree.extract_main_text(pages),
    ):
        assert ids(found) == [0, 3, big]


def test_encoder_agrees_with_the_library():
    codec = vocab.Encoder(vocab.word_bpe())
    odd = [t or "" for t in TEXTS[:11]] + ["ΑΣ Σ", "İx", "a\x1cb", "é", "!!'s 'll", "１２ ⅻ"]
    for text, ids in zip(odd, codec.batch(odd)):
        encoded = codec.tokenizer.encode(text, add_special_tokens=False)
        assert encoded.ids == ids.tolist()
        assert encoded.offsets == list(zip(*(x.tolist() for x in codec.spans(text, ids))))


def test_section_tokens(spark, docs, empty):
    rows = token_counts.count_section_tokens(docs, longest=7).where("doc_id < 11").collect()
    codec = vocab.Encoder(vocab.word_bpe())
    got = {(r.doc_id, r.section): (r.start, r.end, r.n_tokens, r.n_crossing) for r in rows}
    want = {}
    for i, t in enumerate(TEXTS[:11]):
        t = t or ""  # a null text counts as empty
        sections, at = [], 0
        for line in t.split("\n"):
            sections += [[at + k, min(at + k + 7, at + len(line)), 0, 0] for k in range(0, max(len(line), 1), 7)]
            at += len(line) + 1
        for s, e in codec.tokenizer.encode(t, add_special_tokens=False).offsets:
            shares = [min(e, x[1]) - max(s, x[0]) for x in sections]
            if max(shares) > 0:
                k = shares.index(max(shares))
                sections[k][2] += 1
                sections[k][3] += max(shares) < e - s
        want |= {(i, k): tuple(x) for k, x in enumerate(sections)}
    assert got == want
    assert token_counts.count_section_tokens(empty).count() == 0


def test_quality_counts(spark, docs, empty):
    got = {r.doc_id: r for r in quality_rules.judge_quality(docs.where("doc_id < 11")).collect()}
    for i, t in enumerate(TEXTS[:11]):
        words, seen, dup = WORD.findall(t or ""), set(), 0
        grams = collections.Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        repeated = {p for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        for line in (t or "").split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        r = got[i]
        assert (r._qr_n_words, r._qr_word_chars, r._qr_n_dup_lines, r._qr_n_repeat_words) == (len(words), sum(map(len, words)), dup, len(repeated))
        assert r._qr_n_symbols == len(re.findall(r"[#*$%&|<>]", t or ""))
    assert quality_rules.judge_quality(empty).count() == 0


def test_weak_supervision_tells_junk(spark):
    clean = [(i, " ".join(f"the w{(i * 31 + k * 7) % 1009} of" for k in range(40))) for i in range(200)]
    junk = [(200 + i, " ".join(f"x{(i * 17 + k * 5) % 1009}*** $$$" for k in range(60))) for i in range(30)]
    judged = quality_rules.judge_quality(spark.createDataFrame(clean + junk, "doc_id long, text string"))
    assert {r.doc_id for r in judged.where("_qr_kept").collect()} == set(range(200))


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_similarity_is_edit_distance(spark):
    rng = np.random.default_rng(3)
    pairs = []
    for _ in range(120):
        a = [f"w{int(x)}" for x in rng.integers(0, 30, int(rng.integers(1, 14)))]
        b = list(a)
        for _ in range(int(rng.integers(0, 4))):
            at = int(rng.integers(0, len(b) + 1))
            b[at : at + int(rng.integers(0, 2))] = [f"v{int(x)}" for x in rng.integers(0, 30, int(rng.integers(0, 2)))]
        pairs.append((" ".join(a), " ".join(b) or "x"))
    frame = spark.createDataFrame(pairs, "a string, b string").select("a", "b", line_dedup.similar(F.col("a"), F.col("b"), 0.8).alias("s"))
    for r in frame.collect():
        assert r.s == (edit_distance(r.a, r.b) <= int(max(len(r.a), len(r.b)) * 0.2 + 1e-9)), (r.a, r.b)


def test_line_dedup(spark, docs, empty):
    found = {(r.doc_id, r.text): (r._ld_lines, r._ld_removed) for r in line_dedup.dedup_lines(docs).collect()}
    assert found[0, None] == (0, 0)
    assert found[1, ""] == (1, 0)
    assert found[4, BASE] == (1, 0)
    assert found[5, ""] == found[6, ""] == found[7, ""] == (1, 1)
    assert found[8, "short line"] == (3, 2)  # both long lines are near copies of document 4's
    assert set(line_dedup.dedup_lines(docs).columns) == {*docs.columns, "_ld_lines", "_ld_removed"}
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_against_brute_force(spark):
    """All lines of the smallest documents table, some with edits: groups by edit distance of all pairs."""
    rng = np.random.default_rng(11)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").orderBy("doc_id").limit(60).collect()]
    lines = [x for t in texts for x in t.split("\n") if len(x.split()) >= 6][:250]
    edited = []
    for x in lines[:100]:
        ws = x.split()
        ws[int(rng.integers(0, len(ws)))] = "changed"
        edited.append(" ".join(ws))
    all_lines = lines + edited
    norms = [re.sub(r"[\x00-/:-`{-\x7f]+", " ", x.lower()).strip() for x in all_lines]
    frame = spark.createDataFrame(list(enumerate(norms)), "i int, t string").repartition(4)
    both = frame.toDF("i", "a").crossJoin(frame.toDF("j", "b")).where("j < i")
    most = F.floor(F.greatest(F.length("a"), F.length("b")) * 0.2 + 1e-9).cast("int")
    close = [tuple(r) for r in both.where(F.call_function("levenshtein", F.col("a"), F.col("b"), most) >= 0).select("i", "j").collect()]
    want = components(len(norms), close)
    docs = spark.createDataFrame(list(enumerate(all_lines)), "doc_id long, text string")
    kept = {r.doc_id for r in line_dedup.dedup_lines(docs).where("_ld_removed = 0").collect()}
    roots = {i for i, c in enumerate(want) if i == c}
    assert roots <= kept  # nothing goes that brute force keeps
    gone, wanted = len(norms) - len(kept), len(norms) - len(roots)
    assert wanted >= 90 and gone >= 0.9 * wanted


@pytest.mark.parametrize("n", [8, 12, 20, 40, 80])
def test_line_dedup_finds_lines_with_a_changed_word(spark, n):
    rng = np.random.default_rng(n)
    word = lambda: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(3, 9))))
    rows = []
    for i in range(100):
        line = [word() for _ in range(n)]
        near = list(line)
        at = int(rng.integers(0, n))
        near[at] = near[at][::-1][:-1] + "q"
        rows += [(2 * i, " ".join(line)), (2 * i + 1, " ".join(near))]
    removed = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("_ld_removed = 1")
    gone = [r.doc_id for r in removed.select("doc_id").collect()]
    assert all(i % 2 for i in gone) and len(gone) >= 90


def test_line_dedup_finds_short_lines_with_a_changed_letter_or_a_lost_word(spark):
    """Lines of 4 to 8 words that differ in a letter of one word, of 6 to 8 in two words, or by a short word."""
    rng = np.random.default_rng(23)
    word = lambda: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(5, 9))))
    rows = []
    for kind, lengths in (("letter", (4, 5, 6, 7, 8)), ("letters", (6, 7)), ("lost", (5, 6, 7, 8))):
        for n in lengths:
            for _ in range(40):
                line = [word() for _ in range(n)]
                near, places = list(line), rng.permutation(n)[: 2 if kind == "letters" else 1]
                for at in places:
                    near[at] = near[at][:2] + "0" + near[at][3:]
                if kind == "lost":
                    near = [*line[: places[0]], "ab", *line[places[0] :]]
                rows += [(len(rows), " ".join(line)), (len(rows) + 1, " ".join(near))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {r.doc_id for r in line_dedup.dedup_lines(docs).where("_ld_removed = 1").select("doc_id").collect()}
    assert gone == {i for i, _ in rows if i % 2}


def test_line_dedup_of_short_lines_and_lines_without_spaces(spark):
    chinese = "今天天气很好我们一起去公园散步然后回家吃晚饭看电视节目直到深夜才睡觉"
    texts = ["Read more", chinese, "yes\n--", "read  MORE!", chinese, chinese.replace("晚饭", "午饭"), "yes\n--", "no"]
    found = {r.doc_id: (r.text, r._ld_removed) for r in line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert found == {0: (texts[0], 0), 1: (chinese, 0), 2: (texts[2], 0), 3: ("", 1), 4: ("", 1), 5: ("", 1), 6: ("--", 1), 7: ("no", 0)}


def test_embedding_links(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 16))
    vectors = [c + rng.standard_normal(16) * s for c in centres for s in (0, 0, 0.05, 0.15, 0.25, 0.3)]
    rows = [(i, [float(x) for x in v], i % 2 if i % 50 else None) for i, v in enumerate(vectors)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [1.0, None], 1), (904, rows[2][1], rows[2][2]), (905, [2 * x for x in rows[2][1]], rows[2][2]), (906, [1.0, 2.0], 0), (907, [-0.0, 1.0], 0), (908, [0.0, 3.0], 0)]
    frame = spark.createDataFrame(rows, T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType())]))
    ok = [k for k, (_, v, y) in enumerate(rows) if y is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {k: np.array(rows[k][1]) / np.linalg.norm(rows[k][1]) for k in ok}
    edges = [(a, b) for a in ok for b in ok if a < b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93]
    links = collections.Counter(x for e in edges for x in e)
    want = components(len(rows), edges)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.link_vectors(frame).collect()}
    right = sum(got[rows[k][0]] == (links[k], rows[want[k]][0]) for k in range(len(rows)))
    assert len(got) == len(rows) and right >= 0.95 * len(rows)
    assert sum(n for n, _ in got.values()) <= 2 * len(edges)
    assert embeddings.link_vectors(frame.where("false")).count() == 0


PAGES = [
    (1, "http://h.example/a", '<html><head><title>t</title><style>p{}</style></head><body><nav><a href="/x">menu</a></nav><div class="ad">buy</div><article><h1>Head &amp; more</h1><p><b>first  <i>par</i>a.<br><p>second&nbsp;one &eacute;</article><footer>&copy; foot</footer><script>var a="<p>no</p>";</script></body></html>', "Head & more first para. second one é"),
    (2, None, None, ""),
    (3, "odd url", "", ""),
    (4, "http://h.example/b", "<article><p>text</p><section class='comments'><p>reader says</p></section><form><input>name</form><aside>side</aside><!-- c --></article>", "text"),
    (5, "http://h.example/c", "<article><p>cut off &am", "cut off &am"),
]


def test_embedding_links_in_cells_and_blocks(spark, monkeypatch):
    """Small cells and blocks, pairs about the threshold: no false link, hardly one lost."""
    monkeypatch.setattr(embeddings, "CELL", 64)
    monkeypatch.setattr(embeddings, "BLOCK", 48)
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((200, 32))
    x = np.concatenate([centres, centres + rng.standard_normal((200, 32)) * 0.38, centres[:100] + rng.standard_normal((100, 32)) * 0.3])
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(9000 + i, x[i].tolist(), 1) for i in range(5)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    unit = np.array([v for _, v, _ in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.93
    ids = [i for i, *_ in rows]
    want = close.sum(axis=1) - 1
    found = np.array([got[i][0] for i in ids])
    assert (found <= want).all() and found.sum() >= 0.95 * want.sum() > 100
    roots = components(len(ids), list(zip(*np.nonzero(np.triu(close, 1)))))
    assert sum(got[i][1] == ids[r] for i, r in zip(ids, roots)) >= 0.95 * len(ids)


def test_main_text(spark):
    pages = spark.createDataFrame([p[:3] for p in PAGES], "page_id long, url string, html string")
    got = {r.page_id: r._sst_text for r in site_style_tree.extract_main_text(pages).collect()}
    assert got == {p[0]: p[3] for p in PAGES}
    assert site_style_tree.extract_main_text(pages.where("false")).count() == 0


def test_large_site_teaches_its_furniture(spark):
    """Names say nothing here: only that a branch's contents recur over the host's pages."""
    page = lambda i: f'<body><div class="q1">only {i % 2}</div><div class="q2"><p>unique {i} text {i * i}</p></div></body>'
    pages = spark.createDataFrame([(i, "http://big.example/", page(i)) for i in range(300)], "page_id long, url string, html string")
    got = {r.page_id: r._sst_text for r in site_style_tree.extract_main_text(pages).collect()}
    assert got == {i: f"unique {i} text {i * i}" for i in range(300)}


def test_lm_scores(spark, docs, empty):
    known = docs.where("doc_id < 10 AND doc_id > 0")
    rows = {r.doc_id: r for r in lm_scoring.cross_entropy_difference(known, F.col("doc_id") == 4).collect()}
    codec = vocab.Encoder(vocab.word_bpe())
    ids = {i: [lm_scoring.BEGIN, *codec.tokenizer.encode(TEXTS[i], add_special_tokens=False).ids] for i in range(1, 10)}
    pairs = {i: list(zip(x, x[1:])) for i, x in ids.items()}
    v, s = len(codec.n_bytes), lm_scoring.SMOOTHING
    models = {"target_loss": [4], "background_loss": [i for i in ids if i != 4]}
    sizes = {name: sum(len(pairs[i]) for i in use) for name, use in models.items()}
    for name, use in models.items():
        scale = min(sizes.values()) / sizes[name]
        for i, ps in pairs.items():
            both = collections.Counter(p for j in use if j != i for p in pairs[j])
            first = collections.Counter(p[0] for j in use if j != i for p in pairs[j])
            want = -sum(np.log((scale * both[p] + s) / (scale * first[p[0]] + s * v)) for p in ps) / max(len(ps), 1)
            assert abs(rows[i][name] - want) < 1e-9
    assert rows[1].score == 0 and rows[1].n_tokens == 0
    assert lm_scoring.cross_entropy_difference(empty, F.lit(True)).count() == 0


def test_marginals_are_those_of_all_labellings():
    rng = np.random.default_rng(2)
    unary, moves = rng.standard_normal((1, 5, 2)), rng.standard_normal((2, 2))
    weight = collections.defaultdict(float)
    for code in range(32):
        y = [code >> k & 1 for k in range(5)]
        score = np.exp(sum(unary[0, t, y[t]] for t in range(5)) + sum(moves[a, b] for a, b in zip(y, y[1:])))
        for t in range(5):
            weight[t, y[t]] += score
    want = [weight[t, 1] / (weight[t, 0] + weight[t, 1]) for t in range(5)]
    assert np.allclose(line_crf.marginals(unary, np.array([5]), moves)[0], want)
    padded = np.concatenate([unary, np.full((1, 3, 2), 9.0)], axis=1)
    assert np.allclose(line_crf.marginals(padded, np.array([5]), moves)[0, :5], want)


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    scored = line_crf.classify_quality(spark.read.parquet(f"{sf}/documents.parquet"), labels, ~held)
    rows = scored.join(labels, "doc_id").where(held).collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    none = line_crf.classify_quality(spark.createDataFrame([(1, None), (2, "x")], "doc_id long, text string"), labels.where("false"), F.lit(True))
    assert {r.score for r in none.collect()} == {0.5}


@pytest.mark.parametrize(
    "odd", ['<svg-icon name="x"></svg-icon>', '<svg class="i"/>', '<math/>', '<video-player>', '<template-x></template-x>', '<video src="a">', '<iframe src="b">', '<svg><text>no</text></svg>', '<VIDEO title="a>b">no</Video >']
)
def test_text_after_raw_elements_stays(odd):
    blocks, _ = site_style_tree.walk(f"<article>{odd}<p>first</p><p>second</p></article>")
    assert [text for *_, text in blocks] == ["first", "second"]


def test_host_size_does_not_turn_the_verdict(spark):
    """Comments of each page's own and articles that are copied, told by names and not, on two hosts."""
    def page(i, articles, tag):
        return f'<body><div class="menu2">home</div><{tag} id="post-{i}"><p>article {i % articles} says {i % articles * 7}</p></{tag}><div class="comments"><p>reader {i} says {i * i}</p></div></body>'

    for tag, articles in (("article", 50), ("article", 1), ("div", 50)):
        rows = [(i, f"http://h{n}.example/", page(i, articles, tag)) for n in (100, 10_000) for i in range(n)]
        pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
        got = {(r.url, r.page_id, r._sst_text) for r in site_style_tree.extract_main_text(pages).collect()}
        assert got == {(u, i, f"article {i % articles} says {i % articles * 7}") for i, u, _ in rows} if articles > 1 else {t.removeprefix("home ") for *_, t in got} == {"article 0 says 0"}


@pytest.mark.parametrize("piece", ["<a ", "<p '", '<div "', "<!-- ", "<svg ", "<script>", "< ", "<i>"])
def test_walk_is_linear(piece):
    began = time.perf_counter()
    site_style_tree.walk(piece * 200_000)
    assert time.perf_counter() - began < 10


def test_tree_decides_without_names(spark):
    """Elements and classes that tell nothing give the same text as those that do; the tree decides it."""
    def page(i, names):
        menu = "".join(f"<li>{w}</li>" for w in ("home", "about", "contact"))
        texts = "".join(f"<p>story {i * 31 % 997} of {i * 7 + k} and {i * i + k} more</p>" for k in range(2 + i % 4))
        nav, ad, main, foot = names
        return f"<body><{nav}><ul>{menu}</ul></{nav.split()[0]}><{ad}>buy now</{ad.split()[0]}><{main}><h1>title {i * 13} of {i + 5}</h1>{texts}</{main.split()[0]}><{foot}>&copy; site &middot; word{i} and{i * 3}</{foot.split()[0]}></body>"

    told, untold = ("nav", 'div class="ad"', "article", "footer"), ('div class="x1"', 'div class="x2"', 'div class="x3"', 'div class="q"')
    rows = [(i, f"http://{host}.example/", page(i, names)) for host, names in (("told", told), ("untold", untold)) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {(r.url, r.page_id): r._sst_text for r in site_style_tree.extract_main_text(pages).collect()}
    assert all(found["http://told.example/", i] == found["http://untold.example/", i] != "" for i in range(40))
    assert found["http://told.example/", 1].startswith("title 13 of 6 story 31 of 7") and "site" not in found["http://told.example/", 1]
    tree = site_style_tree.style_tree(pages.select(F.col("url").alias("host"), "html")).where("state = 0 AND host LIKE '%untold%'").collect()
    assert sum(r.odds < 0 for r in tree) == 3 and sum(r.odds >= 0 for r in tree) == 2
