"""Language identification, cross-tokenizer alignment and ranked search: brute force, edge cases, held-out accuracy."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from binloom.llm import alignment, language_crf, max_sketch
from binloom.llm.labelled import fold

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = "ab Z.é\n\t  '’0ñ字<|>endoftext▁ 　ﬁ½😀\r\x00‍́"


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def odd_texts(seed, n, longest=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def documents(spark, rows):
    """doc_id and text with further columns of clashing names."""
    return spark.createDataFrame([(i, t, "r", 7, 0.5, "en", 3) for i, t in rows], "doc_id long, text string, row string, n int, score double, lang string, pair int")


# Alignment


def groups_by_hand(t, text):
    """Ids of both sides by group, and the counted links, by the definition."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    out = []
    for x in text:
        a, b = (tok.encode(" " + x, add_special_tokens=False).ids, t.model_b.encode(x)) if x else ([], [])
        a_bytes, b_bytes = [t.a_bytes[i] for i in a], [t.b_bytes[i] for i in b]
        if not x or b"".join(a_bytes) != (" " + x).encode() or b"".join(b_bytes) != (" " + x).encode():
            out.append(([], Counter()))
            continue
        a_ends, b_ends = np.cumsum([len(v) for v in a_bytes]).tolist(), np.cumsum([len(v) for v in b_bytes]).tolist()
        groups, i, j = [], 0, 0
        for c in sorted(set(a_ends) & set(b_ends)):
            i2, j2 = a_ends.index(c) + 1, b_ends.index(c) + 1
            groups.append((a[i:i2], b[j:j2]))
            i, j = i2, j2
        links = Counter()
        a_from, b_from = [0, *a_ends], [0, *b_ends]
        for p in range(len(a)):
            for q in range(len(b)):
                if a_from[p] < b_ends[q] and b_from[q] < a_ends[p]:
                    links[a[p], b[q]] += 1
        out.append((groups, links))
    return out


def aligned_by_hand(t, rows):
    found = groups_by_hand(t, [x for _, x in rows])
    counts = Counter(p for _, links in found for p in links)
    top = Counter()
    for (a, _), n in counts.items():
        top[a] = max(top[a], n)
    out = []
    for (i, _), (groups, links) in zip(rows, found, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        best = sum(n for p, n in links.items() if counts[p] == top[p[0]])
        out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(links.values()), best, sum(n * counts[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


def test_alignment_matches_brute_force(spark):
    texts = [None, "", " ", "a", "a ", " a", "\n", "x\n y", "<|endoftext|>", "</s> <unk> <0x41>", "ﬁ ligature", "the the the", "the the the", "é", "word " * 40]
    texts += odd_texts(1, 120, 40) + [r.text[:400] for r in table(spark, "documents").orderBy("doc_id").limit(30).collect()]
    rows = [*enumerate(texts), (3, "again the same id"), (None, "no id the")]
    t = alignment.tokenizers(A, B)
    want = aligned_by_hand(t, rows)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    for limit in (1 << 20, 40 * alignment.PAIR_BYTES, 0):
        got = alignment.scored(documents(spark, rows), A, B, limit=limit)
        assert got.columns == names
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    spans = {r.doc_id: r for r in alignment.spans(documents(spark, [(1, texts[-1]), (2, None)]), A, B).collect()}
    (groups, _), s = groups_by_hand(t, [texts[-1]])[0], spans[1]
    cuts = zip([0, *s.a_cuts], s.a_cuts, [0, *s.b_cuts], s.b_cuts, strict=False)
    assert [(s.a[i:j], s.b[k:m]) for i, j, k, m in cuts] == groups
    assert spans[2].a == spans[2].b_cuts == []


def test_alignment_of_a_long_text():
    rng = random.Random(5)
    t = alignment.tokenizers(A, B)
    for text in ("".join(rng.choice("abcdefgh") for _ in range(30_000)), " ".join(rng.choice(("alpha", "betaζ", "😀x")) for _ in range(30_000))):
        n_a, n_b, n_groups, n_links, _, packed = alignment.aligned(t, [text, None])[0]
        a, b = t.encode(text)
        both = np.intersect1d(np.cumsum(t.a_len[a]), np.cumsum(t.b_len[b]))
        assert (n_a, n_b, n_groups) == (len(a), len(b), len(both))
        assert n_links == n_a + n_b - n_groups == (packed & ((1 << alignment.HALF) - 1)).sum()


@pytest.mark.parametrize("seed", range(4))
def test_common_cuts_are_all_common_ends(seed):
    rng = np.random.default_rng(seed)
    a_ends, b_ends, a_stop, b_stop, want, at = [], [], [], [], [], 0
    for _ in range(30):
        size = int(rng.integers(1, 200))
        a, b = (np.unique(np.append(rng.integers(1, size + 1, rng.integers(0, size)), size)) for _ in range(2))
        want += [at + c for c in np.intersect1d(a, b)]
        a_ends, b_ends = [*a_ends, *(at + a)], [*b_ends, *(at + b)]
        a_stop, b_stop, at = [*a_stop, len(a_ends)], [*b_stop, len(b_ends)], at + size
    a_cut, b_cut = alignment.common_cuts(*(np.array(x) for x in (a_ends, b_ends, a_stop, b_stop)))
    assert [a_ends[c - 1] for c in a_cut] == [b_ends[c - 1] for c in b_cut] == want


def test_fast_encoder_equals_the_file():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(A)
    own.encode_special_tokens = True
    encode, tokens = alignment._byte_level(A)
    for x in odd_texts(9, 3000):
        ids = encode(" " + x)
        assert ids == own.encode(" " + x, add_special_tokens=False).ids
        assert b"".join(tokens[i] for i in ids) == (" " + x).encode()


def test_alignment_of_nothing(spark):
    assert alignment.scored(documents(spark, []), A, B).count() == 0


# Ranked search


def ranked_by_hand(docs, items, k=20):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    found = [(i, Counter(cut(t))) for i, t in docs if i is not None]
    found = [(i, c) for i, c in found if c]
    n_docs, total = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    wanted = defaultdict(list)
    for i, t in items:
        if i is not None:
            wanted[i] += cut(t)
    out = []
    for item, ts in wanted.items():
        scores = []
        for i, c in found:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // total
            scores.append((-sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in ts if t in c), i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k]) if s < 0]
    return sorted(out)


@pytest.mark.parametrize("settings", [max_sketch.Settings(), max_sketch.Settings(cells=1, hashes=1, most_cells=64, block_bytes=600)])
def test_search_matches_brute_force(spark, settings):
    rng = random.Random(4)
    common, rare = ["the", "of", "And", "é", "x1"], [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(common if rng.random() < 0.5 else rare) + rng.choice(["", ".", ",", "-"]) for _ in range(n))
    docs = [(i, text(rng.choice([0, 1, 5, 40, 400]))) for i in range(200)] + [(500 + i, "the copy w1 w2 w3") for i in range(45)]
    docs += [(700, None), (701, ""), (702, " .,;\x00\x7f"), (None, "w1 w2 w3"), (7, "w1 w2 w3 again"), (7, "w1 w2 w3 again"), (703, "w5 " * 1000), (704, "The THE the")]
    items = [(1, "w1 w2 w3"), (2, "the the of"), (3, None), (4, ""), (5, "nowhere"), (6, "w5 w5 é x1"), (7, text(30)), (8, text(60)), (None, "w1"), (1, "copy"), (9, "!!")]
    df = spark.createDataFrame([(i, t, 5, 0) for i, t in items], "item_id long, text string, rank int, item int")
    got = max_sketch.search(spark, documents(spark, docs), df, s=settings)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == ranked_by_hand(docs, [(1, "w1 w2 w3 copy"), *items[1:9], items[10]])


def test_search_of_nothing(spark):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert max_sketch.search(spark, documents(spark, []), items).count() == 0
    assert max_sketch.search(spark, documents(spark, [(1, "a"), (2, "b")]), items.limit(0)).count() == 0
    assert [tuple(r) for r in max_sketch.search(spark, documents(spark, [(1, "a"), (2, "b")]), items).collect()] == ranked_by_hand([(1, "a"), (2, "b")], [(1, "a")])


def test_bounds_hold_and_a_stored_index_serves_again(spark):
    docs, items = table(spark, "documents"), table(spark, "benchmark")
    indexed = max_sketch.index(docs).cache()
    again = max_sketch.search(spark, docs, items, k=5, indexed=indexed)
    want = ranked_by_hand([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 5)
    assert sorted(map(tuple, again.collect())) == want
    cells = {r.doc_id: r.sketch for r in indexed.collect()}
    for r in docs.limit(40).collect():
        tf = Counter(max_sketch.terms(r.text.encode()))
        hashes = max_sketch.WordHashes()
        got = np.frombuffer(cells[r.doc_id], np.uint8)
        hashed = np.frombuffer(b"".join(hashes[t] for t in tf), "<u8")
        least = got[max_sketch._cells(hashed, len(got), 3)].min(0)
        assert (least >= np.minimum(list(tf.values()), 255)).all()
        if len(got) < max_sketch.Settings().most_cells:
            assert (least == np.minimum(list(tf.values()), 255)).mean() > 0.9


# Languages


def test_marginals_match_sums_over_all_paths():
    import itertools

    rng = np.random.default_rng(2)
    moves, start = rng.normal(size=(3, 3)), rng.normal(size=3)
    many = np.array([1, 5, 2])
    emitted = rng.normal(size=(8, 3)) * 2
    got, at = language_crf.marginals(emitted, many, moves, start), 0
    for n in many:
        e, p = emitted[at : at + n], np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            w = math.exp(start[path[0]] + sum(e[t, k] for t, k in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
            for t, k in enumerate(path):
                p[t, k] += w
        assert np.allclose(p / p.sum(1, keepdims=True), got[at : at + n], atol=1e-12)
        at += n


@pytest.mark.parametrize("block", [1, 3, 64])
def test_marginals_do_not_depend_on_blocks(monkeypatch, block):
    rng = np.random.default_rng(3)
    many, moves, start = np.array([130, 1, 64, 65, 200, 3]), rng.normal(size=(4, 4)), rng.normal(size=4)
    emitted = rng.normal(size=(many.sum(), 4)) * 20
    monkeypatch.setattr(language_crf, "BLOCK", 1000)
    want = language_crf.marginals(emitted, many, moves, start)
    monkeypatch.setattr(language_crf, "BLOCK", block)
    assert np.allclose(language_crf.marginals(emitted, many, moves, start), want, atol=1e-9)


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(4)
    emitted, moves, start = rng.normal(size=(2, 5, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)

    def log_sum(moves):
        total = 0.0
        for e in emitted:
            a = start + e[0]
            for x in e[1:]:
                a = np.logaddexp.reduce(a[:, None] + moves, axis=0) + x
            total += np.logaddexp.reduce(a)
        return total

    _, both = language_crf._expected(emitted, moves, start)
    for i in range(3):
        for j in range(3):
            d = np.zeros((3, 3))
            d[i, j] = 1e-5
            assert abs((log_sum(moves + d) - log_sum(moves - d)) / 2e-5 - both[i, j]) < 1e-6


def test_words_of_texts():
    texts = [None, "", "12 -- 3", "Ñandú's x1y", "éa ́ b", "ab" * 40]
    w = language_crf.words_of(texts)
    got = [(int(t), int(at), "".join(map(chr, w.cells[f : f + n]))) for t, at, f, n in zip(w.text, w.at, w.first, w.size, strict=True)]
    assert got == [(3, 0, "ñandú"), (3, 6, "s"), (3, 8, "x"), (3, 10, "y"), (4, 0, "éa"), (4, 6, "b"), (5, 0, "ab" * 40)]
    same = language_crf.words_of(["Ab ab AB ba abab"])
    h = language_crf.word_hashes(same)
    assert h[0] == h[1] == h[2] and len(set(h.tolist())) == 3


def test_languages_held_out_and_switched(spark):
    docs = table(spark, "documents", "/root/testdata/sf0.01")
    held = fold(F.col("doc_id"), 4) == 2
    model = language_crf.fit(docs, ~held)
    assert model.langs == ("de", "en", "es", "fr")
    rows = language_crf.predict(docs, model).join(docs.select("doc_id", "lang", "text"), "doc_id").where(held).collect()
    right = [r.lang_pred == r.lang for r in rows if re.search(r"[^\W\d_]", r.text)]
    assert sum(right) >= 0.97 * len(right) > 100
    assert all(0 <= r.score <= 1 for r in rows)
    rng, texts = random.Random(6), [r for r in rows if len(r.text.split()) > 60]
    mixed, gold = [], []
    for _ in range(60):
        parts = []
        for _ in range(4):
            r = rng.choice(texts)
            words = r.text.split()
            at = rng.randrange(len(words) - 20)
            parts.append((" ".join(words[at : at + rng.randint(5, 15)]), r.lang))
        mixed.append(" ".join(p for p, _ in parts))
        gold.append([lang for p, lang in parts for _ in range(len(language_crf.words_of([p]).first))])
    found = {r.doc_id: r.spans for r in language_crf.spans(documents(spark, list(enumerate(mixed))), model).collect()}
    hits = total = 0
    for i, text in enumerate(mixed):
        at = language_crf.words_of([text]).at
        said = [next(s.lang for s in found[i] if s.start <= p < s.stop) for p in at]
        hits, total = hits + sum(x == y for x, y in zip(said, gold[i], strict=True)), total + len(said)
    assert hits >= 0.95 * total


def test_languages_of_odd_rows(spark):
    docs = table(spark, "documents")
    model = language_crf.fit(docs, F.lit(True))
    rows = [(1, None), (2, ""), (3, "12 -- 99 !!"), (4, "the and of " * 20_000), (None, "the and of"), (5, "the and of"), (5, "the and of"), (6, "字字 漢"), (7, "x" * 100_000)]
    got = language_crf.predict(documents(spark, rows), model)
    assert got.columns == ["doc_id", "lang_pred", "score"]
    by_id = defaultdict(list)
    for r in got.collect():
        by_id[r.doc_id].append((r.lang_pred, r.score))
    assert by_id[1] == by_id[2] == by_id[3] == [("und", 0.0)]
    assert by_id[4][0][0] == by_id[None][0][0] == "en" and by_id[5] == by_id[None] * 2
    assert all(p in model.langs for i in (6, 7) for p, _ in by_id[i])
    assert language_crf.predict(documents(spark, []), model).count() == 0
    none = language_crf.fit(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert {(r.lang_pred, r.score) for r in language_crf.predict(documents(spark, rows), none).collect()} == {("und", 0.0)}
    one = language_crf.fit(docs.withColumn("lang", F.lit("xx")), F.lit(True))
    assert {(r.lang_pred, r.score) for r in language_crf.predict(documents(spark, rows[3:]), one).collect()} == {("xx", 1.0)}
