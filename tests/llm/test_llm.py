"""The corpus operators on small inputs: edge cases, brute force, round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from binloom.llm import chat, decontaminate, html_text, jaccard_join, labelled, line_dedup, packing, quality_model, quality_rules, token_output, toxicity
from binloom.llm.components import components
from binloom.llm.queries import word_tokenizer
from binloom.llm.tokens import Encoder

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, keep string, row string, n_lines int, score double, label string, key string"


def documents(spark, rows):
    """doc_id and text with further columns of clashing names."""
    return spark.createDataFrame([(i, t, "k", "r", 7, 0.5, "l", "y") for i, t in rows], DOCS)


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


WORDS = [w + e for w in ("ab", "cor", "del", "esto", "fin", "gra", "hul", "im", "jok", "kel", "lum", "mer") for e in ("a", "en", "is", "or", "um")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# Line dedup


def dedup_by_hand(rows, min_chars=20, min_docs=3):
    ws = " \t\n\x0b\f\r"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    where = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(k := x.strip(ws).translate(low)) >= min_chars:
                where[k].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(where.get(k := x.strip(ws).translate(low), ())) < min_docs or i == max(where[k])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(1)
    common = [prose(rng, 6) for _ in range(4)] + ["Ä COMMON line WITH É and more", "short"]
    rows = [(i, "\n".join(rng.choice(common) + rng.choice(["", " ", "\t\r"]) if rng.random() < 0.5 else prose(rng, 5) for _ in range(rng.randrange(0, 9)))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, common[0]), (7, rows[7][1]), (102, "\n".join([common[1]] * 50)), (103, common[1].upper()), (104, "\n\n")]
    df = documents(spark, rows)
    for send in (1 << 20, 0):
        bitmaps = line_dedup.keep_bitmaps(df, send=send)
        got = line_dedup.kept(df, bitmaps).select("doc.doc_id", "n_lines", "n_dropped", "text")
        assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()), key=repr) == dedup_by_hand(rows)
    out = line_dedup.apply_bitmaps(df, bitmaps)
    assert out.columns == df.columns
    assert {(r.keep, r.row, r.n_lines) for r in out.collect()} == {("k", "r", 7)}


def test_line_dedup_of_nothing(spark):
    df = documents(spark, [])
    assert line_dedup.apply_bitmaps(df, line_dedup.keep_bitmaps(df)).count() == 0


# Quality rules


def rules_by_hand(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_match_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", "  \n\t ", "a", "a b c d e", "x y z x y z x y z x y z", "a a a a a a a a a a a", "é # $ | <b> & \n\n\nx\nx\n x", "w v\x1cu " * 12]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(40))) for _ in range(80)]
    df = documents(spark, list(enumerate(texts)))
    got = {r.doc_id: r for r in quality_rules.judge(df).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], rules_by_hand(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.kept and r.base_failed)
    assert quality_rules.judge(documents(spark, [])).count() == 0


def test_quality_rules_keep_good_labels(spark):
    kept = quality_rules.judge(table(spark, "documents")).join(table(spark, "labels"), "doc_id")
    good = kept.where("quality = 1 and not base_failed")
    assert good.where("kept").count() >= 0.95 * good.count()


# Tokens, packing


def test_encoder_equals_the_tokenizer():
    enc = Encoder(word_tokenizer())
    assert enc.by_chunk
    rng = random.Random(3)
    alphabet = "abcXYZéßÜñÇ'’-.,!?|%$#<>0129\x1c\x85 　 \n\t́İΣςĳ漢字😀½²" + "'s't're<|endoftext|>"
    texts = ["", " ", "It's 12ab <|endoftext|>x<|startoftext|>", "a" * 500, "ΑΣ Σ", "é ́x", "<|>"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)]
    for t in texts:
        ids = enc.tokenizer.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(enc(t), "<u4").tolist() == ids, repr(t)
    assert enc(None) == b""


def test_token_files_round_trip(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randrange(80))) for i in rng.sample(range(1000), 120)] + [(5000, None), (5001, ""), (5002, prose(rng, 9000)), (None, "lost"), (-3, "first")]
    df = documents(spark, rows)
    got = sorted(token_output.round_trip(spark, df, word_tokenizer()).collect(), key=lambda r: r.doc_id)
    enc, start = Encoder(word_tokenizer()), 0
    want = sorted((i, t) for i, t in rows if i is not None)
    assert [r.doc_id for r in got] == [i for i, _ in want]
    for r, (_, t) in zip(got, want, strict=True):
        ids = enc(t) + (1).to_bytes(4, "little")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids) // 4, zlib.crc32(ids))
        start += r.n_tokens
    assert token_output.round_trip(spark, documents(spark, []), word_tokenizer()).count() == 0


def test_token_files_are_read_selectively(spark, tmp_path):
    rows = [(i, f"text number {i}") for i in range(50)]
    token_output.write_tokens(documents(spark, rows), str(tmp_path / "t"), word_tokenizer())
    some = token_output.read_tokens(spark, str(tmp_path / "t"), 10, 19)
    assert sorted(r.doc_id for r in some.collect()) == list(range(10, 20))
    plan = some.select("doc_id", "start", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,10)" in plan


def check_packing(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, int(rng.expovariate(0.02)))) for i in range(150)] + [(900, None), (901, prose(rng, 1500)), (None, "x")] + [(i, "same words here") for i in range(1000, 1200)]
    got = packing.pack(spark, documents(spark, rows), word_tokenizer(), capacity=128).collect()
    enc = Encoder(word_tokenizer())
    own = defaultdict(list)
    for r in got:
        own[r.doc_id].append(r)
    assert set(own) == {i for i, _ in rows if i is not None}
    for i, t in rows:
        if i is None:
            continue
        ids, at = enc(t) + bytes(4), 0
        for k, r in enumerate(sorted(own[i], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(ids[4 * at : 4 * (at + r.length)]))
            at += r.length
        assert 4 * at == len(ids)
    used = check_packing(got, 128)
    assert used == first_best([r.length for r in got], 128)
    assert packing.pack(spark, documents(spark, []), word_tokenizer()).count() == 0


def first_best(lengths, capacity):
    """Best-fit decreasing, one piece at a time."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(20))
def test_supersteps_equal_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 100])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randrange(1, 200))] + [rng.randint(1, capacity)] * rng.randrange(100)
    sizes = {n: lengths.count(n) for n in set(lengths)}
    fill, ranks = defaultdict(list), defaultdict(set)
    for length, lo, hi, first, each, offset in packing.match(sizes, capacity):
        for r in range(lo, hi):
            assert r not in ranks[length]
            ranks[length].add(r)
            fill[first + (r - lo) // each].append((offset + (r - lo) % each * length, length))
    assert all(ranks[n] == set(range(c)) for n, c in sizes.items())
    for v in fill.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= capacity
    assert len(fill) == first_best(lengths, capacity)


# Jaccard join


def shingles(t, k=4):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()


def join_by_hand(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def near_rows(seed, groups=8, size=14, words=60):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = prose(rng, rng.randrange(4, words)).split()
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            rows.append(" ".join(w[rng.randrange(2) :]))
    rng.shuffle(rows)
    texts = [*rows, None, "", "one", "ONE", "two words", "É x", "é x", rows[0].upper(), rows[1] + " tail", rows[2]]
    return list(enumerate(texts))


@pytest.mark.parametrize("settings", [jaccard_join.Settings(), jaccard_join.Settings(frequent=3, often=4, room=1400, pivots=2, window=500), jaccard_join.Settings(room=900, send=0)])
def test_jaccard_join_matches_brute_force(spark, settings):
    rows = near_rows(6) + [(None, "no id")]
    got = jaccard_join.joined(spark, documents(spark, rows), settings)
    assert sorted(tuple(r) for r in got.collect()) == join_by_hand(rows)


def test_part_files_are_numbered_not_spelled(spark):
    names = [f"part-{n:05d}-c000.snappy.parquet" for n in (7, 99_999, 100_000, 1_000_000)]
    df = spark.createDataFrame([(n,) for n in reversed(names)], "file string")
    assert [r.file for r in df.orderBy(token_output.part_number(F.col("file"))).collect()] == names != sorted(names)


def test_jaccard_join_of_nothing(spark):
    assert jaccard_join.joined(spark, documents(spark, [])).count() == 0
    assert [tuple(r) for r in jaccard_join.joined(spark, documents(spark, [(1, None)])).collect()] == [(1, 0, 1)]


def test_jaccard_join_of_repeated_ids(spark):
    a, b = "one two three four five six seven eight", "nine ten eleven twelve thirteen"
    rows = [(5, a), (5, b), (7, a), (3, b), (9, "else"), (9, "else")]
    got = sorted(tuple(r) for r in jaccard_join.joined(spark, documents(spark, rows)).collect())
    assert got == [(3, 2, 3), (5, 2, 3), (5, 5, 3), (7, 5, 3), (9, 1, 9), (9, 1, 9)]


@pytest.mark.parametrize("asking", [False, True])
@pytest.mark.parametrize("seed", range(10))
def test_search_finds_every_component(seed, asking):
    rng = random.Random(seed)
    rows = near_rows(seed, groups=3, size=12, words=40)
    hashes = jaccard_join.WordHashes()
    sets = [x for _, t in rows if len(x := jaccard_join.shingle_set((t or "").encode(), 4, hashes))]
    asks = [rng.random() < 0.3 for _ in sets] if asking else [True] * len(sets)
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in jaccard_join.search(sets, 85, asks if asking else None):
        x, y = set(sets[a].tolist()), set(sets[b].tolist())
        assert 100 * len(x & y) >= 85 * len(x | y)
        assert find(a) != find(b)
        parent[find(a)] = find(b)
    for a in range(len(sets)):
        for b in range(a):
            x, y = set(sets[a].tolist()), set(sets[b].tolist())
            if (asks[a] or asks[b]) and 100 * len(x & y) >= 85 * len(x | y):
                assert find(a) == find(b)


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 140)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}


# Decontamination


def test_decontamination_tolerates_substitutions(spark):
    rng = random.Random(7)
    items = [(i, prose(rng, 30)) for i in range(12)] + [(50, None), (51, ""), (52, "too short"), (3, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    clean = [(i, prose(rng, 200)) for i in range(40)]
    leaks = []
    for i in range(12):
        w = items[i][1].split()
        for k in (4, 13, 22):
            w[k] = "CHANGED"
        leaks.append((100 + i, f"{prose(rng, 20 * i)} {' '.join(w).upper()}\n{prose(rng, 30)}"))
    rows = clean + leaks + [(200, None), (201, ""), (None, items[0][1]), (202, items[5][1]), (202, items[5][1])]
    df = documents(spark, rows)
    got = {r.doc_id: r.contaminated for r in decontaminate.verdicts(df, bench).collect()}
    assert {i for i, c in got.items() if c} == {i for i, _ in leaks} | {202}
    assert decontaminate.clean(df, bench).columns == df.columns
    assert decontaminate.clean(df, bench).count() == len(rows) - len(leaks) - 2
    assert decontaminate.verdicts(df, bench.where("false")).where("contaminated").count() == 0
    assert decontaminate.verdicts(df.where("false"), bench).count() == 0


def test_masks_meet_every_accepted_overlap():
    seeds = decontaminate.Seeds()
    masks = [[i for i, bit in enumerate(m) if bit == "1"] for m in seeds.masks]
    for n in range(seeds.min_words, seeds.window + 1):
        most = max(k for k in range(n) if (n - k) / n >= seeds.min_match)
        for changed in itertools.combinations(range(n), most):
            same = set(range(n)).difference(changed)
            assert any(all(q + k in same for k in m) for m in masks for q in range(n - m[-1])), (n, changed)


def overlaps_by_hand(text, item, window=16, share=0.75, least=8):
    """The best share over every window of the item on every diagonal; 0 below the threshold, which is all of a short item."""
    w, x = (t.lower().split() for t in (text or "", item or ""))
    span, best = min(len(x), window), 0.0
    share = share if len(x) >= least else 1.0
    for d in range(-len(x) + 1, len(w)) if x else ():
        same = [0 <= i + d < len(w) and w[i + d] == y for i, y in enumerate(x)]
        best = max(best, max(sum(same[q : q + span]) for q in range(len(x) - span + 1)) / span)
    return best if best >= share else 0.0


@pytest.mark.parametrize("send", [1 << 26, 0])
def test_decontamination_matches_brute_force(spark, send):
    rng = random.Random(17)
    items = {i: prose(rng, n) for i, n in enumerate([3, 6, 7, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 20, 24, 30, 8, 12, 16, 16])}
    texts = []
    for x in items.values():
        w = x.split()
        for at in range(4):  # every fourth word changed, at each offset
            texts.append([v if k % 4 != at else "changed" for k, v in enumerate(w)])
        for _ in range(14):  # words changed at random, about as many as the threshold allows
            cut = set(rng.sample(range(len(w)), rng.choice([len(w) // 4, len(w) // 4 + 1, max(len(w) // 4 - 1, 0)])))
            texts.append([v if k not in cut else "changed" for k, v in enumerate(w)])
        texts += [w[2:], w[:-3], w[4:], w[:12] + ["changed"] * 4]  # text that ends inside the item
    rows = [(i, " ".join([*prose(rng, i % 5 * 3).split(), *t, *prose(rng, i % 3 * 4).split()])) for i, t in enumerate(texts)]
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    rows.append((len(rows), " ".join([*texts[0], *(prose(rng, 30_000) + " " + items[1]).split()])))  # a very long text
    got = {r.doc_id: (r.n_items, r.best_share) for r in decontaminate.verdicts(documents(spark, rows), bench, send=send).collect()}
    shares = {i: [s for x in items.values() if (s := overlaps_by_hand(t, x))] for i, t in rows}
    assert got == {i: (len(s), max(s, default=0.0)) for i, s in shares.items()}
    assert {sum(bool(s) for s in shares.values()) > 150, any(not s for s in shares.values())} == {True}


# HTML


PAGE = "<html><head><title>t</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href=x>Menu</a></li></ul></nav>"


def test_page_lines():
    html = PAGE + '<!-- note --><div class="ad">Buy</div><article><h1>Title &amp; more</h1><p>One <b>two<br>three</b>&nbsp;four<p>Five\n six</p><aside>side</aside><div class="comments"><p>I agree</p></div></article><footer>&copy;</footer>'
    assert [t for t, _ in html_text.page_lines(html)] == ["Title & more", "One two three four", "Five six"]
    assert html_text.page_lines(None) == html_text.page_lines("") == []
    assert [t for t, _ in html_text.page_lines("plain &lt;b&gt; text &#xe9; &bogus; < 3")] == ["plain <b> text é &bogus; < 3"]
    assert [t for t, _ in html_text.page_lines("<p>a<script>if (a<b) {}</script>b<p>c<div>d</div></p>e")] == ["a", "b", "c", "d", "e"]


@pytest.mark.parametrize("seed", range(30))
def test_common_lines_are_longest(seed):
    rng = random.Random(seed)
    a, b = ([rng.randrange(6) for _ in range(rng.randrange(14))] for _ in range(2))
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    p, q = html_text.common_lines(a, b)
    assert len(p) == best[-1][-1] and [a[i] for i in p] == [b[j] for j in q]
    assert p == sorted(set(p)) and q == sorted(set(q))


def test_shared_lines_of_nearest_urls_go(spark):
    rng = random.Random(8)
    top, end = "Welcome to our little site of texts", "All rights are reserved by somebody here"
    bodies = {i: [prose(rng, 12) for _ in range(4)] for i in range(40)}
    page = lambda i: f"<body><div>{top}</div>" + "".join(f"<p>{x}</p>" for x in bodies[i]) + f"<div>{end}</div></body>"
    rows = [(i, f"http://host{i % 2}.org/a/{i:03d}?q=1", page(i), "x") for i in range(40)]
    rows += [(100, None, f"<p>{top}</p>", "x"), (101, "http://[bad", f"<p>{end}</p>", "x"), (102, "http://alone.org/", f"<p>{top}</p>", "x"), (103, "http://host0.org/z", None, "x"), (0, *rows[0][1:])]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert all(by[i] == "\n\n".join(bodies[i]) for i in range(40))
    assert (by[100], by[101], by[102], by[103]) == (top, end, top, "")
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_differencing_decides_inside_articles(spark):
    rng = random.Random(18)
    line, note = "Sign up here to read our texts every day", "Printed with the kind leave of the owner"
    own = {i: [prose(rng, 12) for _ in range(4)] for i in range(30)}
    article = lambda *x: "<body><article>" + "".join(f"<p>{t}</p>" for t in x) + "</article>"
    html = {i: article(own[i][0], line, *own[i][1:]) + f"<div>{note}</div>" for i in range(30)}
    want = {i: own[i] for i in range(30)}
    long = [prose(rng, 40) for _ in range(5)]
    for i in (7, 8):  # near copies: what only they share stays, what the host shares goes
        html[i], want[i] = article(*long, line, own[i][0]) + f"<div>{note}</div>", [*long, own[i][0]]
    heavy = [prose(rng, 30) for _ in range(6)]  # more than half of each page, without an article
    html |= {100 + i: "<body>" + "".join(f"<p>{t}</p>" for t in [*heavy, own[i][0]]) for i in range(20)}
    want |= {100 + i: [own[i][0]] for i in range(20)}
    html |= {200: article(*long), 201: article(*long), 202: article(own[0][0]) + f"<p>{note}</p>"}
    want |= {200: long, 201: long, 202: [own[0][0]]}
    host = lambda i: f"h{i // 100}" if i < 200 else "twins" if i < 202 else "alone"
    rows = [(i, f"http://{host(i)}.org/{i:03d}", h) for i, h in html.items()]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for parts in ("1", "4", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.enabled", "false")  # which would read small partitions as one
        try:
            got = {r.page_id: r.text for r in html_text.extract(df).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        assert got == {i: "\n\n".join(t) for i, t in want.items()}


# Classifiers


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


@pytest.mark.parametrize(("model", "label", "folds", "held", "least"), [(toxicity, "toxic", 5, 0, 0.8), (quality_model, "quality", 3, 1, 0.95)])
def test_held_out_accuracy(spark, model, label, folds, held, least):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    fitted = model.fit(docs, labels, labelled.fold(F.col("doc_id"), folds) != held)
    rows = model.score(docs, fitted).join(labels, "doc_id").where(labelled.fold(F.col("doc_id"), folds) == held).toPandas()
    assert rows.score.between(0, 1).all() and ((rows.score >= 0.5) == (rows.predicted == 1)).all()
    assert auc(rows.score.to_numpy(), rows[label].to_numpy()) >= least
    odd = documents(spark, [(1, None), (2, ""), (None, "x y"), (3, "you idiot " * 5000), (3, "you idiot " * 5000)])
    assert model.score(odd, fitted).where("score between 0 and 1").count() == 5
    assert model.score(docs.where("false"), fitted).count() == 0


@pytest.mark.parametrize("model", [toxicity, quality_model])
def test_no_labels_give_a_constant(spark, model):
    docs = documents(spark, [(1, "a b"), (2, None)])
    labels = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    assert {r.score for r in model.score(docs, model.fit(docs, labels, F.lit(True))).collect()} == {0.0}


def test_shapes_cover_long_chunks():
    assert quality_model.shape("ab/" * 10) == "a/" * 10
    assert quality_model.shape("a1" * 5 + "B") != quality_model.shape("a1" * 5 + "?")


# Chat


def roles_of(parts, model, settings):
    out = defaultdict(list)
    for r in sorted(chat.recover(parts, model, settings).collect(), key=lambda r: (repr(r.conv_id), r.part, r.line)):
        out[r.conv_id] += [r.role] * r.n_lines
    return out


def truth_of(raw):
    truth = defaultdict(list)
    for r in sorted(raw.collect(), key=lambda r: (r.conv_id, r.part)):
        truth[r.conv_id] += r.roles
    return truth


def test_chat_roles_and_turns_do_not_depend_on_blocks(spark):
    raw = chat.transcripts(table(spark, "conversations")).cache()
    model = chat.fit(raw)
    key = lambda r: (r.conv_id, r.part, r.line)
    whole = sorted(chat.recover(raw, model).collect(), key=key)
    small = chat.Settings(block=1, level=2)
    assert len({r.text for r in whole}) > 10 and all(r.opens for r in whole)
    pieces = sorted(chat.recover(raw.repartition(5), model, small).collect(), key=key)
    assert roles_of(raw, model, small) == roles_of(raw, model, chat.Settings())
    assert pieces == whole
    # The same lines, several turns in one part, or one line in each.
    rows = [(r.conv_id, r.part, x) for r in raw.collect() for x in r.text.split("\n")]
    lines = spark.createDataFrame([(c, k, x) for k, (c, _, x) in enumerate(sorted(rows, key=lambda r: r[:2]))], "conv_id long, part long, text string")
    joined = defaultdict(list)
    for c, p, x in sorted(rows, key=lambda r: r[:2]):
        joined[c, p // 3].append(x)
    parts = spark.createDataFrame([(c, p, "\n".join(x)) for (c, p), x in joined.items()], "conv_id long, part long, text string")
    texts = [[r.text for r in sorted(chat.recover(df, model, small).collect(), key=key)] for df in (lines, parts)]
    assert texts[1] == [r.text for r in whole]
    assert "".join(texts[0]).replace("\n", "") == "".join(texts[1]).replace("\n", "")


def test_chat_accuracy_on_held_out_conversations(spark):
    """Marked lines are right throughout. Bare lines tell roles by their lengths alone."""
    raw = chat.transcripts(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")).withColumn("style", chat.style("conv_id")).cache()
    held = labelled.fold(F.col("conv_id"), 5) == 0
    model = chat.fit(raw.where(~held))
    right = {}
    for bare in (False, True):
        some = raw.where(held & ((F.col("style") == 4) == bare))
        got, want = roles_of(some, model, chat.Settings()), truth_of(some)
        pairs = [(a, b) for c in want for a, b in zip(want[c], got[c], strict=True)]
        right[bare] = sum(a == b for a, b in pairs) / len(pairs)
    assert right[False] == 1.0 and right[True] >= 0.6, right


@pytest.mark.parametrize("seed", range(12))
def test_viterbi_is_the_best_of_all_paths(seed):
    rng = np.random.default_rng(seed)
    n, size = int(rng.integers(1, 6)), len(chat.STATES)
    logs, move, start = rng.normal(size=(n, size)), rng.normal(size=(size, size)), rng.normal(size=size)

    def value(path, entry):
        first = start[path[0]] if entry is None else move[entry, path[0]]
        return first + sum(logs[k, x] for k, x in enumerate(path)) + sum(move[a, b] for a, b in itertools.pairwise(path))

    for entry, leave in ((None, None), (2, None), (None, 3), (1, 4)):
        paths = [p for p in itertools.product(range(size), repeat=n) if leave is None or p[-1] == leave]
        best = max(paths, key=lambda p: value(p, entry))
        assert chat._path(logs, move, entry, start, leave) == list(best)
        ends = chat._unrolled([chat._transfer(e, move, entry is None and k == 0) for k, e in enumerate(np.array_split(logs, min(n, 2)))], entry, start, leave)
        assert [x[1] for x in ends][-1] == best[-1] and ends[0][0] == entry


def test_chat_markers_and_edges(spark):
    raw = chat.transcripts(table(spark, "conversations"))
    model = chat.fit(raw)
    rows = [(1, 0, "User: hi there\nhow are you?\n\nAssistant: fine"), (2, 0, None), (None, 0, "### Human:\nq\n### Assistant:\na"), (1, 1, "Human: again"), (1, 1, "Human: again"), (3, None, "Q: x"), (3, None, "A: " + "y\n" * 5000)]
    df = spark.createDataFrame([(c, p, t, "z") for c, p, t in rows], "conv_id long, part long, text string, role string")
    got = chat.recover(df, model).orderBy("part", "line").collect()
    assert [(r.role, r.opens) for r in got if r.conv_id == 1][:3] == [("user", True), ("assistant", True), ("user", True)]
    assert [r.text for r in got if r.conv_id is None] == ["<|user|>\nq\n", "<|assistant|>\na\n"]
    assert sum(r.n_lines for r in got if r.conv_id == 3) == 5002 and sum(r.n_lines for r in got if r.conv_id == 2) == 1
    assert chat.recover(df.where("false"), model).count() == 0
    assert chat.fit(raw.where("false")).start[0] == chat.fit(raw.where("false")).start[2]


# Pipeline


def test_fleeting_tables_go(spark):
    from binloom.llm.common import fleeting, stored

    made = []
    with fleeting(spark) as keep:
        with fleeting(spark) as keep_inner:
            made += [stored(spark.range(3), "a"), keep_inner(stored(spark.range(4), "b"))]
        assert made[1].count() == 4
        made += [keep(stored(spark.range(5), "c"))]
    with pytest.raises(ZeroDivisionError), fleeting(spark):
        made += [stored(spark.range(6), "d")]
        raise ZeroDivisionError
    assert [Path(df.stored_at).exists() for df in made] == [False, False, True, False]
    assert made[2].count() == 5


def test_pipeline_stages_keep_odd_rows(spark, tmp_path):
    """Nulls in any column, empty texts, repeated rows, an empty table and columns of clashing names in each stage."""
    import corpus_pipeline as cp

    for name in ("benchmark", "labels"):
        table(spark, name).write.parquet(f"{tmp_path}/{name}.parquet")
    rng = random.Random(29)
    text = prose(rng, 60)
    rows = [(1, text, "a"), (1, text, None), (2, None, None), (3, "", "b"), (4, text, "c"), (None, text, "d"), (5, "one", None), (6, "word " * 30_000, "e"), (7, None, None)]
    names = ["n_lines", "n_dropped", "keep", "row", "doc", "_id", "_row", "n", "key", "id", "tokens", "item_id", "diagonal", "score", "predicted", "component_id", "length", "rank", "_salt"]
    schema = "doc_id long, text string, lang string, " + ", ".join(f"{c} int" for c in names)
    odd = spark.createDataFrame([(*r, *range(len(names))) for r in rows], schema)
    for (name, stage), gone in zip(cp.STAGES[:-1], ([], [], [4], []), strict=True):
        out = stage(spark, odd, str(tmp_path))
        assert out.columns == odd.columns and out.dtypes == odd.dtypes, name
        got = sorted(((r.doc_id, r.text or "", r.lang, *r[3:]) for r in out.collect()), key=repr)
        want = sorted(((i, t or "", x, *range(len(names))) for i, t, x in rows if i not in gone), key=repr)
        assert got == want, name
        assert stage(spark, odd.where("false"), str(tmp_path)).count() == 0, name
    packed = cp.pack(spark, odd, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in packed if r.piece == 0) == [1, 1, 2, 3, 4, 5, 6, 7]
    check_packing(packed, 2048)
    assert cp.pack(spark, odd.where("false"), str(tmp_path)).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = table(spark, "documents")
    columns, left = docs.columns, docs.count()
    for name, stage in cp.STAGES[:-1]:
        docs = cp.stored(stage(spark, docs, SF), name)
        assert docs.columns == columns
        now = docs.count()
        assert 0 < now <= left
        left = now
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.iterdir())
    packed = cp.run(spark, SF)
    assert [p.name.rpartition("-")[0] for p in set(folder.iterdir()) - before] == ["stage-packing"]
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids
    check_packing(packed.collect(), 2048)


def leaks_by_hand(text, items, window=16, share=0.75, least=8):
    """Whether a window of an item agrees with the text in place, over all diagonals with words enough in common."""
    where = defaultdict(list)
    for k, v in enumerate((text or "").encode().lower().split()):
        where[v].append(k)
    for x in items:
        item = (x or "").encode().lower().split()
        span, same = min(len(item), window), defaultdict(set)
        for i, v in enumerate(item):
            for k in where.get(v, ()):
                same[k - i].add(i)
        if len(item) >= least and any(sum(q + k in at for k in range(span)) >= share * span for at in same.values() if len(at) >= share * span for q in range(len(item) - span + 1)):
            return True
    return False


def test_pipeline_matches_brute_force(spark, tmp_path):
    import corpus_pipeline as cp

    docs, bench, labels = (table(spark, n) for n in ("documents", "benchmark", "labels"))
    rng, items = random.Random(19), [r.text for r in bench.collect()]
    line = prose(rng, 8)
    near = prose(rng, 80).split()
    leak = " ".join(w if k % 4 != 1 else "changed" for k, w in enumerate(max(items, key=len).split()))
    extra = [f"{prose(rng, 30)}\n{line}\n{prose(rng, 30)}" for _ in range(4)]
    extra += [" ".join(near), " ".join([*near[:40], "other", *near[41:]]), f"{prose(rng, 20)} {leak} {prose(rng, 20)}"]
    first = docs.limit(1).drop("doc_id", "text")
    more = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(extra)], "doc_id long, text string").crossJoin(first)
    docs = docs.unionByName(more.select(*docs.columns))
    for name, df in (("documents", docs), ("benchmark", bench), ("labels", labels)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")

    docs, got = cp.table(spark, str(tmp_path), "documents"), []
    for name, stage in cp.STAGES[:-1]:
        docs = cp.stored(stage(spark, docs, str(tmp_path)), name)
        got.append(sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()))
    accepted, lines, copies, leaks = got
    want = sorted((i, t) for i, _, _, t in dedup_by_hand(accepted))
    assert lines == want != accepted
    sets = {i: shingles(t, 5) for i, t in want}
    pairs = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = {i: i for i in sets}
    while moved := [(a, b) for a, b in pairs if root[a] != root[b]]:
        for a, b in moved:
            root[a] = root[b] = min(root[a], root[b])
    want = [(i, t) for i, t in want if root[i] == i]
    assert copies == want != lines
    want = [(i, t) for i, t in want if not leaks_by_hand(t, items)]
    assert leaks == want != copies
    assert 10**6 + 6 in dict(copies) and 10**6 + 6 not in dict(leaks)
    assert {r.doc_id for r in cp.run(spark, str(tmp_path)).collect()} == {i for i, t in want if t}


def test_hashes_of_kept_text(spark):
    from binloom.llm.queries import op4_line_dedup

    texts = {r.doc_id: r.text for r in table(spark, "documents").collect()}
    want = {i: (n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in dedup_by_hand(list(texts.items()))}
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in op4_line_dedup(spark, SF).collect()} == want
