"""Language identification by a linear-chain conditional random field over the words of a text.

A word is a run of letters (and marks on them). Its features are hashed: two- and three-letter n-grams with the word's
ends marked, affixes of two to four letters, and the language and strength with which a lexicon holds it. A state is
a language; the weights of features and of transitions between words are learned together, from sequences that switch
between languages. Forward-backward gives each word's probabilities, whatever the length of the text: texts are cut
into blocks, whose transfer matrices carry the messages from block to block. A document's language is the one with
the highest mean probability over its letters; ``spans`` tells the languages within a text.

Learning takes at most ``docs`` documents of each language, chosen by hash, and of each at most ``windows`` windows of
``width`` words, evenly over its whole text. Half of the windows give the lexicon, the others the weights.

Edge cases: a null text and one without a letter are ``und`` with score 0. Very long texts are labelled whole, block
by block. Rows with a null doc_id and repeated rows are labelled one by one, equal texts alike. Of equally probable
languages the first by name is taken. Training rows without a language are left out; without any, all is ``und``, and
with one language only, all texts with a letter are of it with score 1. Extra columns are ignored. An empty table gives
an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

UND = "und"
LABELLED = "doc_id long, lang_pred string, score double"
SPANS = "doc_id long, spans array<struct<start:int,stop:int,lang:string,score:double>>"
NGRAMS = (2, 3)
#: Letters of a word's beginning and end that are features.
PREFIXES, SUFFIXES = (2, 4), (2, 3, 4)
#: Shares of a word's uses, over languages of equal weight, from which a lexicon holds it, by strength.
STRENGTHS = (0.6, 0.8, 0.95)
BLOCK = 64
#: Letters times languages that are labelled together, about; at least one text.
TOGETHER = 1 << 21


@dataclass(frozen=True)
class Settings:
    docs: int = 400  # of a language, to learn from
    windows: int = 4  # of a document
    width: int = 48  # words of a window and of a training sequence
    span: float = 10.0  # words between possible switches in a training sequence, on average
    slots: int = 1 << 17
    passes: int = 6
    batch: int = 128
    rate: float = 0.3
    decay: float = 1e-6


@dataclass
class Model:
    langs: tuple[str, ...] = ()
    weights: object = None  # (slots, languages)
    lexicon: object = None  # sorted word hashes
    held: object = None  # 1 + language * strengths + strength of each
    by_lexicon: object = None  # (1 + languages * strengths, languages)
    moves: object = None  # (languages, languages)
    start: object = None


@lru_cache(maxsize=1)
def _characters():
    """By code point: 2 for letters, 1 for marks, 0 for others; and the small letter."""
    import unicodedata

    import numpy as np

    kind = np.zeros(0x110000, np.uint8)
    small = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        if ch.isalpha():
            kind[c] = 2
            low = ch.lower()
            if len(low) == 1 and low != ch:
                small[c] = ord(low)
        elif unicodedata.category(ch)[0] == "M":
            kind[c] = 1
    return kind, small


@dataclass
class Words:
    """The words of some texts: letters with one cell before and behind each word, and each word's place."""

    cells: object  # small letters; 1 before and 2 behind each word
    first: object  # cell of each word's first letter
    size: object  # letters
    text: object  # text of each word
    at: object  # code point of its text it starts at


def words_of(texts: list[str | None]) -> Words:
    import numpy as np

    kind, small = _characters()
    codes = [np.frombuffer((t or "").encode("utf-32-le"), np.uint32) for t in texts]
    starts = np.cumsum([0, *(len(c) + 1 for c in codes)])
    flat = np.zeros(starts[-1], np.uint32)  # a zero behind each text
    for s, c in zip(starts, codes, strict=False):
        flat[s : s + len(c)] = c
    k = kind[flat]
    inside = np.flatnonzero(k)
    new = np.ones(len(inside), bool)
    new[1:] = inside[1:] != inside[:-1] + 1
    first = np.flatnonzero(new)
    if len(first):
        lettered = np.maximum.reduceat(k[inside], first) == 2
        if not lettered.all():
            inside = inside[np.repeat(lettered, np.diff(first, append=len(inside)))]
            new = np.ones(len(inside), bool)
            new[1:] = inside[1:] != inside[:-1] + 1
            first = np.flatnonzero(new)
    size = np.diff(first, append=len(inside))
    number = np.cumsum(new) - 1
    cells = np.zeros(len(inside) + 2 * len(first), np.uint32)
    cells[np.arange(len(inside)) + 2 * number + 1] = small[flat[inside]]
    first_cell = first + 2 * np.arange(len(first)) + 1
    cells[first_cell - 1], cells[first_cell + size] = 1, 2
    begins = inside[first] if len(first) else np.zeros(0, np.int64)
    text = np.searchsorted(starts, begins, "right") - 1
    return Words(cells, first_cell, size, text, begins - starts[text])


def _mixed(h):
    import numpy as np

    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return h ^ (h >> np.uint32(13))


def ngram_slots(w: Words, n: int, slots: int):
    """Slots of all n-grams, word after word, and where each word's begin. A word of m letters has m + 3 - n."""
    import numpy as np

    many = w.size + 3 - n
    starts = np.cumsum(many) - many
    at = np.arange(many.sum()) + np.repeat(w.first - 1 - starts, many)
    h = np.full(len(at), n, np.uint32)
    for i in range(n):
        h = (h ^ w.cells[at + i]) * np.uint32(0x9E3779B1)
    return (_mixed(h) & np.uint32(slots - 1)).astype(np.int32), starts


def affix_slots(w: Words, slots: int):
    """(words, affixes): slots of the first and last letters; of a shorter word, of all."""
    import numpy as np

    out = []
    last = w.first + w.size - 1
    for kind, lengths, begin, way in ((101, PREFIXES, w.first, 1), (202, SUFFIXES, last, -1)):
        for n in lengths:
            h = np.full(len(w.first), kind + n, np.uint32)
            for i in range(n):
                letter = np.where(w.size > i, w.cells[np.clip(begin + way * i, 0, len(w.cells) - 1)], np.uint32(0))
                h = (h ^ letter) * np.uint32(0x9E3779B1)
            out.append(_mixed(h) & np.uint32(slots - 1))
    return np.stack(out, 1).astype(np.int32)


def word_hashes(w: Words):
    import numpy as np

    if not len(w.first):
        return np.zeros(0, np.uint64)
    at = np.arange(len(w.cells))
    place = at - np.repeat(w.first - 1, w.size + 2)
    # Both end cells count, so that a sum over the word's cells tells it from others by its length too.
    x = (w.cells.astype(np.uint64) + np.uint64(0x51ED27)) * (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1))
    x ^= x >> np.uint64(29)
    return np.add.reduceat(x * np.uint64(0xBF58476D1CE4E5B9), w.first - 1)


def held_by(hashes, lexicon, held):
    """0, or the lexicon's entry for each word."""
    import numpy as np

    if not len(lexicon):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
    return np.where(lexicon[at] == hashes, held[at], 0)


def emissions(w: Words, m: Model):
    """(words, languages): what the features say."""
    import numpy as np

    slots = len(m.weights)
    out = m.by_lexicon[held_by(word_hashes(w), m.lexicon, m.held)].astype(np.float32)
    for n in NGRAMS:
        found, starts = ngram_slots(w, n, slots)
        out += np.add.reduceat(m.weights[found], starts, axis=0) / np.sqrt(w.size + 3 - n, dtype=np.float32)[:, None]
    affixes = affix_slots(w, slots)
    for i in range(affixes.shape[1]):
        out += np.float32(0.5) * m.weights[affixes[:, i]]
    return out.astype(np.float64)


def marginals(emitted, many, moves, start):
    """Probabilities (words, languages) by forward-backward in texts of ``many`` words each (one at least).

    Blocks of BLOCK words go in step. First each block's transfer matrix, then the messages between the blocks of a
    text, then those inside the blocks. Every step is scaled, and only proportions count.
    """
    import numpy as np

    n_lang = emitted.shape[1]
    e = np.exp(emitted - emitted.max(1, keepdims=True))
    t, s = np.exp(moves - moves.max()), np.exp(start - start.max())
    blocks = -(-many // BLOCK)
    text = np.repeat(np.arange(len(many)), blocks)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    first = np.repeat(np.cumsum(many) - many, blocks) + nth * BLOCK
    size = np.minimum(BLOCK, many[text] - nth * BLOCK)
    order = np.argsort(-size, kind="stable")  # those that still go are in front
    text, nth, first, size = text[order], nth[order], first[order], size[order]
    going = [int(np.searchsorted(-size, -k, "left")) for k in range(BLOCK + 1)]  # blocks of more than k words

    def scaled(x, axis):
        return x / np.maximum(x.max(axis, keepdims=True), 1e-300)

    g = len(size)
    opening = nth == 0
    carry = np.tile(np.eye(n_lang), (g, 1, 1))
    for k in range(int(size[0])):
        live = going[k]
        step = (carry[:live] @ t) * e[first[:live] + k][:, None, :]
        if k == 0:
            step[opening] = (s * e[first[opening]])[:, None, :]
        carry[:live] = scaled(step, (1, 2))
    # Messages into each block from before and from behind, block number by block number.
    before, behind = np.ones((g, n_lang)), np.ones((g, n_lang))
    last = int(nth.max()) + 1
    where = np.empty((len(many), last), np.int64)
    where[text, nth] = np.arange(g)
    by_length = np.argsort(-blocks, kind="stable")
    upto = [int((blocks > k).sum()) for k in range(last)]
    for k in range(1, last):
        texts = by_length[: upto[k]]
        prev = where[texts, k - 1]
        before[where[texts, k]] = scaled(np.einsum("gi,gij->gj", before[prev], carry[prev]), 1)
    for k in range(last - 1, 0, -1):
        texts = by_length[: upto[k]]
        here = where[texts, k]
        behind[where[texts, k - 1]] = scaled(np.einsum("gij,gj->gi", carry[here], behind[here]), 1)
    out = np.empty_like(e)
    ahead = []
    alpha = before
    for k in range(int(size[0])):
        live = going[k]
        alpha = alpha[:live] @ t
        if k == 0:
            alpha[opening] = s
        alpha = scaled(alpha * e[first[:live] + k], 1)
        ahead.append(alpha)
    beta = np.empty((0, n_lang))
    for k in range(int(size[0]) - 1, -1, -1):
        live = going[k]
        inner = (e[first[: len(beta)] + k + 1] * beta) @ t.T
        beta = scaled(np.concatenate((inner, behind[len(beta) : live])), 1)
        p = ahead[k] * beta
        out[first[:live] + k] = p / p.sum(1, keepdims=True)
    return out


def labelled_words(texts: list[str | None], m: Model):
    """The words of some texts and their probabilities."""
    import numpy as np

    w = words_of(texts)
    if len(m.langs) < 2 or not len(w.first):
        return w, np.ones((len(w.first), len(m.langs)))
    _, many = np.unique(w.text, return_counts=True)
    return w, marginals(emissions(w, m), many, m.moves, m.start)


def _parts(batch, column: int, room: int):
    """Parts of a record batch with about ``room`` bytes of text each."""
    import numpy as np
    import pyarrow.compute as pc

    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + room, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """LABELLED: each text's language and its mean probability over the letters."""
    langs = model.langs
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by Settings.slots and the lexicon of the sample

    def run(batches):
        import numpy as np
        import pyarrow as pa

        m = shared.value
        for b in batches:
            for part in _parts(b, 1, TOGETHER // max(1, len(langs))):
                lang, score = [UND] * part.num_rows, np.zeros(part.num_rows)
                w, p = labelled_words(part.column(1).to_pylist(), m)
                if langs and len(w.first):
                    texts, first = np.unique(w.text, return_index=True)
                    mean = np.add.reduceat(p * w.size[:, None], first, axis=0) / np.add.reduceat(w.size, first)[:, None]
                    for i, k in zip(texts.tolist(), mean.argmax(1).tolist(), strict=True):
                        lang[i] = langs[k]
                    score[texts] = np.clip(mean.max(1), 0, 1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    with small_batches(docs.sparkSession, 1024):
        return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, LABELLED)


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """SPANS: each text's runs of words of one language, by code points, with their mean probability."""
    langs = model.langs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        m = shared.value
        for b in batches:
            for part in _parts(b, 1, TOGETHER // max(1, len(langs))):
                rows = [[] for _ in range(part.num_rows)]
                w, p = labelled_words(part.column(1).to_pylist(), m)
                if langs and len(w.first):
                    best = p.argmax(1)
                    first = np.flatnonzero(np.concatenate(([True], (best[1:] != best[:-1]) | (w.text[1:] != w.text[:-1]))))
                    last = np.append(first[1:], len(best)) - 1
                    mean = np.add.reduceat(p.max(1), first) / (last - first + 1)
                    for i, s, e, k, v in zip(w.text[first].tolist(), w.at[first].tolist(), (w.at[last] + w.size[last]).tolist(), best[first].tolist(), mean.tolist(), strict=True):
                        rows[i].append({"start": s, "stop": e, "lang": langs[k], "score": v})
                kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SPANS)


def sampled(docs: DataFrame, train: Column, bound: int) -> DataFrame:
    """(lang, text): at most ``bound`` rows of each language for which ``train`` holds, by hash of the doc_id."""
    from pyspark.sql import Window as W

    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))  # a row for each language
    u = F.pmod(F.xxhash64(F.lit("languages"), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    # About twice the bound is left before rows are ranked, so that no rank is over all of a language's rows.
    near = rows.join(F.broadcast(counts), "lang").where(u * F.col("n") < 2 * bound + 50)
    nth = F.row_number().over(W.partitionBy("lang").orderBy(u, "doc_id", F.xxhash64("text")))
    return near.withColumn("nth", nth).where(F.col("nth") <= bound).select("lang", "nth", "text")


def windows(rows: DataFrame, s: Settings) -> DataFrame:
    """(lang, nth, part, text): windows of ``width`` words, evenly over each whole text."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for lang, nth, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = text.split()
                n = min(s.windows, max(1, len(found) // s.width))
                for k in range(n):
                    at = k * max(0, len(found) - s.width) // max(1, n - 1)
                    out.append((lang, nth, k, " ".join(found[at : at + s.width])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["lang", "nth", "part", "text"])

    return rows.mapInArrow(run, "lang string, nth long, part long, text string")


def fit(docs: DataFrame, train: Column, s: Settings = Settings()) -> Model:
    """Learn from the rows for which ``train`` (a condition on doc_id) holds."""
    got = windows(sampled(docs, train, s.docs), s).collect()  # docs * windows * width words of a language at most
    return learned([(r.lang, r.text) for r in sorted(got, key=lambda r: (r.part, r.nth, r.lang))], s)


def learned(rows: list[tuple[str, str]], s: Settings = Settings()) -> Model:
    """A model of (language, text) windows."""
    import numpy as np

    langs = tuple(sorted({lang for lang, _ in rows}))
    if len(langs) < 2:
        return Model(langs)
    lang_of = np.array([langs.index(lang) for lang, _ in rows])
    w = words_of([t for _, t in rows])
    y, hashes = lang_of[w.text], word_hashes(w)
    lexicon, held = _lexicon(hashes[w.text % 2 == 0], y[w.text % 2 == 0], len(langs))
    if not (w.text % 2 == 1).any() or len(set(y[w.text % 2 == 1])) < len(langs):
        use = np.ones(len(y), bool)  # too little to keep a half for the lexicon alone
    else:
        use = w.text % 2 == 1
    m = Model(langs, np.zeros((s.slots, len(langs)), np.float32), lexicon, held, np.zeros((1 + len(langs) * len(STRENGTHS), len(langs)), np.float32), np.zeros((len(langs),) * 2), np.zeros(len(langs)))
    _descend(m, w, y, held_by(hashes, lexicon, held), np.flatnonzero(use), s)
    return m


def _lexicon(hashes, y, n_lang: int):
    """Words that are of one language mostly, each language counted alike."""
    import numpy as np

    words, number = np.unique(hashes, return_inverse=True)
    counts = np.bincount(number * n_lang + y, minlength=len(words) * n_lang).reshape(-1, n_lang)
    rate = (counts + 0.1) / np.maximum(counts.sum(0), 1)
    share = rate / rate.sum(1, keepdims=True)
    best, top = share.argmax(1), share.max(1)
    strength = np.searchsorted(STRENGTHS, top, "right") - 1
    keep = (counts.sum(1) >= 3) & (strength >= 0)
    return words[keep], (1 + best * len(STRENGTHS) + strength)[keep]


def _sequences(w: Words, y, use, s: Settings, rng):
    """(sequences, width) of words: pieces of windows one after the other, now of the same language, now of another."""
    import numpy as np

    texts, first, many = np.unique(w.text[use], return_index=True, return_counts=True)
    first = use[first]
    by_lang = [np.flatnonzero(y[first] == k) for k in range(int(y.max()) + 1)]
    some = [k for k, x in enumerate(by_lang) if len(x)]
    out = np.empty((max(s.batch, 2 * len(use) // s.width), s.width), np.int64)
    for row in out:
        at, lang = 0, some[rng.integers(len(some))]
        while at < s.width:
            i = by_lang[lang][rng.integers(len(by_lang[lang]))]
            n = min(1 + int(rng.exponential(s.span)), s.width - at, many[i])
            begin = first[i] + rng.integers(many[i] - n + 1)
            row[at : at + n] = np.arange(begin, begin + n)
            at += n
            if rng.random() < 0.3:
                lang = some[rng.integers(len(some))]
    return out


def _descend(m: Model, w: Words, y, held, use, s: Settings) -> None:
    """Maximise the likelihood of the labels by steps on batches of sequences, scaled by each weight's past gradients."""
    import numpy as np

    rng, n_lang = np.random.default_rng(11), len(m.langs)
    found = [(*ngram_slots(w, n, s.slots), w.size + 3 - n) for n in NGRAMS]
    affixes = affix_slots(w, s.slots)
    seen, seen_lex, seen_moves, seen_start = np.full(m.weights.shape, 1e-4, np.float32), np.full(m.by_lexicon.shape, 1e-4), np.full(m.moves.shape, 1e-4), np.full(n_lang, 1e-4)

    def step(weights, past, g):
        past += g * g
        weights -= s.rate * g / np.sqrt(past)

    for _ in range(s.passes):
        sequences = _sequences(w, y, use, s, rng)
        for at in range(0, len(sequences), s.batch):
            rows = sequences[at : at + s.batch]
            word, gold = rows.ravel(), y[rows]
            features = []
            for slots, starts, many in found:
                n = many[word]
                places = np.arange(n.sum()) + np.repeat(starts[word] - np.cumsum(n) + n, n)
                features.append((slots[places], np.repeat(np.arange(len(word)), n), np.repeat(1 / np.sqrt(n), n)))
            features.append((affixes[word].ravel(), np.repeat(np.arange(len(word)), affixes.shape[1]), np.full(affixes[word].size, 0.5)))
            slot, owner, value = (np.concatenate(c) for c in zip(*features, strict=True))
            emitted = m.by_lexicon[held[word]].astype(np.float64)
            for k in range(n_lang):
                emitted[:, k] += np.bincount(owner, m.weights[slot, k] * value, len(word))
            p, both = _expected(emitted.reshape(*rows.shape, n_lang), m.moves, m.start)
            wrong = p.copy()
            np.put_along_axis(wrong, gold[..., None], np.take_along_axis(wrong, gold[..., None], 2) - 1, 2)
            flat = wrong.reshape(-1, n_lang) / len(rows)
            touched = np.unique(slot)
            grad = np.stack([np.bincount(slot, flat[owner, k] * value, s.slots)[touched] for k in range(n_lang)], 1) + s.decay * m.weights[touched]
            past = seen[touched] + (grad * grad).astype(np.float32)
            m.weights[touched] -= (s.rate * grad / np.sqrt(past)).astype(np.float32)
            seen[touched] = past
            lex = np.stack([np.bincount(held[word], flat[:, k], len(m.by_lexicon)) for k in range(n_lang)], 1)
            step(m.by_lexicon, seen_lex, lex)
            moves = np.bincount((gold[:, :-1] * n_lang + gold[:, 1:]).ravel(), minlength=n_lang**2).reshape(n_lang, n_lang)
            step(m.moves, seen_moves, (both - moves) / len(rows))
            step(m.start, seen_start, wrong[:, 0].mean(0))


def _expected(emitted, moves, start):
    """Of sequences of one length: probabilities of each word, and how often each transition is expected in all."""
    import numpy as np

    n, width, n_lang = emitted.shape
    e = np.exp(emitted - emitted.max(2, keepdims=True))
    t, s = np.exp(moves - moves.max()), np.exp(start - start.max())
    ahead, back = np.empty_like(e), np.ones_like(e)
    ahead[:, 0] = s * e[:, 0]
    ahead[:, 0] /= ahead[:, 0].sum(1, keepdims=True)
    for k in range(1, width):
        a = (ahead[:, k - 1] @ t) * e[:, k]
        ahead[:, k] = a / a.sum(1, keepdims=True)
    for k in range(width - 2, -1, -1):
        b = (e[:, k + 1] * back[:, k + 1]) @ t.T
        back[:, k] = b / b.sum(1, keepdims=True)
    p = ahead * back
    p /= p.sum(2, keepdims=True)
    pair = ahead[:, :-1, :, None] * t * (e[:, 1:] * back[:, 1:])[:, :, None, :]
    pair /= pair.sum((2, 3), keepdims=True)
    return p, pair.sum((0, 1))
