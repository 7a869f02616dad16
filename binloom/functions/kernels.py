"""NumPy bodies for what column expressions can't say at speed: one sequence in, plain values out."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

from .sequence import MURPHY10, canonical_kmers, codons

# BLOSUM62 in the residue order below.
RESIDUES = "ARNDCQEGHILKMFPSTWYV"
BLOSUM62 = """
 4 -1 -2 -2  0 -1 -1  0 -2 -1 -1 -1 -1 -2 -1  1  0 -3 -2  0
-1  5  0 -2 -3  1  0 -2  0 -3 -2  2 -1 -3 -2 -1 -1 -3 -2 -3
-2  0  6  1 -3  0  0  0  1 -3 -3  0 -2 -3 -2  1  0 -4 -2 -3
-2 -2  1  6 -3  0  2 -1 -1 -3 -4 -1 -3 -3 -1  0 -1 -4 -3 -3
 0 -3 -3 -3  9 -3 -4 -3 -3 -1 -1 -3 -1 -2 -3 -1 -1 -2 -2 -1
-1  1  0  0 -3  5  2 -2  0 -3 -2  1  0 -3 -1  0 -1 -2 -1 -2
-1  0  0  2 -4  2  5 -2  0 -3 -3  1 -2 -3 -1  0 -1 -3 -2 -2
 0 -2  0 -1 -3 -2 -2  6 -2 -4 -4 -2 -3 -3 -2  0 -2 -2 -3 -3
-2  0  1 -1 -3  0  0 -2  8 -3 -3 -1 -2 -1 -2 -1 -2 -2  2 -3
-1 -3 -3 -3 -1 -3 -3 -4 -3  4  2 -3  1  0 -3 -2 -1 -3 -1  3
-1 -2 -3 -4 -1 -2 -3 -4 -3  2  4 -2  2  0 -3 -2 -1 -2 -1  1
-1  2  0 -1 -3  1  1 -2 -1 -3 -2  5 -1 -3 -1  0 -1 -3 -2 -2
-1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5  0 -2 -1 -1 -1 -1  1
-2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6 -4 -2 -2  1  3 -1
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7 -1 -1 -4 -3 -2
 1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4  1 -3 -2 -2
 0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5 -2 -2  0
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11  2 -3
-2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7 -1
 0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4
"""
ANY_SCORE, STOP_SCORE = -1, -100


@lru_cache(1)
def scores() -> np.ndarray:
    """128 x 128 by character: X scores -1 with anything, other letters than residues -100."""
    s = np.full((128, 128), STOP_SCORE, np.int32)
    s[ord("X"), :] = s[:, ord("X")] = ANY_SCORE
    at = np.frombuffer(RESIDUES.encode(), np.uint8)
    s[np.ix_(at, at)] = np.array(BLOSUM62.split(), np.int32).reshape(20, 20)
    return s


@lru_cache(1)
def _base_table() -> np.ndarray:
    t = np.full(256, -1, np.int8)
    for k, pair in enumerate(("Aa", "Cc", "Gg", "Tt")):
        for c in pair:
            t[ord(c)] = k
    return t


@lru_cache(1)
def _codon_table() -> np.ndarray:
    table = codons()
    return np.frombuffer("".join(table[a + b + c] for a in "ACGT" for b in "ACGT" for c in "ACGT").encode(), np.uint8)


@lru_cache(1)
def _canonical_slots() -> np.ndarray:
    """Slot among the 136 canonical 4-mers of each of the 256 codes."""
    place = {s: i for i, s in enumerate(canonical_kmers())}
    turn = str.maketrans("ACGT", "TGCA")
    words = [a + b + c + d for a in "ACGT" for b in "ACGT" for c in "ACGT" for d in "ACGT"]
    return np.array([place[min(w, w.translate(turn)[::-1])] for w in words])


def codes(seq: str) -> np.ndarray:
    """0 to 3 for A, C, G, T in either case, -1 for anything else."""
    return _base_table()[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]


@lru_cache(1)
def _letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """The amino acid of each of the 64 codons, read forward and as its reverse complement; X at 64."""
    forward = _codon_table()
    k = np.arange(64)
    turned = 16 * (3 - k % 4) + 4 * (3 - k // 4 % 4) + (3 - k // 16)
    return np.append(forward, np.uint8(ord("X"))), np.append(forward[turned], np.uint8(ord("X")))


def frame_letters(c: np.ndarray) -> list[np.ndarray]:
    """Letters of the six frames: every codon is looked up once for each strand, and frames are every third of them."""
    n = len(c)
    if n < 3:
        return [np.zeros(0, np.uint8)] * 6
    x = c.astype(np.int8)
    # An unknown base takes the sum to 64 or more, which stands for all of these.
    known = np.where(x < 0, np.int8(64), x).astype(np.int16)
    codon = np.minimum(16 * known[:-2] + 4 * known[1:-1] + known[2:], 64)
    forward, turned = (t[codon] for t in _letter_tables())
    back = turned[::-1]
    return [forward[k::3] for k in range(3)] + [back[k::3] for k in range(3)]


def frames(seq: str) -> list[str]:
    return _told(codes(seq))


def _told(c: np.ndarray) -> list[str]:
    return [x.tobytes().decode() for x in frame_letters(c)]


def kmer_counts(c: np.ndarray) -> np.ndarray:
    """How often each of the 136 canonical 4-mers occurs; windows with an unknown base don't count."""
    if len(c) < 4:
        return np.zeros(136, np.int64)
    x = c.astype(np.int16)
    code = 64 * x[:-3] + 16 * x[1:-2] + 4 * x[2:-1] + x[3:]
    known = x >= 0
    good = known[:-3] & known[1:-2] & known[2:-1] & known[3:]
    n = np.bincount(code[good], minlength=256)
    return np.bincount(_canonical_slots(), weights=n, minlength=136).astype(np.int64)


def composition(c: np.ndarray) -> np.ndarray:
    """Relative frequency of the 136 canonical 4-mers."""
    n = kmer_counts(c)
    return n / max(1, n.sum())


def density(amino: list[str], shortest: int = 20) -> float:
    """Share of residues in stop-free parts of ``shortest`` at least."""
    line = np.frombuffer(("*".join(amino) + "*").encode(), np.uint8)
    stops = np.flatnonzero(line == ord("*"))
    lengths = np.diff(stops, prepend=-1) - 1
    total = int(lengths.sum())
    return int(lengths[lengths >= shortest].sum()) / total if total else 0.0


def stats(seq: str) -> tuple:
    """length, gc_content, gc_skew, ambiguous, coding_density, composition: one pass over one code array."""
    c = codes(seq)
    n = np.bincount(c[c >= 0], minlength=4)
    gc = int(n[1] + n[2])
    return len(c), gc / len(c) if len(c) else 0.0, (int(n[2]) - int(n[1])) / gc if gc else 0.0, int(len(c) - n.sum()), density(_told(c)), composition(c).tolist()


def orfs(seq: str, shortest: int = 100) -> list[tuple[str, int, int, int]]:
    """(strand, frame, start, end) of stop-free and X-free segments, in forward coordinates."""
    n, out = len(seq), []
    for k, amino in enumerate(frames(seq)):
        f = k % 3
        for m in re.finditer(r"[^*X]+", amino):
            if m.end() - m.start() >= shortest:
                a, z = f + 3 * m.start(), f + 3 * m.end()
                out.append(("+", f, a, z) if k < 3 else ("-", f, n - z, n - a))
    return out


_GROUPS = {ord(a): str(g) for g, group in enumerate(MURPHY10) for a in group}


def reduced_kmers(amino: str, k: int, cap: int = 0, stride: int = 1) -> list[tuple[int, int]]:
    """(code, position) of k-mer windows over runs of standard residues.

    The stride grows on runs that would give more than ``cap`` windows.
    """
    out = []
    for m in re.finditer(f"[{RESIDUES}]+", amino):
        digits, windows = m[0].translate(_GROUPS), m.end() - m.start() - k + 1
        if windows > 0:
            step = max(stride, -(-windows // cap)) if cap else stride
            out += [(int(digits[i : i + k]), m.start() + i) for i in range(0, windows, step)]
    return out


def seed_arrays(amino: str, k: int, cap: int = 0, stride: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """``reduced_kmers`` as arrays of codes and positions, over all runs at once."""
    digits = _digit_table()[np.frombuffer(amino.encode("latin-1", "replace"), np.uint8)]
    good = np.concatenate(([False], digits >= 0, [False]))
    edges = np.flatnonzero(good[1:] != good[:-1])
    starts, windows = edges[::2], edges[1::2] - edges[::2] - k + 1
    starts, windows = starts[windows > 0], windows[windows > 0]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    step = np.maximum(stride, -(-windows // cap)) if cap else np.full(len(windows), stride)
    taken = -(-windows // step)
    nth = np.arange(taken.sum()) - np.repeat(np.cumsum(taken) - taken, taken)
    at = np.repeat(starts, taken) + nth * np.repeat(step, taken)
    codes = np.zeros(len(at), np.int64)
    for j in range(k):
        codes = codes * 10 + digits[at + j]
    return codes, at.astype(np.int32)


@lru_cache(1)
def _digit_table() -> np.ndarray:
    """The digit of each residue's group, -1 for anything else."""
    out = np.full(256, -1, np.int8)
    for a in RESIDUES:
        out[ord(a)] = int(_GROUPS[ord(a)])
    return out


def minhash(texts: list[str], k: int, seeds: list[int]) -> np.ndarray:
    """For each text and seed, the least 32-bit FNV-1a value over its k-mers, whose basis is mixed with the seed; the
    largest value without any. All k-mers of all texts are hashed letter by letter."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    size = np.array([len(t) for t in texts], np.int64)
    windows = np.maximum(0, size - k + 1)
    at = np.arange(windows.sum()) + np.repeat((np.cumsum(size) - size) - (np.cumsum(windows) - windows), windows)
    letters = [points[at + j] for j in range(k)]
    has = windows > 0
    first = (np.cumsum(windows) - windows)[has]
    out = np.full((len(texts), len(seeds)), 0xFFFFFFFF, np.int64)
    for h, seed in enumerate(seeds):
        v = np.full(len(at), (2166136261 ^ seed) & 0xFFFFFFFF, np.uint32)
        for c in letters:
            v = (v ^ c) * np.uint32(16777619)
        if len(first):
            out[has, h] = np.minimum.reduceat(v, first)
    return out


#: Columns that are scored at once.
COLUMNS = 64


class Residues:
    """Many texts as one array of codes, with where each begins and its size."""

    def __init__(self, texts: list[str]):
        raw = [t.encode() for t in texts]
        self.codes = np.frombuffer(b"".join(raw) or b"\0", np.uint8)
        self.size = np.array([len(t) for t in raw], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def at(self, places):
        return self.codes[np.clip(places, 0, len(self.codes) - 1)]


def _runs(q: Residues, r: Residues, q_at, r_at, size, way: int, floor: int | None, drop: int):
    """For each pair, the best sum of a run of up to ``size`` residues from both places on, and its length.

    ``floor``: the score of taking nothing; None if one must be taken. All pairs go on together, some columns at a time,
    until their score is more than ``drop`` below its best.
    """
    table, n = scores(), len(size)
    low = np.int64(-(10**9))
    best, length = np.full(n, low if floor is None else floor), np.zeros(n, np.int64)
    run, live, column = np.zeros(n, np.int64), np.flatnonzero(size > 0), 0
    while len(live):
        steps = column + np.arange(COLUMNS)
        inside = steps[None, :] < size[live, None]
        a, b = q.at(q_at[live, None] + way * steps), r.at(r_at[live, None] + way * steps)
        sums = run[live, None] + np.cumsum(np.where(inside, table[a, b], 0), axis=1)
        sums[~inside] = low
        top = np.maximum(np.maximum.accumulate(sums, axis=1), best[live, None])
        over = (top - sums > drop) | ~inside
        ended = over.any(1)
        stop = np.where(ended, over.argmax(1), COLUMNS)
        sums[np.arange(COLUMNS)[None, :] >= stop[:, None]] = low
        k = sums.argmax(1)
        found = sums[np.arange(len(live)), k]
        better = found > best[live]
        best[live[better]], length[live[better]] = found[better], column + k[better] + 1
        run[live] = sums[:, -1]
        live, column = live[~ended], column + COLUMNS
    return best, length


def extend_ungapped_all(queries: list[str], refs: list[str], at, ref_at, drop: int = 15):
    """(score, query start, query end (inclusive), aligned length) of the best run through each pair's anchor.

    The anchor is always taken. To each side, growth ends once the score is more than ``drop`` below its best.
    """
    q, r = Residues(queries), Residues(refs)
    at, ref_at = np.asarray(at, np.int64), np.asarray(ref_at, np.int64)
    right, steps = _runs(q, r, q.start + at, r.start + ref_at, np.minimum(q.size - at, r.size - ref_at), 1, None, drop)
    left, back = _runs(q, r, q.start + at - 1, r.start + ref_at - 1, np.minimum(at, ref_at), -1, 0, drop)
    return right + left, at - back, at + steps - 1, steps + back


def extend_ungapped(query: str, ref: str, at: int, ref_at: int, drop: int = 15) -> tuple[int, int, int, int]:
    """``extend_ungapped_all`` of one pair."""
    return tuple(int(x[0]) for x in extend_ungapped_all([query], [ref], [at], [ref_at], drop))


def _banded(q: Residues, r: Residues, q_at, r_at, q_size, r_size, way: int, drop: int, gap: int, band: int):
    """For each pair, the best score of a prefix pair in the band, and how much of the reference it takes.

    The cells of one row, a query residue, are a band for all pairs at once; a pair ends when all of its row is more
    than ``drop`` below its best.
    """
    table, low = scores(), np.int64(-(10**9))
    offset = np.arange(-band, band + 1)
    ramp = gap * offset
    n = len(q_at)
    best, taken = np.zeros(n, np.int64), np.zeros(n, np.int64)
    live = np.flatnonzero(q_size > 0)
    row = np.where(offset == 0, 0, low)[None, :].repeat(len(live), 0)
    i = 0
    while len(live):
        i += 1
        j = i + offset[None, :]
        valid = (j >= 0) & (j <= r_size[live, None])
        a, b = q.at(q_at[live] + way * (i - 1)), r.at(r_at[live, None] + way * (j - 1))
        sub = np.where(valid & (j >= 1), table[a[:, None], b], low)
        stay = np.concatenate((row[:, 1:], np.full((len(live), 1), low)), axis=1) - gap
        cell = np.where(valid, np.maximum(row + sub, stay), low)
        # A gap in the query takes the cell to the left: a running maximum along the row.
        cell = np.where(valid, np.maximum.accumulate(cell + ramp, axis=1) - ramp, low)
        k = cell.argmax(1)
        top = cell[np.arange(len(live)), k]
        better = top > best[live]
        best[live[better]], taken[live[better]] = top[better], i + offset[k[better]]
        go = (top >= best[live] - drop) & (q_size[live] > i)
        live, row = live[go], np.maximum(cell[go], low)
    return best, taken


def extend_gapped_all(queries: list[str], refs: list[str], at, ref_at, drop: int = 15, gap: int = 8, band: int = 16):
    """(score, aligned reference length) of a banded extension both ways from each anchor, with linear gaps."""
    q, r = Residues(queries), Residues(refs)
    at, ref_at = np.asarray(at, np.int64), np.asarray(ref_at, np.int64)
    right, n = _banded(q, r, q.start + at + 1, r.start + ref_at + 1, q.size - at - 1, r.size - ref_at - 1, 1, drop, gap, band)
    left, m = _banded(q, r, q.start + at - 1, r.start + ref_at - 1, at, ref_at, -1, drop, gap, band)
    anchor = scores()[q.at(q.start + at), r.at(r.start + ref_at)]
    return anchor.astype(np.int64) + right + left, m + 1 + n


def extend_gapped(query: str, ref: str, at: int, ref_at: int, drop: int = 15, gap: int = 8, band: int = 16) -> tuple[int, int]:
    """``extend_gapped_all`` of one pair."""
    return tuple(int(x[0]) for x in extend_gapped_all([query], [ref], [at], [ref_at], drop, gap, band))
