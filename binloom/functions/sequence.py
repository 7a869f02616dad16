"""Sequence functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# IUPAC letters and their complements, in both cases. Others complement to N.
IUPAC = "ATCGURYSWKMBVDHNatcguryswkmbvdhn"
COMPLEMENT = "TAGCAYRSWMKVBHDNtagcayrswmkvbhdn"
# The standard genetic code with its codons in T, C, A, G order.
GENETIC_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
# Ten-letter amino acid groups of Murphy and others (2000).
MURPHY10 = ("LVIM", "C", "A", "G", "ST", "P", "FYW", "EDNQ", "KR", "H")
# Rank names and their letters.
RANK_LETTERS = {
    "superkingdom": "D", "kingdom": "K", "phylum": "P", "class": "C", "order": "O",
    "family": "F", "genus": "G", "species": "S", "no rank": "R", "root": "R",
}


def codons() -> dict[str, str]:
    return {a + b + c: GENETIC_CODE[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}


def base_codes(seq: Column) -> Column:
    """A, C, G, T as digits 0 to 3 in either case; anything else is '-'."""
    return F.translate(F.regexp_replace(seq, "[^ACGTacgt]", "-"), "ACGTacgt", "01230123")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(F.regexp_replace(seq, f"[^{IUPAC}]", "N"), IUPAC, COMPLEMENT))


def _count(seq: Column, letters: str) -> Column:
    return F.length(seq) - F.length(F.translate(seq, letters, ""))


def gc_content(seq: Column) -> Column:
    """(G+C) over the full length, unknown bases included; 0 if empty."""
    return F.coalesce(F.try_divide(_count(seq, "GCgc"), F.length(seq)), F.lit(0.0))


def gc_skew(seq: Column) -> Column:
    g, c = _count(seq, "Gg"), _count(seq, "Cc")
    return F.coalesce(F.try_divide(g - c, g + c), F.lit(0.0))


def ambiguous_bases(seq: Column) -> Column:
    return F.length(seq) - _count(seq, "ACGTacgt")


def translate_frame(seq: Column, offset: int) -> Column:
    """Amino acids of the codons from ``offset`` on; stops are *, codons with an unknown base X."""
    table = F.create_map(*[F.lit(x) for kv in codons().items() for x in kv])
    n = F.floor((F.length(seq) - offset) / 3).cast("int")

    def amino(s: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.coalesce(F.try_element_at(table, F.substr(s, k * 3 + offset + 1, F.lit(3))), F.lit("X")))

    text = F.array_join(F.transform(F.array(F.upper(seq)), amino)[0], "")
    return F.when(n < 1, F.lit("")).otherwise(text)


def translate_reverse_frame(seq: Column, offset: int) -> Column:
    return translate_frame(reverse_complement(seq), offset)


def six_frames(seq: Column) -> Column:
    """Frames +0, +1, +2, -0, -1, -2."""
    return F.array(*[translate_frame(seq, k) for k in range(3)], *[translate_reverse_frame(seq, k) for k in range(3)])


def coding_density(frames: Column, shortest: int = 20) -> Column:
    """Share of residues in stop-free segments of at least ``shortest``, over all frames; X is a residue."""
    lengths = F.flatten(F.transform(frames, lambda f: F.transform(F.split(f, "[*]"), F.length)))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    return F.coalesce(F.try_divide(total(F.filter(lengths, lambda n: n >= shortest)), total(lengths)), F.lit(0.0))


def canonical(kmer: Column) -> Column:
    """The lesser of a k-mer and its reverse complement; letter order equals code order."""
    return F.least(kmer, reverse_complement(kmer))


def canonical_kmers(k: int = 4) -> list[str]:
    """All canonical k-mers in ascending order (136 of length 4)."""
    from itertools import product

    turn = str.maketrans("ACGT", "TGCA")
    return sorted({min(s, s.translate(turn)[::-1]) for s in map("".join, product("ACGT", repeat=k))})


def wrapped(seq: Column, width: int = 60) -> Column:
    """Lines of ``width``, without a final line end."""
    return F.regexp_replace(seq, rf"(.{{{width}}})(?=.)", "$1\n")


def byte_span(length: Column, line_bases: Column, line_width: Column, uniform: Column) -> Column:
    """Bytes that a sequence takes in its file, line ends included; null if its lines are uneven or it is empty."""
    full, rest = F.floor(length / line_bases), length % line_bases
    size = full * line_width + F.when(rest > 0, rest + (line_width - line_bases)).otherwise(F.lit(0))
    return F.when(uniform & (length > 0) & line_bases.isNotNull(), size.cast("long"))


def header_family(header: Column) -> Column:
    return F.split(header, "[.]")[0]


def header_taxon(header: Column) -> Column:
    return F.get(F.split(header, "[.]"), 2).try_cast("long")


def rank_letter(rank: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in RANK_LETTERS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, rank), rank)


def fnv1a(text: Column, seed: int = 0) -> Column:
    """32-bit FNV-1a of a text's characters, its basis mixed with ``seed``."""
    basis = (2166136261 ^ seed) & 0xFFFFFFFF
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(basis).cast("long"), lambda h, c: (h.bitwiseXOR(F.ascii(c)) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF)))


def reduced(residues: Column) -> Column:
    """Residues as the digits of their ten-letter groups."""
    pairs = [(a, str(g)) for g, group in enumerate(MURPHY10) for a in group]
    return F.translate(residues, "".join(a for a, _ in pairs), "".join(d for _, d in pairs))
