"""Cross-tokenizer alignment: which tokens of one tokenizer stand for which of another, and how usual each link is.

A text is encoded twice, as space + text by a byte-level BPE file (A) and as text by a sentencepiece model (B), which
adds the space. Offsets count bytes. Where a token of both ends, the text can be cut. The cuts are found by divide and
conquer: an interval looks for a common end near its middle, by bisection of the other tokenizer's ends, and both
halves go on; an interval without a common end inside is a group. All intervals of a batch of texts take a step at
once, so that a step is a few array operations.

Two tokens are linked where their byte ranges overlap. A pair of ids counts once for each document that holds it
linked; the counts are an aggregate over all documents. Frequent pairs are sent to the tasks within a size limit and
what is left is joined, so that each link gets its count at any size of the table of pairs.

Edge cases: null and empty texts, and texts whose joined token bytes are not space + text (a model may normalise),
have no tokens: zeros and an empty digest. Very long texts are encoded whole, a batch of texts of their own. Rows that
repeat a doc_id or have none are rows of their own (each counts as a document). Extra columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_LIMIT, discard, stored

ROWS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>"
SPANS = "doc_id long, a array<int>, b array<int>, a_cuts array<int>, b_cuts array<int>"
#: A pair is stored as (A id * B's size + B id) in the high half, its links in the text in the low half of a long.
HALF = 32
#: Bytes of text that are aligned together, at least one text.
TOGETHER = 1 << 20
PAIR_BYTES = 48


class Tokenizers:
    """Both tokenizers and the bytes of their ids."""

    def __init__(self, a_path: str, b_path: str):
        import numpy as np
        import sentencepiece

        self.encode_a, self.a_bytes = _byte_level(a_path)
        self.model_b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.model_b.id_to_piece(i) for i in range(self.model_b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.model_b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.b_size = len(pieces)
        self.a_len, self.b_len = (np.array([len(t) for t in ts], np.int64) for ts in (self.a_bytes, self.b_bytes))
        if len(self.a_bytes) * self.b_size >= 1 << (63 - HALF):
            raise ValueError("the two vocabularies have too many pairs for a 31-bit code")

    def encode(self, text: str | None):
        """A and B ids of a text, or None if it has no tokens."""
        import numpy as np

        if not text:
            return None
        whole, a, b = b" " + text.encode(), self.encode_a(" " + text), self.model_b.encode(text)
        for ids, bytes_of in ((a, self.a_bytes), (b, self.b_bytes)):
            if not ids or b"".join(map(bytes_of.__getitem__, ids)) != whole:
                return None
        return np.array(a, np.int64), np.array(b, np.int64)


def _byte_level(path: str):
    """The encoder of a byte-level BPE file and the bytes of its ids. Where the merges of the file are in the order of
    its ids, a faster library does the same merges; a probe holds it against the file's own."""
    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    from .tokens import _byte_letters

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    byte_of = {c: b for b, c in _byte_letters().items()}
    tokens = [b""] * own.get_vocab_size()
    for t, i in own.get_vocab().items():
        tokens[i] = bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
    special = {i for i, t in own.get_added_tokens_decoder().items() if t.special}

    def plain(text: str) -> list[int]:
        return own.encode(text, add_special_tokens=False).ids

    fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens) if i not in special}, special_tokens={})
    probe = " it's a  b2é,\n\n x<|endoftext|>y --\t\tnaïve 12345 ñandú Straße　字 don't  "
    return (fast.encode_ordinary if fast.encode_ordinary(probe) == plain(probe) else plain), tokens


@lru_cache(maxsize=2)
def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    """One per worker process."""
    return Tokenizers(a_path, b_path)


def common_cuts(a_ends, b_ends, a_stop, b_stop):
    """(A tokens, B tokens) up to each common end, ascending, by divide and conquer in all texts at once.

    ``a_ends`` and ``b_ends`` are ascending byte offsets of token ends, ``a_stop`` and ``b_stop`` the tokens up to the
    end of each text, where both end. An interval tries the A end in its middle, then those to both sides of it, until
    a bisection of the B ends meets one; then it is two intervals. One that tries all its ends is a leaf.
    """
    import numpy as np

    a_ends, b_ends, a_hi, b_hi = (x.astype(np.int32) for x in (a_ends, b_ends, a_stop, b_stop))
    a_lo, b_lo = np.roll(a_hi, 1), np.roll(b_hi, 1)
    a_lo[0] = b_lo[0] = 0
    step = np.zeros(len(a_hi), np.int32)
    cuts_a, cuts_b = [a_hi], [b_hi]
    while True:
        # Inner ends are those of all tokens but the last; both sides need one, and an untried one.
        go = (a_hi - a_lo - 1 > step) & (b_hi - b_lo > 1)
        if not go.all():
            a_lo, a_hi, b_lo, b_hi, step = a_lo[go], a_hi[go], b_lo[go], b_hi[go], step[go]
        if not len(a_lo):
            return np.sort(np.concatenate(cuts_a)), np.sort(np.concatenate(cuts_b))
        inner = a_hi - a_lo - 1
        # Tries in the order m, m - 1, m + 1, m - 2 ... cover 0 .. inner - 1 with m = inner // 2.
        away = (step + 1) // 2
        p = a_lo + inner // 2 + np.where(step & 1, -away, away)
        at = np.searchsorted(b_ends, a_ends[p]).astype(np.int32)
        met = (b_ends[at] == a_ends[p]) & (at < b_hi - 1)
        a_cut, b_cut = p[met] + 1, at[met] + 1
        cuts_a.append(a_cut)
        cuts_b.append(b_cut)
        rest = ~met
        fresh = np.zeros(len(a_cut), np.int32)
        a_lo, a_hi = np.concatenate((a_lo[met], a_cut, a_lo[rest])), np.concatenate((a_cut, a_hi[met], a_hi[rest]))
        b_lo, b_hi = np.concatenate((b_lo[met], b_cut, b_lo[rest])), np.concatenate((b_cut, b_hi[met], b_hi[rest]))
        step = np.concatenate((fresh, fresh, step[rest] + 1))


def _written(ids, last_char, size_of, digits):
    """Bytes of the decimal ids, each followed by its mark, and where each ends."""
    import numpy as np

    n = size_of[ids]
    out = digits[ids]
    out[np.arange(len(ids)), n] = last_char
    return out[out != 0], np.cumsum(n + 1)


@lru_cache(maxsize=1)
def _digit_table(size: int):
    import numpy as np

    text = [str(i).encode() for i in range(size)]
    wide = max(map(len, text)) + 1
    table = np.zeros((size, wide), np.uint8)
    for i, t in enumerate(text):
        table[i, : len(t)] = list(t)
    return np.array([len(t) for t in text], np.int64), table


def _batch(t: Tokenizers, found: list[tuple]):
    """Of texts with tokens: A ids and B ids of all, tokens up to each text's end, ends and cuts."""
    import numpy as np

    a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    a_stop, b_stop = (np.cumsum([len(f[k]) for f in found]) for k in (0, 1))
    a_ends, b_ends = np.cumsum(t.a_len[a]), np.cumsum(t.b_len[b])
    return a, b, a_stop, b_stop, a_ends, b_ends, *common_cuts(a_ends, b_ends, a_stop, b_stop)


def aligned(t: Tokenizers, texts: list[str | None]) -> list[tuple]:
    """For each text: n_a, n_b, n_groups, n_links, digest of the groups, and the packed pairs, ascending."""
    import numpy as np

    none = (0, 0, 0, 0, "", np.zeros(0, np.int64))
    encoded = [t.encode(x) for x in texts]
    found = [e for e in encoded if e]
    if not found:
        return [none] * len(texts)
    a, b, a_stop, b_stop, a_ends, b_ends, a_cut, b_cut = _batch(t, found)
    n_a, n_b = np.diff(a_stop, prepend=0), np.diff(b_stop, prepend=0)
    n_groups = np.diff(np.searchsorted(a_cut, a_stop, "right"), prepend=0)
    # Between two ends of either side lie one token of each: that is a link.
    n_links = n_a + n_b - n_groups
    ends = np.sort(np.concatenate((a_ends, b_ends)), kind="stable")
    ends = ends[np.concatenate((ends[1:] != ends[:-1], [True]))]
    code = a[np.searchsorted(a_ends, ends)] * t.b_size + b[np.searchsorted(b_ends, ends)]
    key = np.sort((np.repeat(np.arange(len(found)), n_links) << (63 - HALF)) | code)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    times = np.diff(first, append=len(key))
    key = key[first]
    pair_stop = np.searchsorted(key, np.arange(1, len(found) + 1) << (63 - HALF))
    packed = ((key & ((1 << (63 - HALF)) - 1)) << HALF) | times
    # A token's place in the line is what stands before it on its side and, of the other, in earlier groups or its own.
    sizes_a, sizes_b = np.diff(a_cut, prepend=0), np.diff(b_cut, prepend=0)
    line, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    line[np.arange(len(a)) + np.repeat(b_cut - sizes_b, sizes_a)] = a
    line[np.arange(len(b)) + np.repeat(a_cut, sizes_b)] = b
    mark[a_cut + b_cut - sizes_b - 1], mark[a_cut + b_cut - 1] = ord("|"), ord(";")
    written, at = _written(line, mark, *_digit_table(max(len(t.a_bytes), t.b_size)))
    written, at = written.tobytes(), np.concatenate(([0], at))[np.concatenate(([0], a_stop + b_stop))]
    rows = iter(range(len(found)))
    out = []
    for e in encoded:
        if not e:
            out.append(none)
            continue
        i = next(rows)
        digest = hashlib.sha256(written[at[i] : at[i + 1] - 1]).hexdigest()
        out.append((n_a[i], n_b[i], n_groups[i], n_links[i], digest, packed[pair_stop[i - 1] if i else 0 : pair_stop[i]]))
    return out


def _slices(batch, column: int):
    """Parts of a record batch with about TOGETHER bytes of text each."""
    import numpy as np
    import pyarrow.compute as pc

    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)))
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(size, before + TOGETHER, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def links(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """ROWS: each document's numbers, digest and packed pairs."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        t = tokenizers(a_path, b_path)
        for batch in batches:
            for part in _slices(batch, 1):
                got = aligned(t, part.column(1).to_pylist())
                *numbers, digests, pairs = zip(*got, strict=True)
                stops = np.cumsum([0, *map(len, pairs)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(stops), pa.array(np.concatenate(pairs)))
                columns = [part.column(0), *(pa.array(np.array(n, np.int64)) for n in numbers), pa.array(digests, pa.string()), lists]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ROWS.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ROWS)


def spans(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """SPANS: the ids of both sides and, for each group, the tokens of A and of B up to its end."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        t = tokenizers(a_path, b_path)
        for batch in batches:
            for part in _slices(batch, 1):
                rows = []
                for e in map(t.encode, part.column(1).to_pylist()):
                    a, b, *_, a_cut, b_cut = _batch(t, [e]) if e else [np.zeros(0, np.int64)] * 4
                    rows.append((a, b, a_cut, b_cut))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([x.astype(np.int32) for x in c], pa.list_(pa.int32())) for c in zip(*rows, strict=True))], names=["doc_id", "a", "b", "a_cuts", "b_cuts"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SPANS)


def pair_counts(rows: DataFrame, b_size: int) -> DataFrame:
    """(pair, n, best): documents that hold a pair linked; whether n is the highest of the pair's A id."""
    counts = rows.select(F.explode("pairs").alias("p")).groupBy(F.shiftright("p", HALF).alias("pair")).agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts, "pair-counts")
    a = F.expr(f"pair div {b_size}")
    top = counts.groupBy(a.alias("a")).agg(F.max("n").alias("top"))
    # A row for each A id at most: the size of a vocabulary.
    out = stored(counts.withColumn("a", a).join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best")), "pairs")
    discard(counts)
    return out


def frequent_floor(pairs: DataFrame, most: int) -> int:
    """The least power of two such that at most ``most`` pairs have so many documents or more."""
    bins = pairs.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).count().collect()  # at most 63 rows
    total, floor = 0, 0
    for k, n in sorted(bins, reverse=True):
        total += n
        if total > most:
            floor = 1 << (k + 1)
            break
    return floor


def scored(docs: DataFrame, a_path: str, b_path: str, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    b_size = _b_size(b_path)
    rows = stored(links(docs, a_path, b_path).withColumn("row", F.monotonically_increasing_id()), "links", compression="zstd")
    pairs = pair_counts(rows, b_size)
    floor = frequent_floor(pairs, limit // PAIR_BYTES)
    held = rows.select("row", F.explode("pairs").alias("p")).select("row", F.shiftright("p", HALF).alias("pair"), F.col("p").bitwiseAND((1 << HALF) - 1).alias("times"))
    sums = [F.sum("times").alias("links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")]
    # At most ``limit`` bytes are sent; the pairs below the floor are rare, so that no key of the join is hot.
    parts = [held.join(F.broadcast(pairs.where(F.col("n") >= floor)), "pair").groupBy("row").agg(*sums)]
    if floor:
        parts.append(held.join(pairs.where(F.col("n") < floor).hint("shuffle_hash"), "pair").groupBy("row").agg(*sums))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]).groupBy("row").agg(F.sum("links").alias("links"), F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = rows.drop("pairs").join(both, "row", "left")
    out = out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")
    out = stored(out, "aligned")
    discard(rows, pairs)
    return out


@lru_cache(maxsize=4)
def _b_size(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()
