"""N-gram Jaccard join by T-occurrence search over word shingles.

Documents with the same shingle set form one class; only classes are joined. A set x of n shingles shares at least T
of them with any similar set, so all but T - 1 of its inverted lists, the short ones, name each partner (DivideSkip
with a count of one): the T - 1 long lists are left to probing. An order of the shingles with the frequent ones last
says which lists are short. Of two similar sets the smaller also finds the larger by fewer lists, so that a list
counts only if it is among those of some member (``indexed``).

The members of a short list meet in a task, without those that differ from all others in too many bits of a parity
bitmap, together with what such lists connect, if one task can hold it. There, each class is a query over the others'
inverted lists: the short lists are merged, and what they find often enough is looked up in the long ones by binary
search; what reaches the overlap is a link.

Links that join what is joined already are not written: a list of m classes gives at most m - 1. A list too long
for a task is cut into blocks, each searched together with a few pivots; then the classes that are not in the
list's main component are searched against all blocks. No list is dropped and no link between components is missed.

Edge cases: null, empty and blank texts have no shingles, link with nothing and form components of their own. A
text with fewer words than a shingle is one shingle. Very long texts are sets like others; a task holds few of them
at once. Rows with a null doc_id are left out. Rows that repeat a doc_id are one document with the union of links.
Texts with the same set are one class, whatever their order. Extra columns are ignored. An empty table gives an empty
result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_LIMIT, discard, maybe_broadcast, small_batches, stored
from .components import components


@dataclass(frozen=True)
class Settings:
    words: int = 4  # of a shingle
    percent: int = 85  # Jaccard similarity, in hundredths
    frequent: int = 16  # documents, in tasks that have two at least, from which a shingle counts as frequent
    often: int = 24  # classes that have a shingle in their prefix, from which it counts as frequent too
    frequent_most: int = 1_000_000  # frequent shingles that are put last, at most (the most frequent ones)
    window: int = 1_000_000  # shingles that a task counts at once
    room: int = 1 << 19  # shingles searched together; each set counts for SET_ROOM more
    pivots: int = 8
    send: int = BROADCAST_LIMIT  # bytes of shingles that tasks are sent; more are joined


SET_ROOM = 128
PROBED = 64  # candidates looked up in the long lists at once


class WordHashes(dict):
    """word -> 64-bit hash as bytes."""

    def __missing__(self, word: bytes) -> bytes:
        import xxhash

        out = xxhash.xxh64(word).intdigest().to_bytes(8, "little")
        if len(word) <= 64:
            if len(self) >= 100_000:
                self.clear()
            self[word] = out
        return out


def shingle_set(text: bytes | None, width: int, hashes: WordHashes):
    """Sorted distinct 64-bit hashes of the shingles; bytes.lower and bytes.split know ASCII only, as the contract."""
    import numpy as np

    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    h = np.frombuffer(b"".join(map(hashes.__getitem__, words)), dtype="<u8")
    if len(h) < width:
        parts, seed = [h[i : i + 1] for i in range(len(h))], len(h)
    else:
        parts, seed = [h[i : len(h) - width + 1 + i] for i in range(width)], width
    x = np.full(len(parts[0]), seed, np.uint64)
    for p in parts:
        x = (x ^ p) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((x ^ (x >> np.uint64(32))).view(np.int64))


def set_keys(x) -> tuple[int, int]:
    """128-bit hash of a sorted set, which with its size names a class."""
    import xxhash

    d = xxhash.xxh3_128(x.tobytes()).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def least_overlap(n: int, percent: int) -> int:
    """The overlap that a set of n needs with any other: percent/100 of itself at least."""
    return -(-percent * n // 100)


def prefix(x, frequent, percent: int):
    """The n - T + 1 first shingles: those not in the sorted array ``frequent`` first, then by value."""
    import numpy as np

    p = len(x) - least_overlap(len(x), percent) + 1
    last = _among(x, frequent)
    return np.concatenate((x[~last], x[last]))[:p]


def indexed(n: int, percent: int) -> int:
    """So many first shingles of a set of n name all similar sets that are no smaller, by the prefixes of those."""
    return n - -(-2 * percent * n // (100 + percent)) + 1


def _among(x, known):
    """Which of ``x`` are in the sorted array ``known``."""
    import numpy as np

    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def packed(x) -> bytes:
    """Six bytes for each of the sorted hashes: their upper 48 bits."""
    import numpy as np

    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def unpacked(b: bytes):
    import numpy as np

    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view(np.int64).ravel()


def _weight(n: str = "n") -> Column:
    return F.sum(F.col(n) + SET_ROOM)


# Sets and classes


def profiled(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, n, key, key2, tokens) of each row, the only pass over the texts.

    Further rows without tokens: ``key`` is a shingle that n classes of a task share.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        hashes, held, size, seen = WordHashes(), [], 0, set()
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())

        def out(*cols):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n", "key", "key2", "tokens"])

        def counted():
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            many = n > 1
            none = [None] * int(many.sum())
            return out(none, n[many].astype(np.int32), tokens[many], none, none)

        for b in batches:
            ids, ns, keys, sets = b.column(0).to_pylist(), [], [], []
            for t in b.column(1):
                x = shingle_set(t.as_py(), s.words, hashes)
                ns.append(len(x))
                keys.append(k := set_keys(x))
                sets.append(packed(x))
                if k not in seen:
                    seen.add(k)
                    held.append(x >> 16 << 16)
                    size += len(x)
                    if size > s.window:
                        yield counted()
                        held, size, seen = [], 0, set()
            yield out(ids, ns, [k[0] for k in keys], [k[1] for k in keys], sets)
        if held:
            yield counted()

    rows = docs.where("doc_id is not null").select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n int, key long, key2 long, tokens binary")


def membership(profile: DataFrame) -> DataFrame:
    """(doc_id, n, key, id) of each row with shingles; id is the class, by its least doc_id."""
    rows = profile.where("tokens is not null and n > 0").select("doc_id", "n", "key", "key2")
    least = rows.groupBy("key", "key2", "n").agg(F.min("doc_id").alias("id"))
    return stored(rows.join(least, ["key", "key2", "n"]).select("doc_id", "n", "key", "id"), "members")


def class_sets(profile: DataFrame, members: DataFrame) -> DataFrame:
    """(id, n, tokens): one row for each class."""
    copies = members.where("doc_id <> id").select("doc_id", "key").distinct()
    n = copies.count()
    rows = profile.where("tokens is not null and n > 0").join(maybe_broadcast(copies, n, 48), ["doc_id", "key"], "left_anti")
    sets = rows.select(F.col("doc_id").alias("id"), "n", "tokens")
    return sets if 48 * n <= BROADCAST_LIMIT else stored(sets, "classes", compression="none")


# Inverted lists


def frequent_shingles(profile: DataFrame, s: Settings):
    """Sorted array of at most ``s.frequent_most`` shingles. Results do not depend on it, only the work does."""
    import numpy as np

    counted = profile.where("tokens is null").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= s.frequent)
    rows = counted.orderBy(F.desc("n"), "key").limit(s.frequent_most).select("key").toArrow()
    return np.sort(np.asarray(rows.column(0), dtype=np.int64))


def prefixes(classes: DataFrame, last, s: Settings) -> DataFrame:
    """(token, index): the prefix of each class; which of it is indexed."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            got = [prefix(unpacked(t), last.value, s.percent) for t in b.column(1).to_pylist()]
            if got:
                index = [np.arange(len(p)) < indexed(n, s.percent) for p, n in zip(got, b.column(0).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got)), pa.array(np.concatenate(index))], names=["token", "index"])

    return classes.select("n", "tokens").mapInArrow(run, "token long, index boolean")


def often_listed(classes: DataFrame, frequent, s: Settings):
    """``frequent`` with the shingles whose lists are long under it, counted over all classes, at most ``frequent_most``."""
    import numpy as np

    last = classes.sparkSession.sparkContext.broadcast(frequent)
    counted = prefixes(classes, last, s).groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= s.often)
    rows = counted.orderBy(F.desc("n"), "token").limit(s.frequent_most).select("token").toArrow()
    return np.union1d(frequent, np.asarray(rows.column(0), dtype=np.int64))


def postings(classes: DataFrame, last, s: Settings, only=None, bits: bool = False) -> DataFrame:
    """(token, id, n, blocks, bits): the lists that each class is in.

    ``only``: broadcast arrays, the sorted tokens that count and their blocks; other tokens are left out. ``bits``:
    with the parity bitmap of the class for lists of no blocks.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            tokens, rows, blocks, maps = [], [], [], []
            for i, t in enumerate(b.column(2).to_pylist()):
                x = unpacked(t)
                p = prefix(x, last.value, s.percent)
                k = np.zeros(len(p), np.int32)
                if only is not None:
                    p = p[_among(p, only.value[0])]
                    k = only.value[1][np.searchsorted(only.value[0], p)]
                tokens.append(p)
                rows.append(np.full(len(p), i))
                blocks.append(k)
                mine = sketch(x).tobytes() if bits and (k == 0).any() else None
                maps += [mine if few else None for few in k == 0]
            if maps:
                at = pa.array(np.concatenate(rows))
                cols = [pa.array(np.concatenate(tokens)), b.column(0).take(at), b.column(1).take(at), pa.array(np.concatenate(blocks)), pa.array(maps, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["token", "id", "n", "blocks", "bits"])

    return classes.select("id", "n", "tokens").mapInArrow(run, "token long, id long, n int, blocks int, bits binary")


def _joined(run, rows: int):
    """``run`` with its batches put together to so many rows."""

    def out(batches):
        import pyarrow as pa

        held, n = [], 0
        for b in run(batches):
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return out


def _sent(tokens: DataFrame, blocks: Column | None = None):
    """Broadcast arrays of the sorted ``token`` column and its blocks, for ``postings``; the caller has proven the size."""
    import numpy as np

    got = tokens.select("token", (F.lit(0) if blocks is None else blocks).cast("int").alias("blocks")).toArrow()
    order = np.argsort(token := np.asarray(got.column(0), dtype=np.int64))
    return tokens.sparkSession.sparkContext.broadcast((token[order], np.asarray(got.column(1), dtype=np.int32)[order]))


def _once(lists: DataFrame, *also: str) -> DataFrame:
    """(token, m, weight): of the lists with the same members, the one of the least token. m: its members."""
    member = F.xxhash64("id")
    aggs = (F.count(F.lit(1)).alias("m"), _weight().alias("weight"), F.bit_xor(member).alias("x"), F.bit_xor(F.xxhash64(member, F.lit(1))).alias("y"))
    sums = lists.groupBy("token").agg(*aggs)
    return sums.where("m > 1").groupBy("m", "weight", "x", "y").agg(F.min("token").alias("token")).select("token", "m", "weight")


def shared_lists(classes: DataFrame, frequent, s: Settings) -> DataFrame:
    """(token, id, n, blocks, bits): the inverted lists of two classes at least, one for each set of members.

    ``blocks`` is 0 for lists that one task can search, whose rows have the parity ``bits`` of their class.
    """
    last = classes.sparkSession.sparkContext.broadcast(frequent)  # at most ``frequent_most`` longs
    counts = prefixes(classes, last, s).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.max("index").alias("index"))
    shared = stored(counts.where("n > 1 and index").select("token"), "shared-tokens")
    few = 12 * shared.count() <= s.send
    rows = postings(classes, last, s, _sent(shared)) if few else postings(classes, last, s).join(shared, "token", "left_semi")
    once = stored(_once(rows), "first-lists")
    discard(shared)
    blocks = F.when(F.col("weight") <= s.room, 0).otherwise(F.ceil(F.col("weight") / (s.room // 2))).cast("int")
    if 12 * once.count() <= s.send:
        return postings(classes, last, s, _sent(once, blocks), bits=True)

    def sketched(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sketch(unpacked(t)).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["id", "bits"])

    maps = classes.select("id", "tokens").mapInArrow(sketched, "id long, bits binary")
    lists = postings(classes, last, s).drop("blocks", "bits").join(once.select("token", blocks.alias("blocks")), "token")
    return lists.join(maps, "id").select("token", "id", "n", "blocks", F.when(F.col("blocks") == 0, F.col("bits")).alias("bits"))


def sketch(x):
    """Parity bitmap: bit h(token) of the set flips for each token. At least as many tokens differ as bits do.

    With half a bit for each token, unrelated sets still differ in more bits than similar ones may.
    """
    import numpy as np

    bits = 1 << max(7, (max(1, len(x) // 2) - 1).bit_length())
    at = (x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) & (bits - 1)
    return np.packbits(np.bincount(at, minlength=bits).astype(np.uint8) & 1, bitorder="little")


def plausible(sizes, bitmaps: list, percent: int):
    """Which sets may reach the similarity with another, by size and parity bitmap. No pair that does is missed."""
    import numpy as np

    m = len(sizes)
    alive = np.zeros(m, bool)
    width = np.array([len(b) for b in bitmaps])
    rows = {w: np.flatnonzero(width == w) for w in set(width.tolist())}
    words = {w: np.stack([bitmaps[i] for i in k]).view(np.uint64) for w, k in rows.items()}

    def fold(b):
        return b[: len(b) // 2] ^ b[len(b) // 2 :]

    for i in range(m):
        n = int(sizes[i])
        for w, mine in ((width[i], bitmaps[i]), (width[i] // 2, fold(bitmaps[i]))):
            k = rows.get(int(w))
            if k is None:
                continue
            other = sizes[k]
            near = (100 * other >= percent * n) & (percent * other <= 100 * n) & (k != i)
            if not near.any() or alive[i] and alive[k[near]].all():
                continue
            differ = np.bitwise_count(words[int(w)][near] ^ mine.view(np.uint64)).sum(1)
            fits = differ * (100 + percent) <= (100 - percent) * (other[near] + n)
            if fits.any():
                alive[i] = True
                alive[k[near][fits]] = True
    return alive


def likely_lists(lists: DataFrame, s: Settings) -> DataFrame:
    """(token, id, n, blocks, block): lists that one task can search, without the members that no other member can be
    similar to, as block -1; others as they are, dealt into blocks."""

    def keep(batches):
        import numpy as np
        import pyarrow as pa

        def out(rows):
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["token", "id", "n", "blocks", "block"])

        for (_, block), rows in _grouped(batches, 6, cut=lambda k: k[1] >= 0):
            if block < 0:
                got = plausible(np.array([r[2] for r in rows]), [np.frombuffer(r[5], np.uint8) for r in rows], s.percent)
                rows = [r for r, k in zip(rows, got, strict=True) if k]
            if rows:
                yield out([r[:5] for r in rows])

    block = F.when(F.col("blocks") == 0, -1).otherwise(F.pmod(F.xxhash64("id", "token"), F.greatest("blocks", F.lit(1)))).cast("int")
    rows = lists.select("token", "id", "n", "blocks", block.alias("block"), "bits")
    dealt = rows.repartition("token", "block").sortWithinPartitions("token", "block", "id")
    return stored(dealt.select("token", "id", "n", "blocks", "block", "bits").mapInArrow(_joined(keep, 4096), "token long, id long, n int, blocks int, block int"), "likely")


def _grouped(batches, columns: int, cut):
    """((token, block), rows) of a sorted partition; groups that ``cut`` names come in pieces."""
    held, current = [], None
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns[:columns]), strict=True):
            key = (row[0], row[4])
            if held and (key != current or cut(key) and len(held) >= 512):
                yield current, held
                held = []
            current = key
            held.append(row)
    if held:
        yield current, held


# Search


def search(sets: list, percent: int, asks: list[bool] | None = None) -> list[tuple[int, int]]:
    """Links between sets that are not joined yet, by T-occurrence with divided lists.

    ``sets``: sorted arrays. ``asks``: which sets are queries (all, if None); others only answer.
    """
    import numpy as np

    m = len(sets)
    order = sorted(range(m), key=lambda i: len(sets[i]))
    size = np.array([len(sets[i]) for i in order])
    tokens = np.concatenate([sets[i] for i in order])
    owner = np.repeat(np.arange(m), size)
    by = np.argsort(tokens, kind="stable")  # within a list, owners ascend
    tokens, owner = tokens[by], owner[by]
    starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
    heads, ends = tokens[starts], np.append(starts[1:], len(tokens))
    place = np.repeat(np.arange(len(heads)) * m, ends - starts) + owner  # ascending: list, then owner
    component, links, recent = np.arange(m), [], -1
    for q in range(m):
        if asks is not None and not asks[order[q]]:
            continue
        n, x = int(size[q]), sets[order[q]]
        lo = int(np.searchsorted(size, least_overlap(n, percent)))
        hi = q if asks is None else int(np.searchsorted(size, 100 * n // percent, side="right"))

        def join(y, both, q=q, n=n):
            if 100 * both >= percent * (n + int(size[y]) - both):
                component[component == component[y]] = component[q]
                links.append((order[q], order[int(y)]))

        if lo <= recent < hi and recent != q and component[recent] != component[q]:
            join(recent, int(_among(x, sets[order[recent]]).sum()))  # most often what was joined last joins this one
        if hi <= lo or (component[lo:hi] == component[q]).all():
            recent = q
            continue
        k = np.searchsorted(heads, x)
        a, z = starts[k], ends[k]
        need = -(-percent * (n + int(size[lo])) // (100 + percent))
        long = max(0, need - max(1, need // 16))  # lists left to probing
        split = np.argsort(z - a, kind="stable")
        short, rest = split[: n - long], split[n - long :]
        # The short lists are merged: a sort of sorted runs.
        merged, count = np.unique(np.concatenate([owner[a[i] : z[i]] for i in short]), return_counts=True)
        fits = (merged >= lo) & (merged < hi) & (count >= need - long) & (merged != q)
        merged, count = merged[fits], count[fits]
        left = np.argsort(-count, kind="stable")
        while len(left := left[component[merged[left]] != component[q]]):
            now, left = left[:PROBED], left[PROBED:]
            # Binary probes of the long lists for some candidates.
            wanted = k[rest] * m + merged[now][:, None]
            at = np.minimum(np.searchsorted(place, wanted), len(place) - 1)
            both = count[now] + (place[at] == wanted).sum(1)
            for y, c in zip(merged[now].tolist(), both.tolist(), strict=True):
                if component[y] != component[q]:
                    join(y, c)
        if (component == component[q]).sum() > 1:
            recent = q
    return links


def _searched(groups: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of classes. ``groups``: (grp, id, ask, tokens) with bounded room for each grp."""

    def run(batches):
        import pyarrow as pa

        held: dict[tuple, list] = {}
        current = None

        def links():
            asks = [v[1] for v in held.values()]
            if len(held) < 2 or not any(asks):
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, names=["a", "b"])
            ids = [k[0] for k in held]
            got = search([v[0] for v in held.values()], percent, None if all(asks) else asks)
            return pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in got], pa.int64()), pa.array([ids[j] for _, j in got], pa.int64())], names=["a", "b"])

        for b in batches:
            for grp, id, ask, tokens in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if grp != current:
                    yield links()
                    held, current = {}, grp
                mine = held.setdefault((id, hash(tokens)), [None, False])
                mine[0] = unpacked(tokens) if mine[0] is None else mine[0]
                mine[1] |= ask
        yield links()

    dealt = groups.repartition("grp").sortWithinPartitions("grp", "id")
    return dealt.select("grp", "id", "ask", "tokens").mapInArrow(_joined(run, 4096), "a long, b long")


def _clusters(lists: DataFrame, s: Settings) -> DataFrame:
    """(grp, id): classes that lists connect, once each; where these are too many for a task, the lists one by one."""
    ends = lists.groupBy("token").agg(F.min("id").alias("low"))
    label = components(lists.join(ends, "token").select("id", "low"), "id", "low")
    sized = label.join(lists.select(F.col("id").alias("node"), "n").distinct(), "node")
    sizes = sized.groupBy("component").agg(_weight().alias("weight"))
    small = label.join(sizes.where(F.col("weight") <= s.room), "component").select(F.xxhash64("component", F.lit("cluster")).alias("grp"), F.col("node").alias("id"))
    big = label.join(sizes.where(F.col("weight") > s.room), "component").select(F.col("node").alias("id"))
    rest = lists.join(big, "id", "left_semi").select(F.xxhash64("token").alias("grp"), "id")
    return small.unionByName(rest)


def _with_sets(groups: DataFrame, classes: DataFrame) -> DataFrame:
    """(grp, id, ask, tokens) of (grp, id, ask)."""
    groups = stored(groups.distinct(), "groups")
    return classes.select("id", "tokens").join(maybe_broadcast(groups, groups.count(), 48), "id")


def class_links(classes: DataFrame, profile: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(a, b): links between classes that span the components of the similarity graph."""
    frequent = often_listed(classes, frequent_shingles(profile, s), s)
    likely = likely_lists(shared_lists(classes, frequent, s), s)
    short, long = likely.where("block < 0").select("token", "id", "n"), likely.where("block >= 0")
    few = stored(short.join(_once(short).select("token"), "token", "left_semi"), "few-lists")
    # Long lists: blocks by hash, each with the same few pivots, which are those of least hash. A class is searched
    # in the longest of its lists first; what that leaves apart is found below, in all of them.
    chosen = long.groupBy("id").agg(F.max_by(F.struct("token", "block", "blocks"), F.struct("blocks", "token")).alias("l")).select("l.*", "id")
    first = F.slice(F.sort_array(F.collect_list(F.struct(F.xxhash64("id").alias("h"), "id"))), 1, s.pivots)
    per_block = chosen.groupBy("token", "block").agg(first.alias("p"), F.max("blocks").alias("blocks"))
    top = per_block.groupBy("token").agg(F.slice(F.sort_array(F.flatten(F.collect_list("p"))), 1, s.pivots).alias("p"), F.max("blocks").alias("blocks"))
    pivots = top.select("token", "blocks", F.explode("p.id").alias("id"))
    spread = pivots.select("token", "id", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    grouped = (
        _clusters(few, s)
        .unionByName(chosen.select(F.xxhash64("token", "block").alias("grp"), "id"))
        .unionByName(spread.select(F.xxhash64("token", "block").alias("grp"), "id"))
    )
    links = stored(_searched(_with_sets(grouped.withColumn("ask", F.lit(True)), classes), s.percent), "links")
    if long.isEmpty():
        return links
    # What is not in its list's main component yet asks all blocks of the list, in chunks.
    label = components(links)
    named = stored(long.join(label, long.id == label.node, "left").select("token", "id", "blocks", "block", F.coalesce("component", "id").alias("component")), "long-lists")
    sizes = named.groupBy("token", "component").agg(F.count(F.lit(1)).alias("c"))
    main = sizes.groupBy("token").agg(F.max_by("component", F.struct("c", "component")).alias("main"))
    rest = named.join(main, "token").where("component <> main")
    chunk = rest.select("token", "id", "blocks", F.col("block").alias("chunk"))
    asking = chunk.select("token", "id", "chunk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    asked = named.select("token", "id", "block").join(chunk.select("token", "chunk").distinct(), "token")
    pair = F.xxhash64("token", "chunk", "block").alias("grp")
    second = asking.select(pair, "id", F.lit(True).alias("ask")).unionByName(asked.select(pair, "id", F.lit(False).alias("ask")))
    more = stored(_searched(_with_sets(second, classes), s.percent), "links")
    return links.unionByName(more)


def joined(spark: SparkSession, docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach) of each document."""
    with small_batches(spark):
        profile = stored(profiled(docs, s), "shingles", compression="none")
        members = membership(profile)
        blank = stored(profile.where("tokens is not null and n = 0").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")), "blank")
        links = class_links(class_sets(profile, members), profile, s)
        # A doc_id of several sets joins their classes.
        repeated = members.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("last")).where("a <> last").select("doc_id", "a")
        label = components(links.unionByName(members.join(repeated, "doc_id").select("a", F.col("id").alias("b"))))
    discard(profile)
    named = members.join(label, members.id == label.node, "left")
    return named.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")).unionByName(blank)


def representatives(spark: SparkSession, docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The documents of least doc_id in their components, with all their columns.

    Texts without shingles and rows without a doc_id stay. Rows that repeat a doc_id are one document.
    """
    gone = stored(joined(spark, docs, s).where("component_id < doc_id").select("doc_id").distinct(), "copies")
    return docs.join(maybe_broadcast(gone, gone.count(), 24), "doc_id", "left_anti").select(*docs.columns)
