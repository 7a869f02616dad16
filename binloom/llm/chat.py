"""Chat formatting: a hidden Markov model over line features recovers speakers, then turns are rendered alike.

A transcript comes in pieces (conv_id, part, text) of raw lines, with or without speaker markers; where the pieces are
cut says nothing about turns. Each line is in one of six states, the first or a later line of a turn of a system, user
or assistant. Transitions and emissions are counted on labelled lines.

Parts are range-sorted once, and each task cuts its own into blocks of few parts, numbered in order over all tasks. A
conversation within one block is decoded there. For others, a block's max-plus matrix says how well it leads from each
state before it to each state at its end, matrices are multiplied along a conversation, in levels, and with the states
at its ends known, each block is decoded for itself. So Viterbi's path is the best one over the whole conversation,
while no task holds more than a block of text, whatever share of the rows one conversation has.

Edge cases: a null or empty text is one empty line. A null conv_id is a conversation like any other; null parts come
first. Parts that repeat a number follow each other by text. A very long text is a block of its own. Of paths that
score alike, the one of the earlier states counts. A turn of more than ``turn`` blocks comes in several rows, of which
the first opens it. Extra columns are ignored. An empty table gives an empty result; without labelled lines all states
weigh alike.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import maybe_broadcast, small_batches, stored

ROLES = ("system", "user", "assistant")
NEVER = -1e9
STATES = tuple(f"{r}-{k}" for r in ROLES for k in ("first", "later"))
# Names that speakers go by.
ALIASES = {
    "system": "system|sys|instructions?|context|note",
    "user": "user|human|customer|question|prompter|student|me|you|q",
    "assistant": "assistant|ai|bot|gpt|model|agent|answer|support|teacher|a",
}
MARKER = re.compile(
    r"^\s*(?P<open>#{1,4}\s*|<\|(?:im_start\|>)?|\[|\*\*|>\s*)?(?:" + "|".join(f"(?P<{r}>{a})" for r, a in ALIASES.items()) + r")(?P<close>\|>|\]:?|:\*\*|\*\*:|:|\s*>)\s*",
    re.IGNORECASE,
)
FEATURES = {"marker": 4, "style": 3, "before": 3, "size": 5, "question": 2, "mark": 3}


@dataclass(frozen=True)
class Settings:
    block: int = 64  # parts decoded together, at most
    chars: int = 1 << 18  # characters from which a block takes no further part
    level: int = 1024  # matrices multiplied together
    turn: int = 1024  # blocks whose share of a turn is put into one row
    smoothing: float = 0.5
    sample: int = 20_000  # labelled parts that are counted, about, at most


@dataclass
class Model:
    start: list = field(default_factory=lambda: [0.0] * len(STATES))
    move: list = field(default_factory=lambda: [[0.0] * len(STATES) for _ in STATES])
    emit: dict = field(default_factory=lambda: {f: [[0.0] * n for _ in STATES] for f, n in FEATURES.items()})


def line_features(line: str, before: str | None) -> tuple[int, ...]:
    """One number for each of FEATURES."""
    m = MARKER.match(line)
    marker = next((1 + i for i, r in enumerate(ROLES) if m[r]), 0) if m else 0
    style = 0 if not m else 1 if m["open"] else 2
    text = line.strip()
    n = len(text)
    return (
        marker, style, 0 if before is None else 1 if not before.strip() else 2, sum(n > k for k in (0, 40, 160, 640)),
        int(text.endswith("?")), 1 if re.match(r"(?:[-*>•]|\d+[.)])\s|```", text) else 2 if not text else 0,
    )


class Scores(dict):
    """features -> log probabilities by state."""

    def __init__(self, model: Model):
        import numpy as np

        self.emit = [np.array(model.emit[f]) for f in FEATURES]

    def __missing__(self, features: tuple[int, ...]):
        out = self[features] = sum(e[:, v] for e, v in zip(self.emit, features, strict=True))
        return out


BEFORE = (None, "", "x")


def _logs(lines: list[str], before: int, scores: Scores):
    """``before``: 0 where no line is before these, 1 where a blank one is, 2 where another is."""
    import numpy as np

    last = [BEFORE[before], *lines[:-1]]
    return np.array([scores[line_features(x, y)] for x, y in zip(lines, last, strict=True)])


def _lines(parts) -> list[tuple[int | None, int, str]]:
    return [(p["part"], i, x) for p in parts for i, x in enumerate((p["text"] or "").split("\n"))]


def _batch(rows: list[tuple], schema):
    import pyarrow as pa

    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


# Blocks

BLOCKS = "pid int, k long, conv_id long, whole boolean, before int, tail int, parts array<struct<part:long,text:string>>"


def blocks(parts: DataFrame, s: Settings) -> DataFrame:
    """(seq, conv_id, whole, before, parts): consecutive parts of a conversation; seq ascends along it, without gaps.

    ``whole``: the block is all of its conversation. ``before``: see ``_logs``.
    """

    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        pid, k, size, last = TaskContext.get().partitionId(), 0, 0, None
        schema = pa.schema([("pid", pa.int32()), ("k", pa.int64()), ("conv_id", pa.int64()), ("whole", pa.bool_()), ("before", pa.int32()), ("tail", pa.int32()), ("parts", pa.list_(pa.struct([("part", pa.int64()), ("text", pa.string())])))])
        held: list[dict] = []
        starts, conv = False, None

        def block(ended: bool):
            nonlocal k, last
            tail = 2 if (held[-1]["text"] or "").rpartition("\n")[2].strip() else 1
            before = 0 if starts else -1 if last is None else last
            row = (pid, k, conv, starts and ended, before, tail, list(held))
            k, last = k + 1, tail
            held.clear()
            return _batch([row], schema)

        for b in batches:
            for c, part, text in zip(*(x.to_pylist() for x in b.columns[:3]), strict=True):
                if held and (c != conv or len(held) >= s.block or size >= s.chars):
                    yield block(c != conv)
                    size, starts = 0, c != conv
                elif not held and k == 0:
                    starts = False  # the first of the task may go on from the task before
                conv = c
                held.append({"part": part, "text": text})
                size += len(text or "")
        if held:
            yield block(False)

    rows = parts.select("conv_id", "part", "text")
    ranged = rows.repartitionByRange("conv_id", "part", "text").sortWithinPartitions("conv_id", "part", "text")
    cuts = stored(ranged.mapInArrow(cut, BLOCKS), "chat-blocks")
    # One row for each task: how many blocks it has, and what its first block follows.
    ends = cuts.groupBy("pid").agg(F.max("k").alias("k"), F.min_by(F.struct("conv_id"), "k").alias("first"), F.max_by(F.struct("conv_id", "tail"), "k").alias("last"))
    known, base, last = [], 0, None
    for r in sorted(ends.collect(), key=lambda r: r.pid):
        known.append((r.pid, base, last.tail if last is not None and last.conv_id == r.first.conv_id else 0))
        base, last = base + r.k + 1, r["last"]
    tasks = cuts.sparkSession.createDataFrame(known, "pid int, base long, follows int")
    before = F.when(F.col("before") < 0, F.col("follows")).otherwise(F.col("before")).alias("before")
    return cuts.join(F.broadcast(tasks), "pid").select((F.col("base") + F.col("k")).alias("seq"), "conv_id", "whole", before, "parts")


# Training


def fit(parts: DataFrame, s: Settings = Settings()) -> Model:
    """Count a model on (conv_id, part, text, roles, firsts): the role of each line and whether it opens a turn.

    Of more than ``s.sample`` parts, runs of parts are taken by hash.
    """
    import numpy as np

    def count(batches):
        import pyarrow as pa

        sums: dict[tuple[str, int, int], int] = {}

        def add(*k):
            sums[k] = sums.get(k, 0) + 1

        place, last, before = None, None, None
        for b in batches:
            for conv, block, text, roles, firsts in zip(*(c.to_pylist() for c in b.columns[:5]), strict=True):
                if place != (conv, block):
                    place, last, before = (conv, block), None, None if block == 0 else "x"
                for line, role, first in zip((text or "").split("\n"), roles, firsts, strict=True):
                    state = 2 * ROLES.index(role) + (not first)
                    if last is not None:
                        add("move", last, state)
                    elif block == 0:
                        add("start", state, 0)
                    for f, v in zip(FEATURES, line_features(line, before), strict=True):
                        add(f, state, v)
                    last, before = state, line
        yield _batch([(*k, n) for k, n in sums.items()], pa.schema([("what", pa.string()), ("state", pa.int32()), ("value", pa.int32()), ("n", pa.int64())]))

    block = F.floor(F.coalesce("part", F.lit(0)) / s.block).cast("long")
    n = parts.count()
    taken = F.pmod(F.xxhash64("conv_id", block), F.lit(1 << 20)) < int(min(1.0, s.sample / max(1, n)) * (1 << 20))
    sample = parts.where(taken).select("conv_id", block.alias("block"), "text", "roles", "firsts", "part")
    dealt = sample.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "part", "text")
    counts = dealt.mapInArrow(count, "what string, state int, value int, n long").groupBy("what", "state", "value").agg(F.sum("n").alias("n"))
    size = len(STATES)
    tables = {"start": np.zeros((size, 1)), "move": np.zeros((size, size))} | {f: np.zeros((size, n)) for f, n in FEATURES.items()}
    for r in counts.collect():  # at most a row for each cell of the tables
        tables[r.what][r.state, r.value] = r.n
    logs = {k: np.log((t + s.smoothing) / (t + s.smoothing).sum(1, keepdims=True)) for k, t in tables.items()}
    first = np.log((tables["start"][:, 0] + s.smoothing) / (tables["start"][:, 0] + s.smoothing).sum())
    for state, name in enumerate(STATES):  # a later line follows a line of its own turn
        if name.endswith("later"):
            first[state] = NEVER
            logs["move"][[k for k in range(size) if k // 2 != state // 2], state] = NEVER
    return Model(first.tolist(), logs["move"].tolist(), {f: logs[f].tolist() for f in FEATURES})


# Decoding


def _transfer(logs, move, opens: bool):
    """Max-plus matrix of a block: from the state before it to the state of its last line.

    A block that opens its conversation has no state before it: there, from the state of its first line.
    """
    import numpy as np

    m = np.full((len(STATES), len(STATES)), -np.inf)
    np.fill_diagonal(m, 0.0)
    if opens:
        m, logs = m + logs[0], logs[1:]
    for e in logs:
        m = (m[:, :, None] + move[None]).max(1) + e
    return m


def _times(a, b):
    return (a[:, :, None] + b[None]).max(1)


def _path(logs, move, entry, start, leave: int | None) -> list[int]:
    """Best states of a block's lines, from the state before it (``start`` scores, if there is none) to ``leave``."""
    import numpy as np

    score = (move[entry] if entry is not None else np.array(start)) + logs[0]
    back = []
    for e in logs[1:]:
        step = score[:, None] + move
        back.append(step.argmax(0))
        score = step.max(0) + e
    state = int(score.argmax()) if leave is None else leave
    out = [state]
    for b in reversed(back):
        out.append(state := int(b[state]))
    return out[::-1]


def _unrolled(mats: list, entry, start, leave: int | None) -> list[tuple[int | None, int]]:
    """(state before, last state) of each block of a run, given the run's own two."""
    import numpy as np

    move_in = None if entry is not None else np.array(start)
    scores, backs = [], []
    score = None
    for k, m in enumerate(mats):
        if k == 0:
            score = m[entry] if entry is not None else (move_in[:, None] + m).max(0)
            backs.append(None)
        else:
            step = score[:, None] + m
            backs.append(step.argmax(0))
            score = step.max(0)
        scores.append(score)
    state = int(score.argmax()) if leave is None else leave
    ends = [state]
    for b in reversed(backs[1:]):
        ends.append(state := int(b[state]))
    ends.reverse()
    return [(entry if k == 0 else ends[k - 1], e) for k, e in enumerate(ends)]


MATRIX = "seq long, conv_id long, m array<double>"
ENDS = "conv_id long, seq long, entry int, leave int"


def _ends(mats: DataFrame, model: Model, s: Settings) -> DataFrame:
    """(conv_id, seq, entry, leave): the best path's states around each block."""
    size = len(STATES)

    def groups(batches):
        """Rows of a sorted partition, by conversation and level."""
        held, current = [], None
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and r[:2] != current:
                    yield held
                    held = []
                current = r[:2]
                held.append(r)
        if held:
            yield held

    def multiply(batches):
        import numpy as np
        import pyarrow as pa

        for rows in groups(batches):
            m = np.array(rows[0][3]).reshape(size, size)
            for r in rows[1:]:
                m = _times(m, np.array(r[3]).reshape(size, size))
            yield _batch([(rows[0][1], rows[0][0], m.ravel().tolist())], pa.schema([("seq", pa.int64()), ("conv_id", pa.int64()), ("m", pa.list_(pa.float64()))]))

    def unroll(batches):
        import numpy as np
        import pyarrow as pa

        for rows in groups(batches):
            got = _unrolled([np.array(r[3]).reshape(size, size) for r in rows], rows[0][4], np.array(model.start), rows[0][5])
            yield _batch([(r[0], r[2], *x) for r, x in zip(rows, got, strict=True)], pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("entry", pa.int32()), ("leave", pa.int32())]))

    up = F.floor(F.col("seq") / s.level)
    grouped = mats.select("conv_id", up.alias("up"), "seq", "m")
    if grouped.groupBy("conv_id").agg(F.min("up").alias("a"), F.max("up").alias("z")).where("a < z").isEmpty():
        grouped = grouped.withColumns({"entry": F.lit(None).cast("int"), "leave": F.lit(None).cast("int")})
    else:
        above = stored(grouped.repartition("conv_id", "up").sortWithinPartitions("conv_id", "up", "seq").mapInArrow(multiply, MATRIX), "matrices")
        known = _ends(above, model, s).withColumnsRenamed({"conv_id": "_conv", "seq": "_up"})
        grouped = grouped.join(known, (F.col("up") == F.col("_up")) & F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv", "_up")
    return stored(grouped.repartition("conv_id", "up").sortWithinPartitions("conv_id", "up", "seq").mapInArrow(unroll, ENDS), "block-ends")


RUNS = "conv_id long, seq long, i int, part long, line int, n_lines int, role string, opens boolean, text string"


def recover(parts: DataFrame, model: Model, s: Settings = Settings()) -> DataFrame:
    """(conv_id, part, line, n_lines, role, opens, text): the turns in canonical form.

    ``part`` and ``line`` place the turn's first line. In order, the texts make the transcript.
    """

    def matrices(batches):
        import numpy as np
        import pyarrow as pa

        move, scores = np.array(model.move), Scores(model)
        schema = pa.schema([("seq", pa.int64()), ("conv_id", pa.int64()), ("m", pa.list_(pa.float64()))])
        for b in batches:
            for seq, conv, before, parts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                logs = _logs([x for _, _, x in _lines(parts)], before, scores)
                yield _batch([(seq, conv, _transfer(logs, move, before == 0).ravel().tolist())], schema)

    def decode(batches):
        import numpy as np
        import pyarrow as pa

        move, scores = np.array(model.move), Scores(model)
        schema = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("i", pa.int32()), ("part", pa.int64()), ("line", pa.int32()), ("n_lines", pa.int32()), ("role", pa.string()), ("opens", pa.bool_()), ("text", pa.string())])
        for b in batches:
            for seq, conv, before, parts, entry, leave in zip(*(c.to_pylist() for c in b.columns), strict=True):
                place = _lines(parts)
                path = _path(_logs([x for _, _, x in place], before, scores), move, entry, model.start, leave)
                runs: list[list] = []
                for (part, at, line), state in zip(place, path, strict=True):
                    role, first = ROLES[state // 2], state % 2 == 0
                    if first or not runs:
                        runs.append([conv, seq, len(runs), part, at, 0, role, first, []])
                    runs[-1][5] += 1
                    runs[-1][8].append(MARKER.sub("", line, count=1) if first else line)
                yield _batch([(*r[:8], "\n".join(r[8])) for r in runs], schema)

    with small_batches(parts.sparkSession, 256):
        cut = blocks(parts, s)
        within = cut.where("whole").select("conv_id", "seq", "before", "parts")
        across = cut.where("not whole").select("conv_id", "seq", "before", "parts")
        ends = _ends(stored(across.select("seq", "conv_id", "before", "parts").mapInArrow(matrices, MATRIX), "matrices"), model, s).drop("conv_id")
        known = across.join(maybe_broadcast(ends, ends.count(), 32), "seq")
        columns = [F.col(c) for c in ("seq", "conv_id", "before", "parts", "entry", "leave")]
        split = stored(known.select(*columns).mapInArrow(decode, RUNS), "chat-runs")
        alone = F.lit(None).cast("int")
        turns = stored(within.withColumns({"entry": alone, "leave": alone}).select(*columns).mapInArrow(decode, RUNS), "chat-turns")
    return _rendered(turns).unionByName(_rendered(_whole_turns(split, s)))


def _whole_turns(runs: DataFrame, s: Settings) -> DataFrame:
    """Runs of lines put together to turns: those that open none belong to the last turn that a block before opens."""
    opened = runs.groupBy("conv_id", "seq").agg(F.max(F.when(F.col("opens"), F.struct("seq", "i"))).alias("turn"))
    opened = opened.withColumn("up", F.floor(F.col("seq") / s.level))
    # In two levels, so that a task sees a small part of a long conversation's blocks, and few rows of the levels.
    inside = W.partitionBy("conv_id", "up").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    levels = opened.groupBy("conv_id", "up").agg(F.max("turn").alias("turn"))
    above = levels.select("conv_id", "up", F.max("turn").over(W.partitionBy("conv_id").orderBy("up").rowsBetween(W.unboundedPreceding, -1)).alias("above"))
    carried = opened.withColumn("inside", F.max("turn").over(inside)).join(above.withColumnsRenamed({"conv_id": "_c", "up": "_u"}), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("up") == F.col("_u")))
    carried = carried.select(F.col("seq").alias("_seq"), F.coalesce("inside", "above").alias("carried"))
    mine = F.when(F.col("opens"), F.struct("seq", "i")).otherwise(F.col("carried")).alias("turn")
    placed = runs.join(carried, F.col("seq") == F.col("_seq")).select("*", mine)
    piece = F.floor((F.col("seq") - F.col("turn.seq")) / s.turn).alias("piece")
    order = F.struct("seq", "i")
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "i", "text"))), lambda x: x["text"]), "\n")
    first = [F.min_by(c, order).alias(c) for c in ("part", "line", "role")]
    grouped = placed.groupBy("conv_id", "turn", piece).agg(*first, F.sum("n_lines").cast("int").alias("n_lines"), F.max("opens").alias("opens"), texts.alias("text"))
    return grouped


def _rendered(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id", "part", "line", "n_lines", "role", "opens", rendered(F.col("role"), F.col("opens"), F.col("text")).alias("text"))


def rendered(role: Column, opens: Column, body: Column) -> Column:
    head = F.when(opens, F.concat(F.lit("<|"), role, F.lit("|>\n"))).otherwise(F.lit(""))
    return F.concat(head, F.btrim(body, F.lit("\n")), F.lit("\n"))


# Raw transcripts of labelled conversations

# How each style writes a turn of a role; the last has no markers.
STYLES = (
    {"system": "System: ", "user": "User: ", "assistant": "Assistant: "},
    {"system": "### System:\n", "user": "### Human:\n", "assistant": "### Assistant:\n"},
    {"system": "[note]: ", "user": "Q: ", "assistant": "A: "},
    {"system": "<|system|>\n", "user": "<|user|>\n", "assistant": "<|assistant|>\n"},
    {"system": "", "user": "", "assistant": ""},
)


def transcripts(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, text, roles, firsts): turns as bare lines, each conversation in a style chosen by its id."""
    mark = F.lit("")
    for k, names in enumerate(STYLES):
        for role, text in names.items():
            mark = F.when((style("conv_id") == k) & (F.col("role") == role), F.lit(text)).otherwise(mark)
    text = F.concat(mark, F.coalesce("text", F.lit("")))
    n = F.size(F.split(text, "\n"))
    rows = conversations.select("conv_id", F.col("turn").alias("part"), text.alias("text"), F.coalesce("role", F.lit("user")).alias("role"), n.alias("n"))
    firsts = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: i == 1)
    return rows.select("conv_id", "part", "text", F.array_repeat("role", F.col("n")).alias("roles"), firsts.alias("firsts"))


def style(conv_id: str) -> Column:
    return F.pmod(F.xxhash64(conv_id), F.lit(len(STYLES)))
