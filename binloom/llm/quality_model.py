"""Quality classifier: a linear hinge-loss model on n-gram indicators scaled by class log-count ratios.

The n-grams are words, and runs of one to three word shapes (how a word mixes small letters, capitals, digits and
marks, and whether it repeats the word before it), hashed to a fixed number of slots. A text is the set of its
n-grams, each scaled by its log-count ratio, at unit length. The model is fitted by dual coordinate descent on a
bounded sample of labelled rows; a logistic curve fitted on rows left out of it turns margins into scores.

Edge cases: null and empty texts have no n-grams and get the score of the intercept. A sample without both labels
(an empty table too) gives every document its mean label, 0 if it has none. Rows with a null doc_id and
repeated rows are scored one by one, equal texts alike. A very long text is one row and one set of slots, at most
``slots`` of them. Labelled rows of equal hash are taken in the order of doc_id. Extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .labelled import labelled_texts


@dataclass(frozen=True)
class Settings:
    sample: int = 6_000  # labelled rows that the model is fitted on, at most
    slots: int = 1 << 18
    cost: float = 1.0
    smoothing: float = 1.0
    passes: int = 10
    left_out: float = 0.2  # of the sample, for the logistic curve


RUNS = re.compile(r"[^\W\d_]+|\d+|(.)\1*", re.DOTALL)
SAME = 0x5BD1E995  # the shape of a repeated word


def shape(word: str) -> str:
    """Small letters a, capitals A, a capital word Aa, digits 0, marks once, twice or thrice."""
    out = []
    for m in RUNS.finditer(word):
        run = m[0]
        if run[0].isalpha():
            out.append("a" if run.islower() else "A" if run.isupper() and len(run) > 1 else "Aa" if run[0].isupper() else "aA")
        else:
            out.append("0" if run[0].isdigit() else run[:3])
    return "".join(out)


class Hashes(dict):
    """word -> the crc32 of its lower case and of its shape, packed."""

    def __missing__(self, word: str) -> bytes:
        out = struct.pack("<II", zlib.crc32(word.lower().encode()), zlib.crc32(shape(word).encode()))
        if len(word) <= 64:
            if len(self) >= 300_000:
                self.clear()
            self[word] = out
        return out


def ngrams(text: str | None, hashes: Hashes, slots: int):
    """Sorted distinct slots of the text's n-grams."""
    import numpy as np

    words = (text or "").split()
    if not words:
        return np.zeros(0, np.int32)
    both = np.frombuffer(b"".join(map(hashes.__getitem__, words)), dtype="<u4").reshape(-1, 2)
    w, s = both[:, 0].astype(np.uint64), both[:, 1].astype(np.uint64)
    s[1:][w[1:] == w[:-1]] = SAME
    two = s[1:] * np.uint64(0x9E3779B1) + s[:-1] + np.uint64(1)
    three = s[2:] * np.uint64(0x85EBCA6B) + two[:-1] + np.uint64(2)
    shapes = np.unique(np.concatenate((s + np.uint64(3), two, three)))
    ids = np.concatenate((np.unique(w), shapes)) * np.uint64(0x9E3779B97F4A7C15)
    return np.unique((ids >> np.uint64(40)) % np.uint64(slots)).astype(np.int32)


@dataclass
class Model:
    weights: object = None  # log-count ratio x linear weight, by slot
    ratios: object = None
    intercept: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    constant: float = 0.0


def _descend(rows, y, ratios, s: Settings):
    """L1-loss dual coordinate descent with an intercept feature of 1. rows: slots of each text."""
    import numpy as np

    w, bias = np.zeros(s.slots + 1), s.slots
    alpha = np.zeros(len(rows))
    scale = [1.0 / max(np.sqrt(np.square(ratios[r]).sum()), 1e-9) for r in rows]
    order = np.random.default_rng(5)
    for _ in range(s.passes):
        for i in order.permutation(len(rows)):
            r = rows[i]
            x = ratios[r] * scale[i]
            g = y[i] * (x @ w[r] + w[bias]) - 1.0
            new = min(max(alpha[i] - g / (2.0 if len(r) else 1.0), 0.0), s.cost)
            if step := (new - alpha[i]) * y[i]:
                w[r] += step * x
                w[bias] += step
                alpha[i] = new
    return w[:bias], float(w[bias])


def _logistic(margin, y, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by damped Newton steps, with smoothed targets."""
    import numpy as np

    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, b = np.stack([margin, np.ones_like(margin)], 1), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        b = b + np.linalg.solve(h, x.T @ (t - p) - 1e-3 * b)
    return (float(b[0]), float(b[1])) if b[0] > 0 else (1.0, 0.0)


def fit(docs: DataFrame, labels: DataFrame, train, s: Settings = Settings()) -> Model:
    """Learn from at most ``s.sample`` labelled rows for which ``train`` (a condition on doc_id) holds."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        hashes = Hashes()
        for b in batches:
            ids = [ngrams(t, hashes, s.slots).tobytes() for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(ids, pa.binary())], names=["doc_id", "label", "u", "ids"])

    sample = labelled_texts(docs, labels, "quality", train, s.sample).select("doc_id", "label", "u", "text")
    got = stored(sample.mapInArrow(run, "doc_id long, label int, u double, ids binary"), "quality-sample")
    data = sorted(got.toLocalIterator(), key=lambda r: (r.u, r.doc_id))  # at most ``s.sample`` rows
    model = Model(constant=float(np.mean([r.label > 0 for r in data])) if data else 0.0)
    y = np.array([1.0 if r.label > 0 else -1.0 for r in data])
    rows = [np.frombuffer(r.ids, np.int32) for r in data]
    fitted = np.array([r.u >= s.left_out for r in data], dtype=bool)
    if len(set(y[fitted])) < 2:
        return model
    count = {k: np.bincount(np.concatenate([r for r, c, f in zip(rows, y, fitted, strict=True) if f and c == k]), minlength=s.slots) + s.smoothing for k in (1.0, -1.0)}
    ratios = np.log(count[1.0] / count[1.0].sum()) - np.log(count[-1.0] / count[-1.0].sum())
    w, model.intercept = _descend([r for r, f in zip(rows, fitted, strict=True) if f], y[fitted], ratios, s)
    model.weights, model.ratios = (ratios * w).astype(np.float32), ratios.astype(np.float32)
    if len(set(y[~fitted])) == 2:
        model.slope, model.shift = _logistic(np.array([_margin(r, model) for r, f in zip(rows, fitted, strict=True) if not f]), y[~fitted])
    return model


def _margin(ids, model: Model) -> float:
    import numpy as np

    r = model.ratios[ids]
    return float(model.weights[ids].sum() / max(np.sqrt(np.square(r).sum()), 1e-9)) + model.intercept


def score(docs: DataFrame, model: Model, s: Settings = Settings()) -> DataFrame:
    """doc_id, score, predicted for each row of ``docs``, from the whole texts."""
    rows = docs.select("doc_id", "text")
    if model.weights is None:
        out = rows.select("doc_id", F.lit(model.constant).alias("score"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)  # two arrays of ``s.slots`` floats

        def run(batches):
            import numpy as np
            import pyarrow as pa

            hashes, m = Hashes(), shared.value
            for b in batches:
                margins = np.array([_margin(ngrams(t, hashes, s.slots), m) for t in b.column(1).to_pylist()], dtype=float)
                p = 1 / (1 + np.exp(-np.clip(m.slope * margins + m.shift, -30, 30)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p)], names=["doc_id", "score"])

        out = rows.mapInArrow(run, "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
