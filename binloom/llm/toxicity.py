"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

A lexicon of words and word stems is learned from one part of the labelled sample, the trees from another, the
calibration from a third, so that none is judged by what it has seen. Each word of a text becomes one byte of flags
(lexicon tier, second person, capitals, obfuscation); densities, proximities and rates come from those bytes.

Edge cases: null and empty texts have all-zero features and get a score like any other. A sample without both
labels (an empty table too) gives every document its mean label, 0 if it has none. Rows with a null doc_id and
repeated rows are scored one by one, equal texts alike. A very long text is one row, read word by word into a byte
for each. Labelled rows of equal hash are taken in the order of doc_id. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, small_batches, stored
from .labelled import labelled_texts

# Second-person pronouns of English, German, French and Spanish.
SECOND_PERSON = frozenset("you your yours yourself ur u du dich dir dein deine euch ihr tu te toi vous ton ta tes tú ti usted ustedes vosotros".split())
# Common insults of the same languages, which a learned lexicon adds to.
INSULTS = frozenset(
    "idiot idiots idiotic moron morons stupid dumb dumbass imbecile fool loser losers scum trash garbage pathetic worthless disgusting clown "
    "freak creep pig rat vermin filth filthy bastard bitch asshole jerk retard ugly liar hate "
    "dummkopf arschloch blödmann trottel abschaum dreckskerl connard connasse salaud abruti crétin imbécile idiota estúpido imbécil basura cabrón".split()
)
# Marks that stand for letters.
LEET = str.maketrans("013457@$!", "oieastasi")
OBFUSCATED = re.compile(r"\w[0-9@$!*#.\-_]+\w|[@$]\w")
NOT_LETTERS = re.compile(r"[\W\d_]+")
STEMS = (4, 5, 6, 7)

FEATURES = (
    "log_words", "strong_density", "medium_density", "weak_density", "log_strong", "log_medium", "near_second_person",
    "second_person_rate", "capitals_rate", "exclamation_rate", "question_rate", "symbol_rate", "obfuscation_rate", "obfuscated_hit_rate",
)


@dataclass(frozen=True)
class Settings:
    sample: int = 12_000  # labelled rows that are learned from, at most
    lexicon: int = 4_000  # terms, at most
    min_docs: int = 3
    min_ratio: float = 1.5  # log ratio of a term's rates in toxic and other texts
    min_z: float = 3.5
    tiers: tuple[float, float] = (2.5, 4.0)
    near: int = 5  # words
    trees: int = 20
    depth: int = 4
    parts: tuple[float, float] = (0.45, 0.85)  # below: lexicon; between: trees; above: calibration


def plain(word: str) -> str:
    return NOT_LETTERS.sub("", word).lower()


def terms(letters: str) -> list[str]:
    return [letters + "$", *(letters[:k] for k in STEMS if len(letters) >= k)] if len(letters) > 1 else []


def _term_counts(batches):
    import pyarrow as pa

    stats: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0, 0])  # uses, documents; other, toxic
    total = [0, 0]
    n_docs = [0, 0]
    for b in batches:
        for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            found = Counter(plain(w) for w in (text or "").split())
            toxic = int(label > 0)
            total[toxic] += sum(found.values())
            n_docs[toxic] += 1
            uses: Counter = Counter()
            for w, n in found.items():
                for t in terms(w):
                    uses[t] += n
            for t, n in uses.items():
                s = stats[t]
                s[toxic] += n
                s[2 + toxic] += 1
    stats[""] = [*total, *n_docs]
    # A term without a toxic document in this part counts only as what others lack, which is looked up later.
    cols = list(zip(*((t, *s) for t, s in stats.items()), strict=True))
    kinds = (pa.string(), *[pa.int64()] * 4)
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["term", "uses0", "uses1", "docs0", "docs1"])


def learn_lexicon(sample: DataFrame, s: Settings) -> dict[str, int]:
    """term -> tier 1 to 3. At most ``s.lexicon`` terms."""
    counts = sample.select("text", "label").mapInArrow(_term_counts, "term string, uses0 long, uses1 long, docs0 long, docs1 long")
    counts = stored(counts.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("uses0", "uses1", "docs0", "docs1")]).where(f"docs1 >= {s.min_docs} or term = ''"), "terms")
    whole = counts.where("term = ''").first()
    if whole is None or not whole.docs0 or not whole.docs1:
        return {}
    ratio = F.log((F.col("uses1") + 0.5) / (whole.uses1 + 1)) - F.log((F.col("uses0") + 0.5) / (whole.uses0 + 1))
    p = (F.col("docs1") + F.col("docs0")) / (whole.docs1 + whole.docs0)
    z = (F.col("docs1") / whole.docs1 - F.col("docs0") / whole.docs0) / F.sqrt(p * (1 - p) * (1 / whole.docs1 + 1 / whole.docs0) + 1e-9)
    rows = counts.where("term <> ''").withColumns({"ratio": ratio, "z": z}).where((F.col("ratio") >= s.min_ratio) & (F.col("z") >= s.min_z))
    best = rows.orderBy(F.desc("z"), "term").limit(s.lexicon).select("term", "ratio").collect()
    return {r.term: 1 + sum(r.ratio >= t for t in s.tiers) for r in best}


class Flags(dict):
    """word -> one byte: bits 0-1 lexicon tier, 2 second person, 3 capitals, 4 obfuscated, 5 obfuscated lexicon hit."""

    def __init__(self, lexicon: dict[str, int]):
        self.lexicon = lexicon

    def tier(self, letters: str) -> int:
        return 3 if letters in INSULTS else max([self.lexicon.get(t, 0) for t in terms(letters)], default=0)

    def __missing__(self, word: str) -> bytes:
        letters = plain(word)
        tier, code = self.tier(letters), 0
        if OBFUSCATED.search(word):
            code |= 16
            if (hidden := self.tier(plain(word.lower().translate(LEET)))) > tier:
                tier, code = hidden, code | 32
        code |= tier | (letters in SECOND_PERSON) << 2 | (len(letters) > 1 and word.isupper()) << 3
        if len(self) >= 300_000:
            self.clear()
        if len(word) > 64:
            return bytes((code,))
        out = self[word] = bytes((code,))
        return out


def text_features(text: str | None, flags: Flags, near: int) -> list[float]:
    import numpy as np

    words = (text or "").split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    code = np.frombuffer(b"".join(map(flags.__getitem__, words)), dtype=np.uint8)
    c = np.bincount(code, minlength=64)
    by = np.arange(64)
    strong, medium, weak = (int(c[(by & 3) == k].sum()) for k in (3, 2, 1))
    you = int(c[(by & 4) > 0].sum())
    close = 0
    if you and strong + medium:
        at, own = np.flatnonzero((code & 3) >= 2), np.flatnonzero(code & 4)
        k = np.searchsorted(own, at)
        gap = np.minimum(np.abs(at - own[np.minimum(k, you - 1)]), np.abs(at - own[np.maximum(k - 1, 0)]))
        close = int((gap <= near).sum())
    per = 100.0 / n
    symbols = sum(text.count(m) for m in "#$%&*|<>@")
    return [
        math.log1p(n), strong * per, medium * per, weak * per, math.log1p(strong), math.log1p(medium), close * per, you * per,
        int(c[(by & 8) > 0].sum()) * per, text.count("!") * per, text.count("?") * per, symbols * per,
        int(c[(by & 16) > 0].sum()) * per, int(c[(by & 32) > 0].sum()) * per,
    ]


def dense_features(docs: DataFrame, lexicon: dict[str, int], near: int = 5) -> DataFrame:
    """doc_id, further columns as they are, and ``f``, the features of the whole text."""
    rest = [c for c in docs.columns if c != "text"]

    def run(batches):
        import pyarrow as pa

        flags = Flags(lexicon)
        for b in batches:
            f = [text_features(t, flags, near) for t in b.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(f, pa.list_(pa.float64()))], names=[*rest, "f"])

    rows = docs.select(*rest, "text")
    return rows.mapInArrow(run, ", ".join([*(f"{c} {k}" for c, k in rows.dtypes[:-1]), "f array<double>"]))


@dataclass
class Model:
    lexicon: dict[str, int] = field(default_factory=dict)
    trees: object = None
    calibration: object = None
    constant: float = 0.0


def fit(docs: DataFrame, labels: DataFrame, train, s: Settings = Settings()) -> Model:
    """Learn from at most ``s.sample`` labelled rows for which ``train`` (a condition on doc_id) holds."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import IsotonicRegression

    sample = stored(labelled_texts(docs, labels, "toxic", train, s.sample), "toxic-sample")
    with small_batches(docs.sparkSession):
        model = Model(lexicon=learn_lexicon(sample.where(F.col("u") < s.parts[0]), s))
    model.constant = sample.agg(F.avg("label")).first()[0] or 0.0
    rest = sample.where(F.col("u") >= s.parts[0]).select("doc_id", "label", "u", "text")
    with small_batches(docs.sparkSession):
        rows = stored(dense_features(rest, model.lexicon, s.near).coalesce(4), "toxic-features")
    rows = rows.select("doc_id", "u", F.col("label").cast("double").alias("label"), array_to_vector("f").alias("features"))
    grow, tune = rows.where(F.col("u") < s.parts[1]), rows.where(F.col("u") >= s.parts[1])
    if grow.agg(F.count_distinct("label")).first()[0] < 2 or tune.isEmpty():
        return model
    model.trees = GBTClassifier(maxIter=s.trees, maxDepth=s.depth, stepSize=0.2, seed=11, minInstancesPerNode=2).fit(grow)
    raw = _raw(model.trees.transform(tune)).select("label", "raw")
    model.calibration = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="calibrated").fit(raw)
    return model


def _raw(df: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return df.withColumn("raw", vector_to_array("probability")[1])


def score(docs: DataFrame, model: Model, s: Settings = Settings()) -> DataFrame:
    """doc_id, score, predicted for each row of ``docs``, from the whole texts."""
    from pyspark.ml.functions import array_to_vector

    rows = docs.select("doc_id", "text")
    if model.trees is None:
        out = rows.select("doc_id", F.lit(float(model.constant)).alias("score"))
    else:
        f = dense_features(rows, model.lexicon, s.near).select("doc_id", array_to_vector("f").alias("features"))
        scored = model.calibration.transform(_raw(model.trees.transform(f)))
        # The isotonic steps tie many documents; a thousandth of the trees' own probability keeps their order.
        out = scored.select("doc_id", (0.999 * F.col("calibrated") + 0.001 * F.col("raw")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, model: Model, s: Settings = Settings()) -> DataFrame:
    """The documents that the model does not reject, with all their columns; rows without a doc_id stay."""
    with small_batches(docs.sparkSession):
        rejected = stored(score(docs, model, s).where("predicted = 1 and doc_id is not null").select("doc_id").distinct(), "rejected")
    return docs.join(maybe_broadcast(rejected, rejected.count(), 24), "doc_id", "left_anti").select(*docs.columns)
