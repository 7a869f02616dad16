"""Quality rules: a threshold table compiled into one projection, without user functions.

Edge cases: a null or blank text has no words, all counts are 0 and it fails the base rule.
A very long text is one row, whose words are one array. A metric that equals a threshold passes.
Repeated rows are judged one by one. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, indices, let, words

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from he in is it of on or that the this to was with "
    "als auch auf das dem den der die ein eine für ich im in ist mit nicht sich und von zu "
    "à au avec ce dans de des du elle en est et il la le les par pas pour que qui se sur un une "
    "al con del el es la las lo los no para por se su una y"
).split()

SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """A document passes when low <= metric <= high (an open side is None)."""

    metric: str
    low: float | None
    high: float | None


#: Documents outside any range are rejected. The metrics are columns of ``measured``.
RULES = (
    Rule("n_words", 10, 200_000),
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbol_ratio", None, 0.35),
    Rule("stop_ratio", 0.03, None),
    Rule("dup_line_ratio", None, 0.5),
    Rule("repeat_word_ratio", None, 0.20),
)


def repeat_words(w: Column, width: int = 5) -> Column:
    """Words covered by windows of ``width`` words that occur at least twice in the text, the first included."""

    def covered(h: Column) -> Column:
        ranked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            twin = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
            return F.array_sort(F.transform(twin, lambda x: x["i"]))

        def total(p: Column) -> Column:
            step = F.transform(p, lambda x, i: F.coalesce(F.least(F.lit(width), F.get(p, i + 1) - x), F.lit(width)))
            return F.aggregate(step, F.lit(0), lambda a, x: a + x)

        return let(ranked, lambda s: let(positions(s), total))

    hashes = F.transform(indices(F.size(w) - (width - 1)), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and all metrics of the rules, from one projection over the texts."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(WS)) != "")
    stops = F.array(*[F.lit(w) for w in dict.fromkeys(STOP_WORDS)])
    m = let(
        words(F.col(text)),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.size(F.filter(w, lambda x: F.array_contains(stops, F.lower(x)))).cast("long").alias("n_stop"),
            repeat_words(w).cast("long").alias("n_repeat_words"),
        ),
    )
    rows = docs.select(
        "doc_id",
        m.alias("m"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("l"),
    )
    per = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return rows.select(
        "doc_id",
        "m.*",
        "n_symbols",
        F.col("l.dup").cast("long").alias("n_dup_lines"),
        per(F.col("m.word_chars"), F.col("m.n_words")).alias("mean_word_chars"),
        per(F.col("n_symbols"), F.col("m.n_words")).alias("symbol_ratio"),
        per(F.col("m.n_stop"), F.col("m.n_words")).alias("stop_ratio"),
        per(F.col("l.dup"), F.col("l.n")).alias("dup_line_ratio"),
        per(F.col("m.n_repeat_words"), F.col("m.n_words")).alias("repeat_word_ratio"),
    )


def compiled(rules=RULES) -> Column:
    """The threshold table as one boolean column."""
    ok = F.lit(True)
    for r in rules:
        ok = ok & (F.lit(True) if r.low is None else F.col(r.metric) >= r.low)
        ok = ok & (F.lit(True) if r.high is None else F.col(r.metric) <= r.high)
    return ok


def judge(docs: DataFrame, rules=RULES) -> DataFrame:
    """Per row of ``docs``: the metrics, base_failed and kept."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measured(docs).withColumn("base_failed", failed).withColumn("kept", ~failed & compiled(rules))
