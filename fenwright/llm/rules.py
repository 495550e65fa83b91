"""Quality rules: a threshold table compiled into one projection.

Each rule names a measure and the range that passes. The measures are columns
of the built-in functions (regular expressions, split, higher-order functions),
so no user function runs and nothing is shuffled.

Defined cases: null text has no words and fails; empty texts give zeros and
null ratios, and a null ratio passes; repeated rows are judged each;
columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

# Common function words of the four languages.
STOP_WORDS = (
    "the of and to in is that for it with as was on be by this are from or an a "
    "der die das und in zu den von mit ist auf für im dem nicht ein eine als auch es "
    "le la les de des et un une du en que qui dans pour par sur pas au est "
    "el los las y en que del se por con para una su al lo como más"
).split()

# Words in windows of REPEAT_WINDOW words that occur twice.
REPEAT_WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= measure <= high; a missing bound or a null measure passes."""

    measure: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("n_words", low=5),
    Rule("mean_word_length", low=1.5, high=40),
    Rule("symbol_ratio", high=0.1),
    Rule("upper_ratio", high=0.6),
    Rule("exclaim_ratio", high=0.3),
    Rule("dup_line_ratio", high=0.5),
    Rule("repeat_word_ratio", high=0.3),
    Rule("stop_ratio", low=0.06),
)


def _nonempty(a: Column) -> Column:
    return F.filter(a, lambda x: x != "")


def _repeat_words(w: Column, n: int) -> Column:
    """Words that lie in a window of n words found at two places or more.

    Windows are compared by 64-bit hash. A document without a repeat is settled
    by a distinct count; only the others sort their (hash, place) pairs.
    """
    def once(x: Column, f) -> Column:
        """f of x, with x evaluated a single time: a lambda's variable holds it."""
        return F.get(F.transform(F.array(x), f), 0)

    def windows_of(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(h) - n + 1), lambda i: F.xxhash64(F.slice(h, i, F.lit(n))))

    pairs = lambda x: F.array_sort(F.transform(x, lambda y, i: F.struct(y.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        near = lambda x, j: ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | (F.get(s, j + 1)["h"] == x["h"])
        return F.array_sort(F.transform(F.filter(s, lambda x, j: F.coalesce(near(x, j), F.lit(False))), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, j: F.when(j == 0, n).otherwise(F.least(F.lit(n), x - F.get(p, j - 1))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    several = lambda x: F.size(F.array_distinct(x)) < F.size(x)
    windows = once(F.transform(w, lambda x: F.xxhash64(x)), windows_of)
    count = once(windows, lambda x: F.when(several(x), once(pairs(x), lambda s: once(places(s), covered))).otherwise(0))
    return F.when(F.size(w) > n, count).otherwise(0)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of every whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(
        F.col("doc_id"),
        _nonempty(F.split(text, SPACE)).alias("w"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace(text, "[^A-Za-z]+", "")).cast("long").alias("n_letters"),
        F.length(F.regexp_replace(text, "[^!]+", "")).cast("long").alias("n_exclaim"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    return base.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        "n_upper",
        "n_letters",
        "n_exclaim",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("w"), REPEAT_WINDOW).cast("long").alias("n_repeat_words"),
        F.size(F.filter(F.col("w"), lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop"),
    )


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b))


RATIOS = {
    "mean_word_length": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "word_chars"),
    "upper_ratio": ("n_upper", "n_letters"),
    "exclaim_ratio": ("n_exclaim", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "repeat_word_ratio": ("n_repeat_words", "n_words"),
    "stop_ratio": ("n_stop", "n_words"),
}


def compile_rules(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Whether all rules pass, and the names of those that fail."""
    fails = []
    for r in rules:
        value = _ratio(*RATIOS[r.measure]) if r.measure in RATIOS else F.col(r.measure)
        out = F.lit(False)
        if r.low is not None:
            out = out | F.coalesce(value < r.low, F.lit(False))
        if r.high is not None:
            out = out | F.coalesce(value > r.high, F.lit(False))
        fails.append(F.when(out, F.lit(r.measure)))
    failed = F.array_compact(F.array(*fails)) if fails else F.array().cast("array<string>")
    return F.size(failed) == 0, failed


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: measures, base_failed, kept, failed rules."""
    m = measures(docs)
    passes, failed = compile_rules(rules)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return m.select("*", base.alias("base_failed"), failed.alias("failed_rules"), passes.alias("_p")).select(
        *[c for c in m.columns], "base_failed", (~F.col("base_failed") & F.col("_p")).alias("kept"), "failed_rules"
    )
