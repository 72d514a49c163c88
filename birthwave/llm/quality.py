"""Quality rules: a threshold table compiled into one projection.

Every metric is a built-in expression over one row, so the operator neither
shuffles nor starts Python. Words are maximal runs without ASCII white space.

Defined results: a null or empty text has zero metrics and fails the base rule
(fewer than 20 words); each input row gives one output row, repeated rows too;
an input column named like an output is replaced; no rows give no rows.
Repeated windows are found by 64-bit hashes of their words within one text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carry, outputs, words

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"

# Function words of the four languages.
STOP_WORDS = (
    "the of and to in is that was for with as on are by at be this have from or "
    "der die das und ein eine zu den mit ist nicht von auf sich im des dem "
    "la le les de et un une est en que dans par pour pas du "
    "el los las y es del se por con para no una"
).split()


@dataclass(frozen=True)
class Rule:
    """A text of at least ``min_words`` words passes if ``low <= metric <= high``."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


# The threshold table. Ratios are per word or per line with a word.
RULES = (
    Rule("word_length", "mean_word_chars", 2.5, 15.0),
    Rule("symbols", "symbol_ratio", high=0.1),
    Rule("exclamations", "exclaim_ratio", high=0.5),
    Rule("stop_words", "stop_ratio", low=0.05),
    Rule("repeated_lines", "dup_line_ratio", high=0.4),
    Rule("bullets", "bullet_ratio", high=0.9),
    Rule("ellipses", "ellipsis_ratio", high=0.3),
    Rule("words_per_line", "line_words", low=1.5, min_words=50),
)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def compile_rules(rules: tuple[Rule, ...], metrics: dict[str, Column], n_words: Column) -> list[Column]:
    """One boolean column per row of the threshold table: true if the rule fails."""
    failed = []
    for r in rules:
        m, tests = metrics[r.metric], []
        if r.low is not None:
            tests.append(m < F.lit(r.low))
        if r.high is not None:
            tests.append(m > F.lit(r.high))
        bad = F.lit(False)
        for t in tests:
            bad = bad | t
        failed.append((bad & (n_words >= r.min_words)).alias(r.name))
    return failed


def repeat_words(hashes: str = "_hash", window: int = WINDOW) -> tuple[list[tuple[str, Column]], Column]:
    """Steps and result: words in windows of 8 that occur twice or more in the text.

    Hashes of 2, 4 and 8 words are made from halves; texts in which no 4 words
    repeat skip the last level.
    """
    n = F.size(hashes)

    def doubled(level: str, width: int) -> Column:
        return F.transform(level, lambda x, i: F.xxhash64(x, F.get(F.col(level), i + width)))

    none = F.array().cast("array<bigint>")
    four_repeats = (n >= window) & (F.size(F.array_distinct("_h4")) < n)
    windows = F.when(four_repeats, F.slice(doubled("_h4", 4), 1, n - window + 1)).otherwise(none)
    some = F.size(F.array_distinct("_win")) < F.size("_win")
    order = F.when(some, F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("p")))))
    near = lambda k: F.get(F.col("_sorted"), k)["h"]
    starts = F.sort_array(
        F.filter(
            F.transform("_sorted", lambda x, k: F.when((near(k - 1) == x["h"]) | (near(k + 1) == x["h"]), x["p"])),
            lambda p: p.isNotNull(),
        )
    )
    gaps = F.transform("_starts", lambda p, k: F.least(F.coalesce(F.get(F.col("_starts"), k + 1) - p, F.lit(window)), F.lit(window)))
    total = F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, g: a + g), F.lit(0)).cast("long")
    return [("_h2", doubled(hashes, 1)), ("_h4", doubled("_h2", 2)), ("_win", windows), ("_sorted", order), ("_starts", starts)], total


def score(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Input columns, base counts, metrics, ``base_failed``, ``failed_rules`` and ``kept``."""
    df = carry(docs, text).withColumnRenamed(f"_{text}", "_given")
    df = df.withColumn("_text", F.coalesce("_given", F.lit(""))).withColumn("_words", words(F.col("_text")))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumns({"_hash": F.transform("_words", lambda w: F.xxhash64(w)), "_lines": lines})
    steps, repeated = repeat_words()
    for name, value in steps:
        df = df.withColumn(name, value)
    n_lines = F.size("_lines")
    df = df.select(
        "_row",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (n_lines - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        n_lines.alias("_n_lines"),
        F.regexp_count("_text", F.lit("!")).alias("_exclaims"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))).alias("_stops"),
        F.size(F.filter("_lines", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))).alias("_bullets"),
        F.size(F.filter("_lines", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).alias("_dots"),
    )
    n = F.col("n_words")
    metrics = {
        "mean_word_chars": ratio(F.col("word_chars"), n),
        "symbol_ratio": ratio(F.col("n_symbols"), n),
        "exclaim_ratio": ratio(F.col("_exclaims"), n),
        "stop_ratio": ratio(F.col("_stops"), n),
        "dup_line_ratio": ratio(F.col("n_dup_lines"), F.col("_n_lines")),
        "bullet_ratio": ratio(F.col("_bullets"), F.col("_n_lines")),
        "ellipsis_ratio": ratio(F.col("_dots"), F.col("_n_lines")),
        "line_words": ratio(n, F.col("_n_lines")),
    }
    failed = compile_rules(rules, {k: F.col(f"_m.{k}") for k in metrics}, n)
    df = df.withColumn("_m", F.struct(*(v.alias(k) for k, v in metrics.items())))
    df = df.withColumn("base_failed", (n < 20) | (100 * F.col("n_repeat_words") > 30 * n))
    df = df.withColumn("failed_rules", F.array_compact(F.array(*(F.when(c, F.lit(r.name)) for r, c in zip(rules, failed)))))
    made = {c: F.col(c) for c in COUNTS} | {k: F.col(f"_m.{k}") for k in metrics}
    made |= {"base_failed": F.col("base_failed"), "failed_rules": F.col("failed_rules")}
    made["kept"] = ~F.col("base_failed") & (F.size("failed_rules") == 0)
    return df.select(*outputs(docs.columns, made))


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows that pass, with the input columns alone."""
    packed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_kept_row"), docs[text].alias("_text_judged"))
    # The number keeps the optimizer from copying all metrics into the filter.
    judged = score(packed, rules, "_text_judged").withColumn("_number", F.monotonically_increasing_id())
    return judged.filter(F.col("kept") & (F.col("_number") >= 0)).select("_kept_row.*")
