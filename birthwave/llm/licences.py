"""License scan: ordered signature rules behind a keyword gate.

Base phrases are looked for in every text. The rules of ``licence_rules`` are
tried only where a text holds their keyword: the words of a text are met once
with the set of keywords. Every match is an interval of the words joined by one
space. A match inside another of the same or a higher priority is suppressed:
sorted by start, longest first, one fold keeps the farthest end per priority.

One projection of built-in expressions over a row: no shuffle, no Python.

Defined results: a null or empty text has no words, places or labels and score
0; each input row gives one output row; an input column named like an output is
replaced; the score is the highest priority among the matches over 100, and at
least 0.5 with a base phrase.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carry, outputs
from .licence_rules import BASE, LEVELS, Signature, signatures

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MATCH = "struct<start:int,stop:int,priority:int,rule:int,label:string>"


def joined_words(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD, " "))


def phrase_places(phrase: tuple[str, ...]) -> Column:
    """Word positions at which the phrase starts; the words are split only in texts that hold it."""
    here = lambda i: reduce(lambda a, b: a & b, (F.get(F.col("_words"), i + k) == w for k, w in enumerate(phrase)))
    return F.filter(F.sequence(F.lit(0), F.greatest(F.size("_words") - 1, F.lit(0))), here)


def tried(rules: list[Signature]) -> Column:
    """Per rule whose keyword the text holds and whose pattern it matches: lengths of the gaps and of the matches."""
    table = F.array(*(
        F.struct(
            F.lit(r.keyword).alias("keyword"), F.lit(rf"\b(?:{r.pattern})\b").alias("pattern"),
            F.lit(r.priority).alias("priority"), F.lit(i).alias("rule"), F.lit(r.label).alias("label"),
        )
        for i, r in enumerate(rules)
    ))
    gated = F.filter(table, lambda r: F.array_contains("_keywords", r["keyword"]) & F.regexp_like(F.col("_shown"), r["pattern"]))
    return F.transform(
        gated,
        lambda r: F.struct(
            F.transform(F.split(F.col("_shown"), r["pattern"], -1), lambda x: F.length(x)).alias("gaps"),
            F.transform(F.regexp_extract_all(F.col("_shown"), r["pattern"], F.lit(0)), lambda x: F.length(x)).alias("lengths"),
            r["priority"].alias("priority"), r["rule"].alias("rule"), r["label"].alias("label"),
        ),
    )


def intervals(hits: str) -> Column:
    """All matches as intervals, in the order of the suppression: start, longest, highest priority, rule."""

    def of_rule(h: Column) -> Column:
        def step(acc: Column, k: Column) -> Column:
            start = acc["at"] + F.get(h["gaps"], k)
            stop = start + F.get(h["lengths"], k)
            # Sorted fields first; stop and priority descend.
            made = F.struct(
                start.alias("start"), (-stop).alias("back"), (-h["priority"]).alias("rank"), h["rule"].alias("rule"), h["label"].alias("label")
            )
            return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(made)).alias("out"))

        empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,back:int,rank:int,rule:int,label:string>>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(h["lengths"]) - 1), empty, step)["out"]

    return F.sort_array(F.flatten(F.transform(hits, of_rule)))


def unsuppressed(ordered: str) -> Column:
    """One fold over the ordered matches; ``ends`` has the farthest end so far of each priority or a higher one."""

    def step(acc: Column, m: Column) -> Column:
        stop, priority = -m["back"], -m["rank"]
        level = reduce(lambda a, b: a + b, ((priority >= p).cast("int") for p in LEVELS))
        inside = F.element_at(acc["ends"], level) >= stop
        ends = F.transform(acc["ends"], lambda e, k: F.when(k < level, F.greatest(e, stop)).otherwise(e))
        made = F.struct(m["start"].alias("start"), stop.alias("stop"), priority.alias("priority"), m["label"].alias("label"))
        return F.struct(ends.alias("ends"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], F.array(made))).alias("out"))

    empty = F.array().cast("array<struct<start:int,stop:int,priority:int,label:string>>")
    start = F.struct(F.array(*(F.lit(-1) for _ in LEVELS)).alias("ends"), empty.alias("out"))
    return F.aggregate(ordered, start, step)["out"]


def scan(docs: DataFrame, rules: list[Signature] | None = None, text: str = "text") -> DataFrame:
    """Input columns, word and place counts, labels, ``detections`` (character intervals of the joined words) and ``score``."""
    rules = signatures() if rules is None else rules
    keywords = F.array(*(F.lit(k) for k in sorted({r.keyword for r in rules})))
    df = carry(docs, text).select("_row", joined_words(F.col(f"_{text}")).alias("_joined"))
    df = df.withColumn("_n", F.when(F.col("_joined") == "", 0).otherwise(F.regexp_count("_joined", F.lit(" ")) + 1))
    padded = F.concat(F.lit(" "), F.col("_joined"), F.lit(" "))
    has = [padded.contains(f" {' '.join(p)} ") for _, p in BASE]
    df = df.withColumn("_keywords", F.array_intersect(keywords, F.split("_joined", " ")))
    df = df.withColumn("_words", F.when(reduce(lambda a, b: a | b, has), F.split("_joined", " ")))
    none = F.array().cast("array<int>")
    df = df.withColumns({f"_p{i}": F.when(h, phrase_places(p)).otherwise(none) for i, (h, (_, p)) in enumerate(zip(has, BASE))})
    df = df.withColumn("_places", F.flatten(F.array(*(F.col(f"_p{i}") for i in range(len(BASE))))))
    df = df.withColumn("_shown", F.regexp_replace("_joined", r"[^\x00-\x7F]", "_"))
    df = df.withColumn("_hits", F.when(F.size("_keywords") > 0, tried(rules)))
    df = df.withColumn("_ordered", F.when(F.size("_hits") > 0, intervals("_hits")))
    df = df.withColumn("_found", F.when(F.size("_ordered") > 0, unsuppressed("_ordered")))
    df = df.withColumn("detections", F.coalesce("_found", F.array().cast("array<struct<start:int,stop:int,priority:int,label:string>>")))
    base = F.array_compact(F.array(*(F.when(F.size(f"_p{i}") > 0, F.lit(label)) for i, (label, _) in enumerate(BASE))))
    labels = F.array_sort(F.array_union(base, F.transform("detections", lambda d: d["label"])))
    best = F.coalesce(F.array_max(F.transform("detections", lambda d: d["priority"])), F.lit(0)) / F.lit(float(LEVELS[-1]))
    made = {
        "n_words": F.col("_n").cast("long"),
        "n_base": F.size("_places").cast("long"),
        "first_word": F.array_min("_places").cast("long"),
        "last_word": F.array_max("_places").cast("long"),
        "base_labels": F.array_join(F.array_sort(base), ","),
        "labels": F.array_join(labels, ","),
        "detections": F.col("detections"),
        "score": F.greatest(best, F.when(F.size("_places") > 0, F.lit(0.5)).otherwise(F.lit(0.0))),
    }
    return df.select(*outputs(docs.columns, made))
