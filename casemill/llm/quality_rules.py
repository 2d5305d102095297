"""Quality rules: a threshold table compiled into Spark projections, without user functions.

Words are runs of anything but space and the bytes 9 to 13. Every measure is a native expression over
the words and lines of the row, so rows never leave the JVM and nothing is shuffled.

Defined results: a null text counts as empty (no words, all counts zero, ``base_failed``); an id may be
null or repeated, each row is judged on its own; an empty table gives an empty result; further columns
of any name are kept apart in a struct and cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

WORD = r"[^\x20\x09-\x0D]"
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
#: Frequent function words of English, German, French and Spanish, in lower case.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "was", "on", "are", "with", "as", "be", "at", "or", "from",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "ist", "nicht", "ein", "eine", "auf", "im",
    "le", "la", "les", "et", "des", "en", "un", "une", "du", "dans", "que", "est", "pour", "par",
    "el", "los", "las", "y", "de", "se", "del", "por", "con", "su", "al",
)


@dataclass(frozen=True)
class Rule:
    """Keep a document only while ``low <= value <= high``; ``value`` is SQL over the measures."""

    name: str
    value: str
    low: float | None = None
    high: float | None = None

    def passes(self) -> Column:
        value = F.expr(self.value)
        tests = [value >= F.lit(self.low)] if self.low is not None else []
        tests += [value <= F.lit(self.high)] if self.high is not None else []
        out = F.lit(True)
        for test in tests:
            out = out & test
        return F.coalesce(out, F.lit(False))


#: The base rules are fixed by the contract; products keep them in whole numbers.
BASE_RULES = (
    Rule("min_words", "n_words", low=50),
    Rule("repeated_words", "100 * n_repeat_words - 50 * n_words", high=0),
)
RULES = (
    Rule("word_length", "try_divide(word_chars, n_words)", low=2, high=14),
    Rule("symbols", "try_divide(n_symbols, n_words)", high=0.3),
    Rule("repeated_lines", "try_divide(n_dup_lines, n_lines)", high=0.4),
    Rule("stop_words", "try_divide(n_stop_words, n_words)", low=0.02),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words")
_POSITION_BITS = 28


def _positions_met_again(packed: Column) -> Column:
    """Of sorted (hash bits | position) numbers, those that share the hash bits with a neighbour."""
    same = lambda x, other: F.shiftright(x, _POSITION_BITS) == F.shiftright(other, _POSITION_BITS)
    return F.filter(
        packed,
        lambda x, i: F.coalesce(same(x, F.get(packed, i - 1)), F.lit(False))
        | F.coalesce(same(x, F.get(packed, i + 1)), F.lit(False)),
    )


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per input row: the whole row in ``doc`` and the counts of ``MEASURES`` (long).

    Windows of three words found twice are looked for by sorted hashes; the few windows whose hash is
    met again are then compared word by word, so a collision of hashes changes nothing.
    """
    position = F.lit((1 << _POSITION_BITS) - 1).cast("long")
    counts = ("n_symbols", "n_lines", "n_dup_lines")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    split = (
        whole.select("doc", F.coalesce(F.col(f"doc.`{text}`").cast("string"), F.lit("")).alias("t"))
        .select("*", F.filter(F.split("t", "\n", -1), lambda line: line.rlike(WORD)).alias("lines"))
        .select(
            "doc",
            F.array_remove(F.split("t", GAP, -1), "").alias("w"),
            F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            F.size("lines").cast("long").alias("n_lines"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        )
    )
    windows = split.select(
        "doc",
        "w",
        *counts,
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size(F.filter("w", lambda x: x.isin(list(STOP_WORDS)))).cast("long").alias("n_stop_words"),
        # An array of one element binds the word hashes to a name, so that they are made once.
        F.transform(
            F.array(F.transform("w", lambda x: F.xxhash64(x))),
            lambda h: F.slice(
                F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))),
                1,
                F.greatest(F.size(h) - 2, F.lit(0)),
            ),
        )[0].alias("g"),
    )
    has_twins = F.size(F.array_distinct("g")) < F.size("g")
    packed = windows.select("*", has_twins.alias("twins")).select(
        "doc",
        *counts,
        "n_words",
        "word_chars",
        "n_stop_words",
        F.when(F.col("twins"), F.col("w")).alias("w"),
        F.when(
            F.col("twins"),
            F.sort_array(F.transform("g", lambda x, i: F.shiftleft(x, _POSITION_BITS).bitwiseOR(i.cast("long")))),
        ).alias("packed"),
    )
    again = packed.select(
        "doc",
        *counts,
        "n_words",
        "word_chars",
        "n_stop_words",
        F.sort_array(
            F.transform(
                F.transform(_positions_met_again(F.col("packed")), lambda x: x.bitwiseAND(position).cast("int")),
                lambda p: F.struct(
                    F.get("w", p).alias("a"), F.get("w", p + 1).alias("b"), F.get("w", p + 2).alias("c"), p.alias("p")
                ),
            )
        ).alias("met"),
    )

    def equal(x: Column, other: Column) -> Column:
        return F.coalesce((x["a"] == other["a"]) & (x["b"] == other["b"]) & (x["c"] == other["c"]), F.lit(False))

    repeated = F.filter(
        "met", lambda x, i: equal(x, F.get("met", i - 1)) | equal(x, F.get("met", i + 1))
    )
    covered = F.array_distinct(F.flatten(F.transform(repeated, lambda x: F.sequence(x["p"], x["p"] + 2))))
    return again.select(
        "doc",
        *counts,
        "n_words",
        "word_chars",
        "n_stop_words",
        F.when(F.size("met") > 0, F.size(covered)).otherwise(0).cast("long").alias("n_repeat_words"),
    ).select("doc", *MEASURES)


def judged(
    docs: DataFrame, text: str = "text", base: Sequence[Rule] = BASE_RULES, rules: Sequence[Rule] = RULES
) -> DataFrame:
    """``measured`` with ``base_failed``, ``failed_rules`` (names, in order) and ``kept``."""
    failed = lambda table: [F.when(~r.passes(), F.lit(r.name)) for r in table]
    names = F.filter(F.array(*failed(base), *failed(rules)), lambda x: x.isNotNull())
    base_failed = F.lit(False)
    for rule in base:
        base_failed = base_failed | ~rule.passes()
    return measured(docs, text).select(
        "*", base_failed.alias("base_failed"), names.alias("failed_rules"), (F.size(names) == 0).alias("kept")
    )


def keep_good(docs: DataFrame, text: str = "text", **tables: Sequence[Rule]) -> DataFrame:
    """The rows that pass every rule, with their own columns.

    The row number keeps the filter above the projections: pushed below them it would repeat their
    expressions inside one another.
    """
    numbered = judged(docs, text, **tables).select("doc", "kept", F.monotonically_increasing_id().alias("row"))
    return numbered.where(F.col("kept") & (F.col("row") >= 0)).select("doc.*")
