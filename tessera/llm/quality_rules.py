"""Quality rules as one projection: a threshold table over length, symbol,
stop-word and line measures, compiled to built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, WS_CLASS, unused

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a and are as at be by for from has have in is it not of on or that the this to was were which with "
    "auf aus das dem den der des die ein eine für im ist mit nicht sich und von zu "
    "au aux avec dans de des du elle en est et la le les par pas pour que qui sur un une "
    "al como con del el en es la las los no para por que se su un una y"
).split()


@dataclass(frozen=True)
class Rule:
    """``measure / per`` must lie in [low, high]; a null bound is open."""

    name: str
    measure: str
    per: str | None = None
    low: float | None = None
    high: float | None = None

    def holds(self) -> Column:
        x = F.col(self.measure).cast("double")
        if self.per:  # nothing to divide by: the ratio counts as 0
            x = F.when(F.col(self.per) > 0, x / F.col(self.per)).otherwise(F.lit(0.0))
        ok = F.lit(True)
        if self.low is not None:
            ok = ok & (x >= self.low)
        if self.high is not None:
            ok = ok & (x <= self.high)
        return ok


RULES = (
    Rule("words", "n_words", low=10),
    Rule("word_length", "word_chars", "n_words", low=2.0, high=15.0),
    Rule("symbols", "n_symbols", "n_words", high=0.1),
    Rule("stop_words", "n_stop_words", "n_words", low=0.02),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=0.5),
)


def measures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_stop_words and n_lines (lines with a word), all long.

    Replaces columns of these names. A null text has no words and all
    measures 0. Five-word windows are compared by their 64-bit hash within one
    text. Runs row by row: no shuffle, and the work for a text of n words is
    O(n log n) whatever repeats in it."""
    text, words, lines, hashes, pairs, starts = (unused(df, f"__{x}") for x in ("text", "words", "lines", "hashes", "pairs", "starts"))
    stop = [F.lit(w) for w in STOP_WORDS]
    d = df.withColumn(text, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    d = d.withColumn(words, F.filter(F.split(F.col(text), f"{WS_CLASS}+"), lambda w: w != ""))
    d = d.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.translate(F.col(text), WS, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(F.col(text), "#*$%&|<>", ""))).cast("long"),
            "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(*stop))).cast("long"),
            lines: F.filter(F.split(F.col(text), "\n"), lambda x: F.length(F.translate(x, WS, "")) > 0),
            hashes: F.when(F.size(words) >= 6, F.transform(F.sequence(F.lit(0), F.size(words) - 5), lambda i: F.xxhash64(*[F.get(F.col(words), i + j) for j in range(5)]))),
        }
    )
    d = d.withColumns({"n_lines": F.size(lines).cast("long"), "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")})
    # only texts with a repeated window sort their (hash, position) pairs
    repeated = F.size(F.array_distinct(hashes)) < F.size(hashes)
    d = d.withColumn(pairs, F.when(repeated, F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    c = F.col(pairs)
    twice = F.filter(c, lambda x, i: (F.get(c, i - 1)["h"] == x["h"]) | F.coalesce(F.get(c, i + 1)["h"] == x["h"], F.lit(False)))
    d = d.withColumn(starts, F.sort_array(F.transform(twice, lambda x: x["i"])))
    # words under overlapping windows count once: each adds its distance to the next, at most 5
    s = F.col(starts)
    covered = F.aggregate(F.transform(s, lambda x, i: F.least(F.lit(5), F.coalesce(F.get(s, i + 1) - x, F.lit(5)))), F.lit(0), lambda a, x: a + x)
    return d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop(text, words, lines, hashes, pairs, starts)


def judge(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with the measures, base_failed (under 10 words, or over a fifth
    of the words in repeated five-word windows) and kept (base passed and all
    ``rules`` hold). Null and empty texts fail the base. Rows are judged one
    by one, so ties, repeated rows and empty tables need no special case."""
    d = measures(df, text_col)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    ok = F.lit(True)
    for r in rules:
        ok = ok & r.holds()
    return d.withColumn("base_failed", base).withColumn("kept", ~base & ok)
