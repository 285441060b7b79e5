"""Line deduplication by winnowing, in DataFrame operations only.

From each line that is not blank starts a window: the fewest lines that make
``min_run`` lines or hold ``min_words`` words. Of each ``span`` neighbouring windows
the one of least hash becomes a fingerprint, and so does every window with
``min_words`` words. Equal runs thus have fingerprints at the same places if they
are ``min_run + span - 1`` lines long or hold ``min_words`` words in up to
``min_run`` lines. Each fingerprint is joined with its first place; the match
is extended over the lines of both texts, up and down, and the run so found in the
later place is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, WS_CLASS, released, staged, unused

MIN_RUN = 3  # lines
MIN_WORDS = 50  # a passage's worth
SPAN = 2  # neighbouring windows of which one becomes a fingerprint


def _blank_trimmed(x):
    return F.btrim(x, F.lit(WS))


def fingerprints(docs: DataFrame, min_run: int = MIN_RUN, min_words: int | None = MIN_WORDS, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, lines, prints): for each text its lines
    that are not blank, as (line number, hash), and its fingerprints, as (place
    among these lines, hash). ``row_key`` is the hash of id and text."""
    lines = F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n", -1)
    src = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("row_key"), lines.alias("all_lines"))
    words = (lambda t: F.size(F.split(t, f"{WS_CLASS}+"))) if min_words else (lambda t: F.lit(0))
    trimmed = F.filter(F.transform("all_lines", lambda x, i: F.struct(i.alias("i"), _blank_trimmed(x).alias("t"))), lambda s: s["t"] != "")
    full = F.transform(trimmed, lambda s: F.struct(s["i"].alias("i"), s["t"].alias("t"), words(s["t"]).alias("n")))
    src = src.select("doc_id", "row_key", full.alias("full"))  # a filter here would be pushed below, with copies of what it names
    at = lambda p, j: F.get(F.col("full"), p + j)

    def window(p):
        """Of the fewest lines from place ``p`` on that make one; null if there are too few."""
        out = F.lit(None)
        for k in range(min_run, 0, -1):
            n = sum((at(p, j)["n"] for j in range(k)), F.lit(0))
            rich = n >= min_words if min_words else F.lit(False)
            text = F.concat_ws("\n", *[at(p, j)["t"] for j in range(k)])
            made = F.struct(F.md5(text).alias("print"), (-p).alias("back"), F.coalesce(rich, F.lit(False)).alias("rich"))
            out = F.when((p + k <= F.size("full")) & (rich if k < min_run else F.lit(True)), made).otherwise(out)
        return out

    windows = F.filter(F.transform(F.sequence(F.lit(0), F.size("full") - 1), window), lambda w: w.isNotNull())
    src = src.withColumn("windows", windows)
    groups = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("windows") - span))
    least = F.transform(groups, lambda j: F.array_min(F.slice("windows", j + 1, F.lit(span))))
    chosen = F.filter(F.array_distinct(F.concat(least, F.filter("windows", lambda w: w["rich"]))), lambda w: w.isNotNull())
    prints = F.transform(chosen, lambda w: F.struct((-w["back"]).alias("p"), w["print"].alias("print")))
    held = F.transform("full", lambda s: F.struct(s["i"].alias("i"), F.xxhash64(s["t"]).alias("h")))
    return src.select("doc_id", "row_key", held.alias("lines"), prints.alias("prints"))


def repeated_runs(docs: DataFrame, min_run: int = MIN_RUN, min_words: int | None = MIN_WORDS, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, runs): for each text with repeated runs the (first,
    last) line numbers of the runs that go. A fingerprint's first place is
    the least by (id, place); null ids come last."""
    marks = staged(fingerprints(docs, min_run, min_words, span, id_col, text_col), "lines")
    prints = marks.select("doc_id", "row_key", F.explode("prints").alias("x")).select("doc_id", "row_key", "x.print", "x.p")
    prints = prints.withColumn("spot", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key", "p")).select("print", "spot")
    first = staged(prints.groupBy("print").agg(F.min("spot").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("print", "first"), "lines")
    # joined as it was written, so that adaptive execution can split a fingerprint that very many texts have
    later = prints.join(first.hint("merge"), "print").where(F.col("spot") > F.col("first"))
    pair = {"doc_id": F.col("spot.doc_id"), "row_key": F.col("spot.row_key"), "first_id": F.col("first.doc_id"), "first_key": F.col("first.row_key"), "down": F.col("spot.p") - F.col("first.p")}
    met = later.select(*[c.alias(n) for n, c in pair.items()], F.col("spot.p").alias("p"))
    met = met.groupBy(*pair).agg(F.sort_array(F.collect_set("p")).alias("places"))
    texts = marks.select("doc_id", "row_key", "lines").dropDuplicates(["doc_id", "row_key"])  # a row repeated under one id counts once
    met = met.join(texts.hint("merge"), met["doc_id"].eqNullSafe(texts["doc_id"]) & (met["row_key"] == texts["row_key"])).select(met["doc_id"], met["row_key"], "first_id", "first_key", "down", "places", "lines")
    other = texts.select(F.col("doc_id").alias("o_id"), F.col("row_key").alias("o_key"), F.col("lines").alias("o_lines"))
    met = met.join(other.hint("merge"), F.col("first_id").eqNullSafe(F.col("o_id")) & (F.col("first_key") == F.col("o_key")))
    # places where the two differ, the ends of the texts included
    inside = F.sequence(F.greatest(F.lit(0), F.col("down")), F.least(F.size("lines"), F.size("o_lines") + F.col("down")) - 1)
    differ = F.filter(inside, lambda i: F.get("lines", i)["h"] != F.get("o_lines", i - F.col("down"))["h"])
    bounds = F.concat(F.array(F.greatest(F.lit(0), F.col("down")) - 1), differ, F.array(F.least(F.size("lines"), F.size("o_lines") + F.col("down"))))
    met = met.withColumn("bounds", bounds)
    edge = lambda i: F.get("lines", i)["i"]
    run = lambda p: F.struct(edge(F.array_max(F.filter("bounds", lambda b: b < p)) + 1).alias("a"), edge(F.array_min(F.filter("bounds", lambda b: b > p)) - 1).alias("b"))
    runs = met.select("doc_id", "row_key", F.array_distinct(F.transform("places", run)).alias("runs"))
    out = staged(runs.groupBy("doc_id", "row_key").agg(F.array_distinct(F.flatten(F.collect_list("runs"))).alias("runs")), "lines")
    released(marks)
    released(first)
    return out


def dedup_lines(docs: DataFrame, min_run: int = MIN_RUN, min_words: int | None = MIN_WORDS, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text", removed_col: str | None = None) -> DataFrame:
    """``docs`` with repeated runs of lines cut out of the text; all rows stay.

    A run goes if it holds a fingerprint that also stands in an earlier place,
    by (id, line), and all its lines equal those around that place; null ids come last.
    No run is shorter than ``min_run`` lines unless it holds ``min_words`` words (null:
    lines alone count). Lines compare without
    surrounding white space; lines without a character besides white space
    are no part of runs and stay. Texts without such runs, null ones included, are
    unchanged; a text may become empty. Rows that repeat id and text count as
    one document and share its fate. An empty table gives an empty result.
    ``removed_col`` names a column for the number
    of removed lines; other columns are kept as they are."""
    key, rid, rkey, runs, lines, keep = (unused(docs, x) for x in ("row_key", "found_id", "found_key", "runs", "all_lines", "keep"))
    found = repeated_runs(docs, min_run, min_words, span, id_col, text_col).select(F.col("doc_id").alias(rid), F.col("row_key").alias(rkey), F.col("runs").alias(runs))
    d = docs.withColumn(key, F.xxhash64(id_col, text_col))
    # a merge join at every size: what is found grows with the texts, so work stays in proportion
    d = d.join(found.hint("merge"), (d[key] == found[rkey]) & d[id_col].eqNullSafe(found[rid]), "left")
    d = d.withColumn(lines, F.when(F.col(runs).isNotNull(), F.split(F.col(text_col).cast("string"), "\n", -1)))
    stays = lambda x, i: (_blank_trimmed(x) == "") | ~F.exists(runs, lambda r: (r["a"] <= i) & (i <= r["b"]))
    d = d.withColumn(keep, F.filter(lines, stays))
    out = {text_col: F.when(F.col(runs).isNotNull(), F.array_join(keep, "\n")).otherwise(F.col(text_col))}
    if removed_col:
        out[removed_col] = F.when(F.col(runs).isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(keep)).cast("long")
    return d.withColumns(out).drop(key, rid, rkey, runs, lines, keep)
