"""Adaptive quality rules, native DataFrame operations only.

Base counts come from array functions on each whole text. Thresholds are not fixed: for every language and
source the distribution of five rates is held in a mergeable quantile sketch (counts of values in
log-spaced buckets, so relative error is bounded, merging is addition, and the result does not depend on
order). Quartiles are read above the mass at zero, as most rates are zero in most documents. A group's
upper fence is Q75 + 3 * (Q75 - Q25) in buckets, hence relative to what is usual there; the spread is at least the
language's, so that a group full of copies does not shut out the rest. Fences of small groups lean on the
language's by weight: ``LEAN`` rows of the language are added to each group. The fences are joined back, and a document
with any rate beyond its group's fence is rejected.

Defined results: a null or empty text has zero counts, fails the base rule (fewer than 50 words) and is not
kept. Null lang or source form groups of their own. Repeated rows count as often as they occur; a rate that is zero in
a whole language has no fence. An empty table gives an empty result. Extra columns, whatever their names, are ignored by
``quality_report`` and carried unchanged by ``keep_by_rules``. A text of any length is counted whole.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, carried, restored

#: The base rule; spreads above Q75 that a fence stands at; rows of its language that a group's fence leans on.
MIN_WORDS, REPEAT_PERCENT, FENCE, LEAN = 50, 50, 3, 100
RATES = ("symbol_rate", "punctuation_rate", "dup_line_rate", "repeat_rate", "word_length")
#: Log-spaced buckets: value v falls in bucket round(ln(1 + 1000 v) / ln(GROWTH)).
GROWTH = 1.01
PUNCTUATION = string.punctuation

SPACE = r"[\x20\x09-\x0D]+"


def word_array(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def _let(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once, though ``use`` may look at it many times."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column) -> Column:
    """Words inside some 3-word window that occurs twice or more, first occurrences included."""

    def covered(places: Column) -> Column:
        # places: sorted starts of repeated windows; each covers 3 words, less what the next one covers too
        n = F.size(places)
        gaps = F.transform(places, lambda p, i: F.when(i + 1 < n, F.least(F.lit(3), F.get(places, i + 1) - p)).otherwise(F.lit(3)))
        return F.aggregate(gaps, F.lit(0), lambda acc, g: acc + g)

    def places(ranked: Column) -> Column:
        def again(x: Column, i: Column) -> Column:
            before = F.coalesce(F.get(ranked, i - 1)["h"] == x["h"], F.lit(False))
            after = F.coalesce(F.get(ranked, i + 1)["h"] == x["h"], F.lit(False))
            return before | after

        return F.sort_array(F.transform(F.filter(ranked, again), lambda x: x["i"]))

    def of_hashes(hashes: Column) -> Column:
        tagged = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(F.sort_array(tagged), lambda s: _let(places(s), covered)))

    def of_words(w: Column) -> Column:
        hashes = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 4, F.lit(0)).otherwise(_let(hashes, of_hashes))

    return _let(words, of_words)


def counts(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_punctuation, n_dup_lines, n_repeat_words, n_lines."""
    text = F.coalesce(text, F.lit(""))
    without = lambda signs: (F.length(text) - F.length(F.translate(text, signs, ""))).cast("long")

    def of_words(w: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            without("#*$%&|<>").alias("n_symbols"),
            without(PUNCTUATION).alias("n_punctuation"),
            _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
        )

    return _let(word_array(text), of_words)


def base_failed(rule: Column) -> Column:
    """Of a struct of ``counts``."""
    n = rule["n_words"]
    return (n < MIN_WORDS) | (100 * rule["n_repeat_words"] > REPEAT_PERCENT * n)


def rates(rule: Column) -> dict[str, Column]:
    n = F.greatest(rule["n_words"], F.lit(1))
    return {
        "symbol_rate": rule["n_symbols"] / n,
        "punctuation_rate": rule["n_punctuation"] / n,
        "dup_line_rate": rule["n_dup_lines"] / F.greatest(rule["n_lines"], F.lit(1)),
        "repeat_rate": rule["n_repeat_words"] / n,
        "word_length": rule["word_chars"] / n,
    }


def beyond(rule: Column, fence: Column) -> Column:
    """Whether any rate lies beyond its fence; a missing fence stops nothing."""
    out = F.lit(False)
    for k, v in rates(rule).items():
        out = out | F.coalesce(_bucket(v) > fence[k], F.lit(False))
    return out


def _bucket(value: Column) -> Column:
    return F.round(F.log1p(value * 1000) / F.log(F.lit(GROWTH))).cast("int")


def group_sketches(counted: DataFrame) -> DataFrame:
    """Counts per lang, source, rate and bucket of values above zero, over rows that pass the base rule; adding two merges them."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("rate"), _bucket(v).alias("bucket")) for k, v in rates(F.col("rule")).items())))
    found = counted.where(~base_failed(F.col("rule"))).select("lang", "source", each.alias("e")).where(F.col("e.bucket") > 0)
    return found.groupBy("lang", "source", "e.rate", "e.bucket").agg(F.count(F.lit(1)).alias("n"))


def _quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Per group and rate: total, q75 and the spread, in buckets."""
    by = Window.partitionBy(*keys, "rate")
    run = sketch.withColumn("upto", F.sum("n").over(by.orderBy("bucket"))).withColumn("total", F.sum("n").over(by))
    at = lambda quarters: F.min(F.when(4 * F.col("upto") >= quarters * F.col("total"), F.col("bucket")))
    return run.groupBy(*keys, "rate").agg(F.max("total").alias("total"), at(3).alias("q75"), (at(3) - at(1)).alias("spread"))


def thresholds(sketches: DataFrame) -> DataFrame:
    """lang, source and per rate its fence there in buckets; null where the language has no value above zero."""
    own = _quartiles(sketches, ["lang", "source"])
    wide = _quartiles(sketches.groupBy("lang", "rate", "bucket").agg(F.sum("n").alias("n")), ["lang"])
    wide = wide.select(F.col("lang").alias("l"), F.col("rate").alias("r"), F.col("spread").alias("usual"), (F.col("q75") + FENCE * F.col("spread")).alias("beyond"))
    # A source without a value above zero has the language's fence.
    sources = sketches.select("lang", "source").distinct().join(wide, F.col("lang").eqNullSafe(F.col("l"))).select("l", F.col("source").alias("s"), "r", "usual", "beyond")
    both = sources.join(own, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("rate") == F.col("r")), "left")
    mine = F.col("q75") + FENCE * F.greatest("spread", "usual")
    fence = F.when(F.col("rate").isNull(), F.col("beyond").cast("double")).otherwise((F.col("total") * mine + LEAN * F.col("beyond")) / (F.col("total") + LEAN))
    return both.groupBy(F.col("l").alias("lang"), F.col("s").alias("source")).agg(*(F.max(F.when(F.col("r") == k, fence)).alias(k) for k in RATES))


def fenced(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """``rows`` (with lang and source) and ``fence``; the join is by group, null keys included.

    The group table is small unless there are very many sources; Spark broadcasts it only below its checked
    size limit and otherwise shuffles, splitting hot groups at run time.
    """
    fences = limits.select(F.col("lang").alias("l"), F.col("source").alias("s"), F.struct(*RATES).alias("fence"))
    return rows.join(fences, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")


def quality_report(spark, docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and kept. The counts are computed once and written without text."""
    counted = Workspace(spark, "quality-rules").write(docs.select("doc_id", "lang", "source", counts(F.col("text")).alias("rule")), "counts")
    failed, outside = base_failed(F.col("rule")), beyond(F.col("rule"), F.col("fence"))
    judged = fenced(counted, thresholds(group_sketches(counted))).withColumn("base_failed", failed).withColumn("kept", ~failed & ~outside)
    return judged.select("doc_id", *(F.col(f"rule.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "base_failed", "kept")


def keep_by_rules(spark, docs: DataFrame) -> DataFrame:
    """The rows that pass, with the input's columns. The first pass writes counts only and leaves the fences, a row for each language and source;
    the second one counts again and filters, so no text is written."""
    work = Workspace(spark, "quality-rules")
    counted = work.write(docs.select("lang", "source", counts(F.col("text")).alias("rule")), "counts")
    limits = work.write(thresholds(group_sketches(counted)), "fences")
    work.keep_only("fences")
    rows = carried(docs).select("row", F.col("row.lang").alias("lang"), F.col("row.source").alias("source"))
    stays = _let(counts(F.col("row.text")), lambda rule: ~base_failed(rule) & ~beyond(rule, F.col("fence")))
    return restored(fenced(rows, limits).where(stays))
