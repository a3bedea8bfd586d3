"""Quality rules with thresholds that adapt to each language and source. DataFrame only.

Fixed base rules come first. What passes them is summed up, per language and source, in
quantile sketches of three measures, and each document is then held against the fences of its own
group: three times the distance of the quartiles beyond them. Up to a quarter of a group may be
bad without moving its fences. It is taken between the
outer edges of their buckets, so it is one bucket at least. A sketch is a table of counts by bucket (seven leading binary
digits of the value, so a bucket is within 1/64 of every value in it). Sketches merge by adding
counts, and so small groups lean on larger ones: each group's sketch has ``PRIOR`` documents' worth of its language's added, and
``PRIOR_ALL`` of that of all documents. They decide for a group of a few and fade as it grows; no size is a switch.

A rate of a short text says little: one symbol in fifty words is 20 in a thousand. So a count of k is held against a fence as what is sure of
it, two standard deviations of a Poisson count below: k - 2 sqrt(k).

Defined results: null, empty or blank text has zero words and fails the base rules; null
language or source is a group like any other; repeated rows are judged alike and all kept or all
dropped; an empty table gives an empty result; other columns are passed on by ``keep_good`` as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from codexlake.llm.shared import BROADCAST_ROWS, small, stored, words

#: Fixed values of the base rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "[#*$%&|<>]"
#: Documents' worth of its language's sketch, and of that of all documents, in each group's, in thousandths of a document.
PRIOR, PRIOR_ALL, WHOLE = 100, 10, 1000
#: A value is too far out beyond its quartile by more than so many times the quartiles' distance.
REACH = 3
#: Leading binary digits of a value that a sketch keeps.
DIGITS = 7
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _covered(windows: Column) -> Column:
    """Words within windows that occur more than once, from (hash, start) sorted by hash."""
    near = lambda k, x: F.coalesce(F.get(windows, k)["h"] == x["h"], F.lit(False))
    repeated = F.filter(windows, lambda x, k: near(k - 1, x) | near(k + 1, x))
    return F.sort_array(F.transform(repeated, lambda x: x["i"]))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with a struct ``_q`` of the base measures, all from the row itself: no shuffle.

    Three-word windows are compared by 64-bit hashes chained over the three words."""
    t = F.coalesce(F.col(text), F.lit(""))
    w, n = F.col("_w"), F.size("_w")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    at = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    window = lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))
    step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"))
    return (
        docs.withColumns({"_w": words(F.col(text)), "_l": lines})
        .withColumns({"_h": F.sort_array(F.transform(at, window))})
        .withColumn("_p", _covered(F.col("_h")))
        .withColumn(
            "_q",
            F.struct(
                n.cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                F.size("_l").cast("long").alias("n_lines"),
                (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
                F.aggregate("_p", F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), step)["n"].cast("long").alias("n_repeat_words"),
            ),
        )
        .drop("_w", "_l", "_h", "_p")
    )


def base_failed() -> Column:
    n, repeat = F.col("_q.n_words"), F.col("_q.n_repeat_words")
    return (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n)


def rates() -> dict[str, Column]:
    """The three measures as whole numbers: symbols per 1000 words, hundredths of a character per
    word, repeated lines per 1000 lines."""
    return {
        "symbol_rate": F.expr("1000 * _q.n_symbols div greatest(_q.n_words, 1)"),
        "word_length": F.expr("100 * _q.word_chars div greatest(_q.n_words, 1)"),
        "line_rate": F.expr("1000 * _q.n_dup_lines div greatest(_q.n_lines, 1)"),
    }


def sure_rates() -> dict[str, Column]:
    """What is held against the high fences: of counts only what is sure of them."""
    sure = lambda k: f"greatest({k} - 2 * sqrt({k}), 0)"
    return rates() | {
        "symbol_rate": F.expr(f"1000 * {sure('_q.n_symbols')} / greatest(_q.n_words, 1)"),
        "line_rate": F.expr(f"1000 * {sure('_q.n_dup_lines')} / greatest(_q.n_lines, 1)"),
    }


def width(value: Column) -> Column:
    """The width of the value's bucket."""
    shift = F.greatest(F.length(F.bin(value)) - DIGITS, F.lit(0))
    return F.call_function("shiftleft", F.lit(1).cast("long"), shift)


def bucket(value: Column) -> Column:
    """The value with all but its leading binary digits cleared."""
    return value - value % width(value)


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n) of all documents that pass the base rules."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), bucket(v).alias("bucket")) for k, v in rates().items()]))
    return measured.filter(~base_failed()).select("lang", "source", pairs.alias("m")).select("lang", "source", "m.*").groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))


def blended(sketch: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): each group's sketch with its share of the larger ones', in thousandths."""
    key = lambda *names: F.struct(*names).alias("_".join(["k", *names]))  # noqa: E731  structs with null fields are equal
    merged = lambda *names: sketch.groupBy(*names, "measure", "bucket").agg(F.sum("n").alias("n"))
    total = lambda *names: F.sum("n").over(Window.partitionBy(*names, "measure"))
    whole = merged().select("measure", "bucket", F.expr(f"{PRIOR_ALL * WHOLE} * n").alias("w"), total().alias("wa"))  # at most 64 buckets to each doubling of a value
    of_lang = merged("lang").withColumn("la", total("lang")).select(key("lang", "measure", "bucket"), F.expr(f"{PRIOR * WHOLE} * n div la").alias("l"))
    own = sketch.select(key("lang", "source", "measure", "bucket"), (F.col("n") * WHOLE).alias("o"))
    grid = sketch.select("lang", "source", "measure").distinct().join(F.broadcast(whole), "measure").select("*", key("lang", "measure", "bucket"), key("lang", "source", "measure", "bucket"))
    x = grid.join(of_lang, "k_lang_measure_bucket", "left").join(own, "k_lang_source_measure_bucket", "left")
    n = F.coalesce("o", F.lit(0)) + F.coalesce("l", F.lit(0)) + F.expr("w div wa")
    return x.select("lang", "source", "measure", "bucket", n.alias("n"))


def _quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, q1, q3) of sketches."""
    group = Window.partitionBy(*keys, "measure")
    ranked = sketch.withColumns({"below": F.sum("n").over(group.orderBy("bucket")), "all": F.sum("n").over(group)})
    q = lambda k: F.min(F.when(4 * F.col("below") >= k * F.col("all"), F.col("bucket")))
    return ranked.groupBy(*keys, "measure").agg(q(1).alias("q1"), q(3).alias("q3"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source, low and high fence of each measure), one row per language and source."""
    x = _quartiles(blended(stored(sketch, "sketches")), ["lang", "source"])
    reach = REACH * (F.col("q3") + width(F.col("q3")) - F.col("q1"))
    at = lambda k, v: F.max(F.when(F.col("measure") == k, v))
    return x.groupBy("lang", "source").agg(*[at(k, F.col("q3") + reach).alias(f"{k}_high") for k in rates()], at("word_length", F.col("q1") - reach).alias("word_length_low"))


def judged(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """The rows with ``_base`` (base rules failed) and ``_kept``; limits is a stored table of
    one row per language and source, broadcast only if it is counted to be small."""
    names = [c for c in limits.columns if c not in ("lang", "source")]
    limits = limits.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.struct(*names).alias("_t"))
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    fits = F.lit(True)
    for k, v in sure_rates().items():
        fits = fits & (v <= F.col(f"_t.{k}_high"))
    fits = fits & (rates()["word_length"] >= F.col("_t.word_length_low"))
    kept = ~F.col("_base") & F.coalesce(fits, F.lit(False))
    return measured.withColumn("_base", base_failed()).join(small(limits, BROADCAST_ROWS), same, "left").withColumn("_kept", kept).drop("_lang", "_source", "_t")


def quality_report(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per input row: id, base measures, base_failed, kept."""
    measured = stored(measure(docs.select(F.col(key).alias("doc_id"), "text", "lang", "source")).drop("text"), "measures")
    out = judged(measured, stored(thresholds(sketches(measured)), "thresholds"))
    return out.select("doc_id", *[F.col(f"_q.{m}").alias(m) for m in MEASURES], F.col("_base").alias("base_failed"), F.col("_kept").alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The input's rows that are kept, columns unchanged. Rows travel as one struct, so that no
    name in them can clash; they are stored once and not shuffled."""
    measured = stored(measure(docs.select(F.struct("*").alias("row")), "row.text"), "measured")
    measured = measured.select("row", "_q", F.col("row.lang").alias("lang"), F.col("row.source").alias("source"))
    return judged(measured, stored(thresholds(sketches(measured)), "thresholds")).filter("_kept").select("row.*")
