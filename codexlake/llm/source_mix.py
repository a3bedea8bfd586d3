"""Mixing sources to target weights along a time-varying curriculum.

Every source has a share of the mix and a schedule: its relative weight over training time
t in [0, 1], a straight line from ``start`` to ``end``. Its integral up to t, brought to 1 at
t = 1, says which part of the source's target has been used by then. A source's documents lie in a
fixed pseudo-random order, end to end, again and again; a copy that starts at a demand of c words
gets as training position the t at which the schedule has used c of the target. Copies are
sorted by range of position.

Each source takes copies up to the one whose middle passes the target, so what is taken is within
half a document of it. A running sum over a hot source is made in two steps: over
the buckets of the hash order, then within a bucket, so no task holds a source.

Defined results: null text has size 0; size 0 takes 0 words; a null source is a source,
last in order; repeated rows are documents of their own, at neighbouring places; an empty table
gives an empty result; other columns are passed on by ``mixed_documents`` as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from codexlake.llm.shared import small, stored, text_key

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Buckets of the hash order within a source; a task sums one of them at a time.
ORDER_BUCKETS = 4096
#: (start, end) weight of a source's schedule, by its place in the order of sources: the first
#: fades out, the second stays, the third grows; repeating, as the weights do.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, hash, source, size, place): what the mix needs to know of each row. ``hash`` tells
    rows with equal ids apart; ``place`` is the row's place in the pseudo-random order."""
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    h = text_key(F.col(text))
    return docs.select(F.col(key).alias("doc_id"), h.alias("hash"), F.col(source).alias("source"), size.alias("size"), F.xxhash64(F.col(key), h).alias("place"))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, rank, source_size, target): one row per source.

    Sharing an excess again and again ends where every source has the lesser of its cap and weight
    x level. Going through the sources in order of cap / weight, the level is found at the
    first source that its own cap does not stop."""
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") - 1) % len(weights) + 1)
    x = by_source.withColumn("rank", F.row_number().over(order)).withColumns({"w": w, "cap": (epochs * F.col("source_size")).cast("double")})
    full = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    nought = lambda c: F.coalesce(c, F.lit(0.0))
    x = x.withColumns({"total": F.sum("source_size").over(whole).cast("double"), "w_left": F.sum("w").over(whole) - nought(F.sum("w").over(before)), "spent": nought(F.sum("cap").over(before))})
    level = (F.col("total") - F.col("spent")) / F.col("w_left")
    fits = F.when(F.col("w") * level <= F.col("cap"), F.struct((F.col("cap") / F.col("w")).alias("at"), "rank", level.alias("level")))
    x = x.withColumn("level", F.min(fits).over(whole)["level"])
    return x.select("source", "rank", "source_size", F.least(F.col("cap"), F.col("w") * F.col("level")).alias("target"))


def _laid(rows: DataFrame, buckets: int) -> DataFrame:
    """The rows with ``before``: words before each within its source, in order of place."""
    slot = F.struct("source", F.pmod(F.shiftrightunsigned("place", 40), F.lit(buckets)).alias("bucket"))  # structs with null fields are equal
    rows = rows.withColumn("slot", slot)
    sums = rows.groupBy("slot").agg(F.sum("size").alias("n"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.sum("n").over(earlier(Window.partitionBy("slot.source").orderBy("slot.bucket")))
    sums = sums.select("slot", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    inside = F.sum("size").over(earlier(Window.partitionBy("slot").orderBy("place", "doc_id", "hash")))
    rows = rows.withColumn("inside", F.coalesce(inside, F.lit(0)))
    return rows.join(sums, "slot").withColumn("before", F.col("ahead") + F.col("inside")).drop("slot", "ahead", "inside")


def position(part: Column, start: Column, end: Column) -> Column:
    """The t at which a line from start to end, integrated from 0, has used ``part`` of its
    whole: the root of  a t^2 / 2 + start t = part (start + end) / 2  with a = end - start."""
    a = end - start
    need = part * (start + end)  # twice the area
    return F.when(a == 0, part).otherwise((F.sqrt(start * start + a * need) - start) / a)


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS, schedules: tuple = SCHEDULES, buckets: int = ORDER_BUCKETS) -> DataFrame:
    """The sized rows with source_size, target, copies, taken and positions (one per copy)."""
    t = small(stored(targets(rows, weights, epochs), "targets")).withColumnRenamed("source", "_t")
    x = _laid(rows, buckets).join(t, F.col("source").eqNullSafe(F.col("_t"))).drop("_t")
    middle = F.col("before") + F.col("size") / 2
    n = F.floor((F.col("target") - middle) / F.col("source_size")) + 1  # epochs whose copy's middle is short of the target
    x = x.withColumn("copies", F.when(F.col("size") == 0, 0).otherwise(F.greatest(F.lit(0), F.least(n, F.lit(epochs)))).cast("int"))
    line = F.element_at(F.array(*[F.array(F.lit(float(a)), F.lit(float(b))) for a, b in schedules]), (F.col("rank") - 1) % len(schedules) + 1)
    start, end = F.get(line, F.lit(0)), F.get(line, F.lit(1))
    at = lambda k: position(F.least(F.lit(1.0), (F.col("before") + k * F.col("source_size")) / F.col("target")), start, end)
    places = F.array(*[F.when(F.col("copies") > k, at(F.lit(k))) for k in range(epochs)])
    return x.withColumns({"taken": F.col("copies") * F.col("size"), "positions": F.filter(places, lambda p: p.isNotNull())})


def mix_report(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per input row, sorted by range of its first position (rows not taken: last)."""
    out = plan(stored(sized(docs, key), "sizes"))
    out = out.select("doc_id", "size", "source_size", "target", "taken", "copies", F.get("positions", F.lit(0)).alias("position"))
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The input's rows, columns unchanged, once for each copy that the mix takes, sorted by
    range of training position."""
    name = lambda i, h, s: F.struct(i.alias("id"), h.alias("hash"), s.alias("source"))  # noqa: E731  null fields are equal
    chosen = plan(stored(sized(docs, key, text), "sizes")).filter("copies > 0")
    chosen = chosen.groupBy(name(F.col("doc_id"), F.col("hash"), F.col("source")).alias("key")).agg(F.flatten(F.collect_list("positions")).alias("positions"))
    rows = docs.select(F.struct("*").alias("row"), name(F.col(key), text_key(F.col(text)), F.col("source")).alias("key"))
    # repeated rows are one text: the copies of all of them come from one
    met = rows.join(chosen, "key").dropDuplicates(["key"])
    return met.select("row", F.explode("positions").alias("position")).sort("position").select("row.*")
