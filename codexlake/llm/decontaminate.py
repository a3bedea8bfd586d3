"""Benchmark decontamination by SimHash windows. DataFrame only.

A document holds an item if a window of as many words as the item has, is at least 0.8
similar to it: shingles of five lower-cased words, weighted by how often they occur, least
weights over greatest. In turn:

1. Places. A window that is similar to an item shares a shingle with it, and moving it on to
   its first shared shingle loses none. So the windows that start at a shingle of any item (or
   end with the text, if it is too short from there) are all that is needed. Shingles meet the
   items' in a broadcast join, row by row and without a shuffle; more shingles than may be
   broadcast are met in blocks, one after the other. A window that is similar to an item has 8/9 of its shingles
   in common with it; so windows with fewer shingles of any items of their length go, which is exact.
2. Windows are cut out of the few documents that have such places.
3. Fingerprints. Each window and item gets a 128-bit SimHash of its shingles.
4. Index. Of two fingerprints within ``RADIUS`` = 34 bits, one of the first five of eight segments of 16
   bits is within three, or one of the last three within four: else they'd differ in 5 x 4 + 3 x 5 = 35. Items
   enumerate the ball of radius 2 around each segment, windows one of radius 1 or 2, and they meet
   where balls do; pairs beyond the radius go.
   At similarity 0.8 fingerprints differ in 19.4 bits on average, with a deviation of 4.1; the radius
   is 3.6 deviations further out. Of random pairs one in ten meets and one in 10^8 is within the radius.
5. Verification. The weighted similarity itself decides.

Defined results: null, empty or blank texts and items hold nothing; with fewer than five words
the whole sequence is the one shingle, so an item of up to four words is held only by a text that
consists of it (a window of so few words would be met by chance); repeated rows count once; an empty
table gives an empty result; other columns are passed on by ``clean_documents`` as they are; null
ids are ids; texts and items may have any length.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexlake.llm.shared import small, stored, text_key, words
from codexlake.operators.joins import split_join

SHINGLE = 5
#: Similarity of 4/5 as whole numbers.
SIMILAR = (4, 5)
RADIUS = 34
#: Radius of the balls around each of a fingerprint's segments of 16 bits, on both sides.
ITEM_BALLS, WINDOW_BALLS = (2,) * 8, (1,) * 5 + (2,) * 3
#: Shingles of a text that go on as one row.
PART = 512
#: Shingles of items that are broadcast at once, 24 bytes each.
BROADCAST_SHINGLES = 1_000_000
#: Entries of the items' index that may be broadcast, 40 bytes each.
BROADCAST_ENTRIES = 1_000_000
#: Counters of 16 bits share a long; one bit is needed for comparing, one for the sign.
MOST_SHINGLES = (1 << 14) - 1


def shingles(tokens: Column) -> Column:
    """64-bit hashes, chained over the words, of all runs of five words."""
    n = F.size(tokens)
    one = lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(SHINGLE)])
    whole = F.when(n > 0, F.array(F.xxhash64(*[F.get(tokens, F.lit(k)) for k in range(SHINGLE)]))).otherwise(F.array().cast("array<bigint>"))
    return F.when(n >= SHINGLE, F.transform(F.sequence(F.lit(0), n - SHINGLE), one)).otherwise(whole)


def _adder(k: int, lanes: Column) -> Callable[[Column, Column], Column]:
    return lambda a, h: a + F.shiftright(h, k).bitwiseAND(lanes)


def simhash(hashes: Column) -> Column:
    """64-bit majority of an array of hashes. Bits k, k + 16, k + 32 and k + 48 are counted at
    once, in four counters within one long, if those can count so far."""
    lanes = F.lit(0x0001000100010001)
    past = F.floor(F.size(hashes) / 2) + 1
    few = F.lit(0).cast("long")
    counts = [F.aggregate(hashes, F.lit(0).cast("long"), _adder(k, lanes)) for k in range(16)]
    for k, count in enumerate(counts):
        over = F.shiftright(count + lanes * (F.lit(1 << 14) - past), 14).bitwiseAND(lanes)
        few = few.bitwiseOR(F.shiftleft(over, k))
    many = F.lit(0).cast("long")
    for k in range(64):
        ones = F.aggregate(hashes, F.lit(0).cast("long"), _adder(k, F.lit(1)))
        many = many.bitwiseOR(F.when(2 * ones > F.size(hashes), F.shiftleft(F.lit(1).cast("long"), k)).otherwise(F.lit(0)))
    out = F.when(F.size(hashes) <= MOST_SHINGLES, few).otherwise(many)
    return F.coalesce(out, F.lit(0).cast("long"))  # never null, so no filter on it is put below a join


def prints(hashes: Column) -> Column:
    """A 128-bit SimHash: that of the shingles, and that of their hashes hashed again."""
    return F.array(simhash(hashes), simhash(F.transform(hashes, lambda h: F.xxhash64(h))))


def ball(radius: int) -> Column:
    """All masks of 16 bits with at most so many bits set."""
    return F.array(*[F.lit(sum(1 << b for b in bits)) for r in range(radius + 1) for bits in combinations(range(16), r)])


def segments(prints_: Column, radii: tuple[int, ...]) -> Column:
    """Keys (segment and a value in the ball around its own) of a fingerprint."""
    part = lambda i: F.shiftrightunsigned(F.get(prints_, F.lit(i // 4)), 16 * (i % 4)).bitwiseAND(F.lit(0xFFFF)).cast("int")
    return F.flatten(F.array(*[F.transform(ball(r), _around(i, part(i))) for i, r in enumerate(radii)]))


def _around(segment: int, value: Column) -> Callable[[Column], Column]:
    return lambda m: value.bitwiseXOR(m).bitwiseOR(F.lit(segment << 16))


def distance(a: Column, b: Column) -> Column:
    return sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in (0, 1)), F.lit(0))


def shared_weight(a: Column, b: Column) -> Column:
    """Sum over all shingles of the lesser number of times that they occur."""
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    times = lambda x, y: F.size(F.filter(x, lambda z: z == y))
    counted = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, x: s + F.least(times(a, x), times(b, x)))
    return F.when(plain, F.size(F.array_intersect(a, b))).otherwise(counted)


def item_table(items: DataFrame) -> DataFrame:
    """(item_id, n_words, item_shingles, item_print), stored; items without words are left out."""
    x = items.select("item_id", words(F.lower("text")).alias("w")).withColumns({"n_words": F.size("w"), "item_shingles": shingles(F.col("w"))})
    return stored(x.filter("n_words > 0").drop("w").withColumn("item_print", prints(F.col("item_shingles"))), "items")


def places(text: DataFrame, items: DataFrame) -> DataFrame:
    """(name, n_words, start), stored: of (name, all), where windows as long as an item start at a
    shingle of such an item and have enough of their shingles. Nothing but one shingle at a time is joined."""
    first = stored(items.select("n_words", F.explode("item_shingles").alias("shingle")).distinct(), "item-shingles")
    blocks = max(1, -(-first.count() // BROADCAST_SHINGLES))
    one = text.select("name", F.size("all").alias("total"), F.posexplode_outer("all").alias("i", "shingle"))
    block = F.pmod(F.xxhash64("shingle"), F.lit(blocks))
    met = [one.join(F.broadcast(first.filter(block == k)), "shingle").select("name", "n_words", "total", "i") for k in range(blocks)]
    met = met[0] if blocks == 1 else reduce(DataFrame.union, [stored(x, "places") for x in met])
    # as many positions as the text has words at most; equal rows have the same
    met = met.groupBy("name", "n_words").agg(F.first("total").alias("total"), F.array_sort(F.collect_set("i")).alias("at"))
    return stored(met.select("name", "n_words", F.explode(_starts()).alias("start")), "places")


def _starts() -> Column:
    """Of the places ``at`` of shingles that items of this length have, those where a window may start: it is no more
    similar to an item than the share of its shingles that are such. Sorted places make that one look ahead."""
    a, b = SIMILAR
    n = F.greatest(F.lit(1), F.col("n_words") - (SHINGLE - 1))
    least = lambda size: F.ceil(a * (size + n) / (a + b)).cast("int")
    last = F.greatest(F.lit(0), F.col("total") - n)  # windows do not go beyond the text
    inside = F.filter("at", lambda i, k: (i <= last) & (F.get("at", k + least(n) - 1) < i + n))
    behind = F.filter("at", lambda i: i >= last)
    ends = (F.element_at("at", -1) > last) & (F.size(behind) >= least(F.least(n, F.col("total"))))
    # a text shorter than the item is one window
    inside = F.when(F.col("total") >= n, inside).otherwise(F.array().cast("array<int>"))
    ends = ends | ((F.col("total") < n) & (F.size("at") >= least(F.col("total"))))
    return F.array_distinct(F.concat(inside, F.when(ends, F.array(last)).otherwise(F.array().cast("array<int>"))))


def windows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(name, n_words, start, window) of documents named by a struct of id and text hash."""
    name = F.struct("doc_id", text_key(F.col("text")).alias("hash")).alias("name")
    # words and shingles are columns of their own: within an expression they'd be made for each place
    text = docs.select(name, words(F.lower("text")).alias("w"))
    at = places(text.select("name", shingles(F.col("w")).alias("all")), items)
    reach = at.groupBy("name").agg(F.greatest(F.lit(1), F.max("n_words") - (SHINGLE - 1)).alias("reach"))
    # a long text goes on in parts, each with a margin as long as its own longest window
    base = lambda p: F.greatest(F.lit(0), p - F.col("reach"))
    part = lambda p: F.struct((p / PART).cast("int").alias("part"), base(p).alias("base"), F.slice("all", base(p) + 1, PART + 2 * F.col("reach")).alias("shingles"))
    some = text.join(small(stored(reach, "reaches")), "name").select("name", "reach", shingles(F.col("w")).alias("all"))
    parts = F.transform(F.sequence(F.lit(0), F.size("all") - 1, F.lit(PART)), part)
    parts = some.select("name", F.explode_outer(parts).alias("p")).select("name", "p.*")
    at = at.withColumn("part", (F.col("start") / PART).cast("int"))
    n = F.greatest(F.lit(1), F.col("n_words") - (SHINGLE - 1))
    met = parts.join(small(at), ["name", "part"])
    return met.select("name", "n_words", "start", F.slice("shingles", F.col("start") - F.col("base") + 1, n).alias("window"))


def candidates(found: DataFrame, items: DataFrame) -> DataFrame:
    """(name, start, item_id): windows (name, n_words, start, print) and items of their length whose
    fingerprints are within the radius."""
    table = items.select("item_id", "n_words", "item_print", F.explode(segments(F.col("item_print"), ITEM_BALLS)).alias("key"))
    table = stored(table, "item-index")
    met = found.withColumn("key", F.explode(segments(F.col("print"), WINDOW_BALLS))).join(small(table, BROADCAST_ENTRIES), ["n_words", "key"])
    met = met.filter(distance(F.col("print"), F.col("item_print")) <= RADIUS)
    return met.select("name", "n_words", "start", "item_id").distinct()


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, hash, item_id, start, similarity): for each document and item that it holds,
    the most similar window, by its first word."""
    items = item_table(items)
    found = stored(windows(docs, items).withColumn("print", prints(F.col("window"))), "windows")
    met = stored(candidates(found.drop("window"), items), "candidates")
    # an item may be in very many documents
    met = split_join(met, items.select("item_id", "item_shingles"), "item_id", "name")
    met = found.drop("print").join(met, ["name", "n_words", "start"])
    size = F.size("window") + F.size("item_shingles")
    met = met.withColumn("shared", shared_weight(F.col("window"), F.col("item_shingles")))
    a, b = SIMILAR
    met = met.filter(F.col("shared") * (a + b) >= a * size)
    best = F.max(F.struct((F.col("shared") / (size - F.col("shared"))).alias("similarity"), (-F.col("start")).alias("back")))
    out = met.groupBy("name", "item_id").agg(best.alias("best"))
    return out.select("name.doc_id", "name.hash", "item_id", (-F.col("best.back")).cast("long").alias("start"), F.col("best.similarity").alias("similarity"))


def contamination_report(docs: DataFrame, items: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id, item_id, start, similarity of every document and item that it holds."""
    return contaminated(docs.select(F.col(key).alias("doc_id"), "text"), items).drop("hash")


def clean_documents(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The input's rows that hold no item, columns unchanged."""
    bad = contaminated(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), items)
    bad = stored(bad.select(F.struct(F.col("doc_id").alias("id"), "hash").alias("key")).distinct(), "contaminated")
    rows = docs.select(F.struct("*").alias("row"), F.struct(F.col(key).alias("id"), text_key(F.col(text)).alias("hash")).alias("key"))
    return rows.join(bad, "key", "left_anti").select("row.*")
