"""Near-duplicate groups: SimHash fingerprints met by multi-index hashing, and exact similarity: five-word
shingles, Jaccard at least 0.8.

Multi-index hashing finds texts whose fingerprints differ in two bits at most; what it finds is verified on
all shingles, in one go with the first pairs of common keys, and the groups of both are those that the other exact
steps begin with: texts of one group are not held against each other again. Fingerprints of pairs at 0.8 differ in up to 20 of 64 bits, where an index has
keys of three bits and each lookup meets an eighth of all rows. So the links that fingerprints cannot show are found
by shingles, which misses none. Equal texts are one node, named by their hash, and only one of them goes on.

0. Fingerprints of the shingles. Each text is held against the first one of its fingerprint, and the first ones
   of fingerprints within two bits (``simhash_dedup.links``) against each other.
1. Prefixes. Shingles are put in one order. Texts that are 0.8 similar share a shingle within the
   first fifth (and one more) of both. Any order is right; shingles that start more than a fourth of ``FEW``
   texts are put last, so that what many texts share, a passage or words that often meet, hardly starts any.
2. Keys. Nearly all have one text. Packed short forms, four bytes a key, tell which may have two or three
   (``Shorts``), and only their rows are passed on. One aggregate of them counts each key's texts and names the
   least and the greatest: most keys that are left have two, and so a pair.
3. Keys of up to ``FEW`` texts: all with all. The texts of a common key, with more, are first held against one
   of them, then those outside the key's largest group against two of it, which takes a large group of
   near-copies together with a few checks a text; then those still outside meet all that are not of
   their group, by keys of the shorter prefix (a ninth) that the smaller of two texts needs.
4. Pairs with too few shared keys, or whose parities say that too many shingles differ, go; both
   are exact bounds. The others are verified on all shingles. A text of many pairs is joined in as
   many copies as its pairs need. Groups are what verified links reach.

Shingles are made by numpy inside tasks; all else is joins and aggregates. Defined results: texts
without words are one group; with fewer than five words the whole sequence is the one shingle; equal
texts are one group; words are lower-cased; null ids are ids; an empty table gives an empty result;
other columns are passed on as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexlake.llm.shared import BROADCAST_ROWS, scratch, small, stored, text_key
from codexlake.llm.simhash_dedup import CHUNK, components, links

#: Similarity of 4/5 as whole numbers.
SIMILAR = (4, 5)
SHINGLE = 5
#: Texts that meet under one key all with all.
FEW = 32
#: Keys put last in the order, of those that more than a fourth of ``FEW`` texts start with; they change the work, never the
#: result. With more texts more keys are met by chance.
LAST = 500_000
#: Pairs of one text that one copy of its shingles is joined to.
PAIRS_A_COPY = 500
#: Classes of shingles whose number in a text is kept as odd or even.
PARITIES = 512
#: Texts whose parities may be broadcast: a row is nine longs and an array, and the driver holds it several times.
BROADCAST_PARITIES = BROADCAST_ROWS // 16
#: Texts whose shingles are made at once.
BATCH = 256
#: Keys of a task that are held before they are packed.
HELD = 1 << 21
#: Classes of keys of which the driver and each worker hold a bit or two; with fewer, more keys of one text are passed on.
MOST_CLASSES = 1 << 27
#: Rows of ``Shorts.packed``.
PACKED = "part int, numbers binary, counts binary"
#: Odd multipliers that tell the places of words in a shingle apart, and mix the sum.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct 64-bit shingle hashes in order; of a text without words just 0."""
    tokens = text.lower().encode().split() if text else []  # bytes.split knows ASCII white space only
    if not tokens:
        return np.zeros(1, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    k = min(SHINGLE, len(h))
    total = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        total += (h[i : i + len(total)] ^ (h[i : i + len(total)] >> np.uint64(29))) * PLACES[i]
    total ^= total >> np.uint64(32)
    total *= PLACES[0]
    total ^= total >> np.uint64(29)
    return np.unique(total.view(np.int64))


def parity(s: np.ndarray) -> np.ndarray:
    """For each of ``PARITIES`` classes of shingles, whether the set has an odd number of them, as bits
    of longs. Two sets' parities differ in no more bits than there are shingles that only one has."""
    odd = np.bincount(s & (PARITIES - 1), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def fingerprint(s: np.ndarray) -> int:
    """SimHash of a shingle set: a bit is 1 if set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(s), CHUNK):
        ones += np.unpackbits(s[a : a + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(s), bitorder="little").view("<i8")[0])


def _lists(rows: DataFrame, keep, prints: bool = False) -> DataFrame:
    """(node, n, parity, s) of rows (node, text): the size and parity of each text's shingle set, and
    what ``keep`` gives of it; with ``prints`` also its fingerprint."""
    schema = "node long, n int, parity array<long>, s array<long>" + prints * ", fingerprint long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                part = batch.slice(a, BATCH)
                sets = [shingle_set(t) for t in part.column("text").to_pylist()]
                kept = [keep(s) for s in sets]
                lists = lambda x: pa.ListArray.from_arrays(np.cumsum([0, *map(len, x)], dtype=np.int32), np.concatenate(x))
                columns = [part.column("node"), pa.array([len(s) for s in sets], pa.int32()), lists([parity(s) for s in sets]), lists(kept)]
                if prints:
                    columns.append(pa.array([fingerprint(s) for s in sets], pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, ["node", "n", "parity", "s", "fingerprint"][: len(columns)])

    return rows.select("node", "text").mapInArrow(run, schema)


def _least_shared(n):
    """Shingles that a text of n shares with any that is similar."""
    a, b = SIMILAR
    return (a * n + (b - 1)) // b


def _first(s: np.ndarray, late: np.ndarray, mask: int) -> np.ndarray:
    """The prefix of a text's shingles, those whose short form is in ``late`` behind all others."""
    if len(late):
        short = s & mask
        behind = late[np.minimum(np.searchsorted(late, short), len(late) - 1)] == short
        s = np.concatenate([s[~behind], s[behind]])
    return s[: len(s) - _least_shared(len(s)) + 1]


class Shorts:
    """Short forms of keys, which tell keys of one text from others with few bytes: the low bits of a
    key are its part, the 32 bits above them a number in it. Different keys seldom have the same."""

    def __init__(self, parts: int):
        self.bits = max(3, (parts - 1).bit_length())
        self.mask = (1 << (self.bits + 32)) - 1

    def packed(self, keys: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """(part, numbers, counts): each part's distinct numbers and how often each is there, as bytes."""
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            s = np.concatenate(held) & self.mask
            u, k = np.unique((s & ((1 << self.bits) - 1)) << 32 | s >> self.bits, return_counts=True)
            part, at = np.unique(u >> 32, return_index=True)
            cut = lambda x: pa.array([y.tobytes() for y in np.split(x, at[1:])], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), cut(u.astype(np.uint32)), cut(k.astype(np.uint32))], ["part", "numbers", "counts"])

        n = 0
        for x in keys:
            held.append(x)
            n += len(x)
            if n >= HELD:
                yield out()
                held.clear()
                n = 0
        if n:
            yield out()

    @staticmethod
    def counted(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
        """A part, its numbers and the texts of each."""
        u, k = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint32) for c in ("numbers", "counts"))
        u, at = np.unique(u, return_inverse=True)
        return table.column("part")[0].as_py(), u.astype(np.int64), np.bincount(at, k, len(u)).astype(np.int64)

    def often(self, packed: DataFrame, more: int) -> DataFrame:
        """(short, k) of the short forms of more than ``more`` texts."""

        def run(table: pa.Table) -> pa.Table:
            part, u, k = self.counted(table)
            return pa.table({"short": u[k > more] << self.bits | part, "k": k[k > more]})

        return packed.groupBy("part").applyInArrow(run, "short long, k long")

    def maps(self, packed: DataFrame, width: int) -> DataFrame:
        """(part, two, three) for each part: which of ``width`` classes of its numbers have one of two texts, of three."""

        def run(table: pa.Table) -> pa.Table:
            part, u, k = self.counted(table)
            marks = []
            for least in (2, 3):
                has = np.zeros(width, np.uint8)
                has[u[k >= least] & (width - 1)] = 1
                marks.append(pa.array([np.packbits(has, bitorder="little").tobytes()], pa.binary()))
            return pa.Table.from_arrays([pa.array([part], pa.int32()), *marks], ["part", "two", "three"])

        return packed.groupBy("part").applyInArrow(run, "part int, two binary, three binary")


def often_shared(rows: DataFrame, few: int, shorts: Shorts) -> np.ndarray:
    """Short forms of the keys that start many texts, up to ``LAST`` of the most frequent ones, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = (t for batch in batches for a in range(0, batch.num_rows, BATCH) for t in batch.slice(a, BATCH).column("text").to_pylist())
        yield from shorts.packed(_first(shingle_set(t), np.zeros(0, np.int64), shorts.mask) for t in texts)

    packed = rows.select("text").mapInArrow(run, PACKED)
    often = stored(shorts.often(packed, few // 4), "frequent-keys")
    if often.count() > LAST:
        often = often.orderBy(F.desc("k"), "short").limit(LAST)
    return np.sort(often.select("short").toArrow().column("short").to_numpy())


def shared_keys(lists: DataFrame, shorts: Shorts) -> DataFrame:
    """(node, n, short, key, many) of stored lists: the keys that more than one text has, and a few others; ``many`` if
    more than two may have it. Of two similar texts the smaller one has a key of both among its ``short`` ones, as both
    need 8/9 of their mean size in common. Keys of one text are nearly all, so they are told by their short forms and not
    passed on."""
    spark = lists.sparkSession

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from shorts.packed(batch.column("s").flatten().to_numpy() for batch in batches)

    parts = 1 << shorts.bits
    classes = min(MOST_CLASSES, max(1 << 16, 1 << (64 * lists.count()).bit_length()))
    width = max(8, classes // parts)
    marks = {name: np.zeros((parts, width // 8), np.uint8) for name in ("two", "three")}
    for r in shorts.maps(lists.select("s").mapInArrow(pack, PACKED), width).toArrow().to_pylist():
        for name, have in marks.items():
            have[r["part"]] = np.frombuffer(r[name], np.uint8)
    given = spark.sparkContext.broadcast([marks["two"].ravel(), marks["three"].ravel()])
    bits, (a, b) = shorts.bits, SIMILAR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two, three = given.value
        for batch in batches:
            s, long = batch.column("s").flatten().to_numpy(), batch.column("s").value_lengths().to_numpy()
            where = (s & (parts - 1)) * width + ((s >> bits) & (width - 1))
            keep = np.flatnonzero(two[where >> 3] >> (where & 7) & 1)
            row = np.repeat(np.arange(len(long)), long)[keep]
            n = batch.column("n").to_numpy()[row].astype(np.int64)
            short = keep - (np.cumsum(long) - long)[row] <= n - (2 * a * n + (a + b - 1)) // (a + b)
            many = three[where[keep] >> 3] >> (where[keep] & 7) & 1 == 1
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("node").to_numpy()[row]), pa.array(n.astype(np.int32)), pa.array(short), pa.array(s[keep]), pa.array(many)], ["node", "n", "short", "key", "many"])

    return lists.select("node", "n", "s").mapInArrow(run, "node long, n int, short boolean, key long, many boolean")


def _fit(m: Column, n: Column) -> Column:
    """Sizes that similar sets can have."""
    a, b = SIMILAR
    return (m * b >= n * a) & (n * b >= m * a)


def _with_set(pairs: DataFrame, sets: DataFrame, side: str) -> DataFrame:
    """The pairs with the shingle set of one side's text. A text of many pairs has its set in
    several copies, each for a part of them, so that no task gets all."""
    hot = pairs.groupBy(F.col(side).alias("node")).agg(F.ceil(F.count("*") / PAIRS_A_COPY).cast("int").alias("n")).filter("n > 1")
    hot = small(stored(hot, "hot-texts"))
    n = F.coalesce("n", F.lit(1))
    have = sets.join(hot, "node", "left").select(F.col("node").alias(side), F.explode(F.sequence(F.lit(0), n - 1)).alias("copy"), F.col("s").alias(f"s{side}"))
    asked = pairs.join(hot.withColumnRenamed("node", side), side, "left").withColumn("copy", F.pmod(F.xxhash64("u", "v"), n).cast("int")).drop("n")
    return asked.join(have, [side, "copy"]).drop("copy")


def _close(x: str, y: str, both: Column) -> Column:
    """Parities of sets of so many shingles together do not say that too many differ."""
    a, b = SIMILAR
    differ = sum((F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(PARITIES // 64)), F.lit(0))
    return differ * (a + b) <= (b - a) * both


def fitting(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """(u, v), stored: of pairs (u, v, shared keys that are not common) those that may be similar by
    size, shared keys and parity."""
    about = lambda side, limit, *names: small(lists.select(F.col("node").alias(side), *[F.col(c).alias(c + side) for c in names]), limit)
    sized = pairs.join(about("u", BROADCAST_ROWS, "n", "common"), "u").join(about("v", BROADCAST_ROWS, "n", "common"), "v").filter(_fit(F.col("nu"), F.col("nv")))
    # all that two texts share is in both prefixes or behind the one that ends first
    a, b = SIMILAR
    least = lambda n: F.floor((a * n + (b - 1)) / b)
    both = F.col("nu") + F.col("nv")
    needed = F.ceil(a * both / (a + b)) - F.greatest(least(F.col("nu")), least(F.col("nv"))) + 1
    sized = sized.filter(F.col("shared") + F.least("commonu", "commonv") >= needed).drop("commonu", "commonv")
    x = stored(sized, "sized-pairs").join(about("u", BROADCAST_PARITIES, "parity"), "u").join(about("v", BROADCAST_PARITIES, "parity"), "v")
    return stored(x.filter(_close("parityu", "parityv", both)).select("u", "v"), "fitting")


def verified(pairs: DataFrame, rows: DataFrame, *, unique: bool = False) -> DataFrame:
    """(u, v), stored: of stored pairs those that are similar. ``unique``: no text has two rows."""
    with scratch(pairs.sparkSession):
        nodes = stored(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "pair-nodes")
        sets = _lists(rows.join(small(nodes), "node", "left_semi"), lambda s: s).select("node", "s")
        sets = stored(sets if unique else sets.dropDuplicates(["node"]), "pair-sets")
        x = _with_set(_with_set(pairs, sets, "u"), sets, "v")
        a, b = SIMILAR
        shared = F.size(F.array_intersect("su", "sv"))
        return stored(x.filter(shared * (a + b) >= a * (F.size("su") + F.size("sv"))).select("u", "v"), "similar", outer=True)


def _pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))


def _met(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs that met under a common key, whose shared keys are not counted."""
    return _pairs(rows, a, b).distinct().withColumn("shared", F.lit(1 << 30).cast("long"))


def print_pairs(texts: DataFrame) -> DataFrame:
    """(u, v, shared) of stored rows (node, fingerprint): each text with the least one of its fingerprint, and the least
    ones of fingerprints within two bits of each other. No fingerprint's texts are paired all with all."""
    leads = stored(texts.groupBy("fingerprint").agg(F.min("node").alias("lead")), "prints")
    lead = lambda side: leads.select(F.col("fingerprint").alias(side), F.col("lead").alias(f"lead_{side}"))
    near = stored(links(leads.select("fingerprint")), "near-prints")
    near = near.join(lead("u"), "u").join(lead("v"), "v").select("lead_u", "lead_v")
    return _met(texts.select("node", "fingerprint").join(leads, "fingerprint").select("node", "lead").union(near), "node", "lead")


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs of texts that verified links have not brought together yet."""
    groups = small(groups)
    root = lambda side: groups.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
    x = pairs.join(root("u"), "u", "left").join(root("v"), "v", "left")
    return x.filter(F.coalesce("root_u", "u") != F.coalesce("root_v", "v")).select("u", "v", "shared")


def _by_group(common: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of common keys with their text's group and the key's largest group."""
    near = common.join(small(groups), "node", "left").withColumn("root", F.coalesce("root", "node"))
    near = stored(near, "common-rows")
    counts = near.groupBy("key", "root").agg(F.count("*").alias("k")).groupBy("key").agg(F.max_by("root", F.struct("k", "root")).alias("main"))
    return stored(near.join(small(stored(counts, "common-main")), "key"), "common-rows")


def _key_tables(rows: DataFrame, few: int, unique: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored: the texts (node, n, parity, fingerprint, common keys), the keys of two texts and more (key, k, u, v), and the
    rows of those of more than two (key, node, n, short, k)."""
    shorts = Shorts(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    once = lambda x, *names: x if unique else x.dropDuplicates([*names])
    with scratch(rows.sparkSession):
        late = often_shared(rows, few, shorts)
        lists = stored(_lists(rows, lambda s: _first(s, late, shorts.mask), prints=True), "prefixes")
        keyed = shared_keys(lists, shorts)
        keys = keyed.groupBy("key").agg(F.count("*").alias("k"), F.min("node").alias("u"), F.max("node").alias("v")).filter("u < v")
        keys = stored(keys, "shared-keys", outer=True)
        many = small(stored(keys.filter("k > 2").select("key", "k"), "keys-of-many"))
        met = stored(once(keyed.filter("many").drop("many").join(many, "key"), "key", "node"), "key-rows", outer=True)
        n_common = small(stored(met.filter(F.col("k") > few).groupBy("node").agg(F.count("*").alias("common")), "common-counts"))
        about = once(lists.select("node", "n", "parity", "fingerprint"), "node").join(n_common, "node", "left")
        return stored(about.withColumn("common", F.coalesce("common", F.lit(0))), "texts", outer=True), keys, met


def similar_groups(rows: DataFrame, few: int = FEW, *, unique: bool = False) -> DataFrame:
    """(node, root): of rows (node, text) all nodes whose text is similar to another, and
    the least node of their group, which is not listed itself. ``unique``: no text has two rows."""
    about, keys, met = _key_tables(rows, few, unique)
    common = met.filter(F.col("k") > few).drop("k")
    check = lambda pairs: verified(pairs, rows, unique=unique)

    # what fingerprints show, and each text of a common key with one of them, verified in one go; then large groups: what is
    # outside the key's largest group against two of that group, others for each key
    lead = small(stored(common.groupBy("key").agg(F.min("node").alias("lead")), "common-leads"))
    first = print_pairs(about).union(_met(common.join(lead, "key"), "node", "lead")).distinct()
    found = check(fitting(first, about))
    groups = stored(components(found), "near-groups")
    near = _by_group(common, groups)
    h = F.xxhash64("key", "node")
    of_main = near.filter("root = main").groupBy("key").agg(F.min_by("node", h).alias("one"), F.max_by("node", h).alias("other"))
    outside = near.filter("root != main").join(small(stored(of_main, "common-leads")), "key").select("node", F.explode(F.array("one", "other")).alias("lead"))
    found = stored(found.union(check(fitting(_apart(_met(outside, "node", "lead"), groups), about))), "links")
    groups = stored(components(found), "near-groups")
    near = _by_group(common, groups)
    near = stored(near.join(small(about.select("node", "parity"), BROADCAST_PARITIES), "node"), "common-rows")

    # now all texts outside a key's largest group against all there; two such texts meet twice
    x = [F.col(c).alias(f"{c}_x") for c in ("node", "root", "n", "short", "parity")]
    far = small(stored(near.filter("root != main").select("key", *x), "common-others")).join(near, "key")
    first = (F.col("n_x") < F.col("n")) | ((F.col("n_x") == F.col("n")) & (F.col("node_x") < F.col("node")))
    far = far.filter("root_x != root AND (root = main OR node_x < node)").filter(_close("parity_x", "parity", F.col("n_x") + F.col("n")))
    far = far.filter(_fit(F.col("n_x"), F.col("n")) & F.when(first, F.col("short_x")).otherwise(F.col("short")))

    by_key = met.filter(F.col("k") <= few).groupBy("key").agg(F.collect_set("node").alias("a"))
    all_with_all = by_key.select("a", F.explode("a").alias("x")).select("x", F.explode("a").alias("y")).filter("x < y")
    pairs = keys.filter("k = 2").select("u", "v").union(_pairs(all_with_all, "x", "y")).withColumn("shared", F.lit(1).cast("long"))
    pairs = pairs.unionByName(_met(far, "node_x", "node")).groupBy("u", "v").agg(F.sum("shared").alias("shared"))
    return components(found.union(check(fitting(stored(_apart(pairs, groups), "pairs"), about))))


def one_of_each_group(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The input's rows, columns unchanged, one for each group: that with the smallest id
    (null ids last; among equal ids that with the least text hash; of repeated rows one)."""
    ids = stored(docs.select(F.col(key).alias("id"), text_key(F.col(text)).alias("node")), "ids")
    order = F.struct(F.col("id").isNull().alias("none"), "id", F.col("node").alias("hash"))
    texts = stored(ids.groupBy("node").agg(F.min(order).alias("least"), F.count("*").alias("n")), "texts")
    # one of each text's rows goes on
    copied = small(stored(texts.filter("n > 1").select("node", F.col("least.id").alias("first")), "copied-texts"))
    rows = docs.select(F.col(key).alias("id"), text_key(F.col(text)).alias("node"), F.col(text).alias("text"))
    is_first = F.col("first").eqNullSafe(F.col("id"))
    marked = lambda x: x.join(copied.withColumn("copied", F.lit(True)), "node", "left")
    one = F.col("copied").isNull() | is_first
    rows = marked(rows).filter(one).select("node", "text")
    unique = marked(ids).filter(one).count() == texts.count()
    with scratch(docs.sparkSession):
        groups = similar_groups(rows, unique=unique)
        groups = stored(groups.union(groups.select("root", "root").distinct()), "groups", lasting=True)

    # texts that are in a group or copied: the id that stays, if any
    grouped = groups.join(texts.select("node", "least"), "node")
    stays = grouped.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.hash").alias("node"), F.lit(True).alias("stays"))
    single = copied.select("node", "first").join(groups, "node", "left_anti")
    named = grouped.join(stays, "node", "left").select("node", F.col("least.id").alias("first"), F.coalesce("stays", F.lit(False)).alias("stays"))
    named = small(stored(named.unionByName(single.withColumn("stays", F.lit(True))), "judged-texts"))
    again = ids.join(named.filter("stays"), "node").filter(is_first).groupBy("node").agg(F.count("*").alias("n")).filter("n > 1").select("node")
    again = stored(again, "repeated-rows")

    name = F.struct(F.col(key).alias("id"), text_key(F.col(text)).alias("node"))
    out = docs.select(F.struct("*").alias("row"), name.alias("name")).select("row", "name", F.col("name.id").alias("id"), F.col("name.node").alias("node"))
    out = out.join(named, "node", "left").filter(F.col("stays").isNull() | (F.col("stays") & is_first))
    if again.isEmpty():
        return out.select("row.*")
    twice = out.join(small(again), "node", "left_semi").dropDuplicates(["name"])
    return out.join(small(again), "node", "left_anti").select("row.*").union(twice.select("row.*"))
