"""MinHash fingerprints of documents, near-duplicate classes by bands of them, and edited copies.

A text's shingles (five lower-cased words, ``near_dedup.shingle_set``) are hashed to 32 bits and permuted by
``PERMUTATIONS`` universal functions (a * x + b) mod 2^64, of which the high 32 bits count; a
signature has the low 16 bits of each permutation's least value. The share of equal values estimates the Jaccard
similarity of the shingle sets (standard error at most 0.045). All permutations of a block of
shingles are one numpy operation.

Near-duplicate classes: bands of four values are keys (two texts at similarity 0.8 miss all 32 bands once in 20
million pairs); texts that share a key are held against each other, size and parities of the shingle sets rule out most
(exact bounds), and what is left is verified by the Jaccard similarity of the whole sets, 0.8 or more. Texts with
equal sets are one node. A key of up to ``near_dedup.FEW`` texts meets all with all. A larger one is first held
against one of its texts, which takes a group of near-copies together with a check a text; then all that are outside
the key's largest group meet all there, in salted blocks, so no link is lost.

Edited copies: documents in ascending order of id (null last, ties by text hash) are dealt to ranges of ids, one
shuffle of the texts; the first document of each range goes to the range before as well, so every task has
each text beside the next one, streams through them, and holds two at a time.

Defined results: null text is empty; texts without words have one shingle of their own; texts of one to four words have
their word sequence; equal texts have equal fingerprints and one class; a lone document is its own next one; a class is named by its
smallest id that is not null; repeated rows stay and follow each other; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from codexlake.llm import near_dedup
from codexlake.llm.near_dedup import FEW, parity, shingle_set
from codexlake.llm.shared import few_by_hash, scratch, small, stored, text_key
from codexlake.llm.simhash_dedup import components

PERMUTATIONS = 128
BAND = 4
#: Shingles that are permuted at once.
BLOCK = 512
SEED = 11
#: Ranges of ids for each shuffle partition, and sampled ids for each range.
RANGES, SAMPLED = 4, 4
#: Pairs that one task should form of a common key's texts.
SALTED = 100_000

_random = np.random.default_rng(SEED)
FACTORS = _random.integers(0, 1 << 64, PERMUTATIONS, np.uint64, endpoint=False)[:, None] | np.uint64(1)
ADDENDS = _random.integers(0, 1 << 64, PERMUTATIONS, np.uint64, endpoint=False)[:, None]


def signature(shingles: np.ndarray) -> np.ndarray:
    """Unsigned 16-bit values, one for each permutation, of a set of at least one 64-bit hash."""
    x = shingles.view(np.uint64) >> np.uint64(32)
    least = np.full(PERMUTATIONS, np.iinfo(np.uint64).max)
    for at in range(0, len(x), BLOCK):
        np.minimum(least, (FACTORS * x[at : at + BLOCK] + ADDENDS).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype("<u2")


def fingerprint(text: str | None) -> np.ndarray:
    return signature(shingle_set(text))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of two signatures' texts."""
    return float(np.count_nonzero(a == b)) / len(a)


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


ROWS = (
    "doc_id {id}, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, "
    "node long, n int, parity array<long>"
)


def _ranges(docs: DataFrame, key: str) -> tuple[list, int]:
    """Ids that begin ranges, ascending, and the number of partitions to deal the ranges to."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col(key).alias("id")).filter("id IS NOT NULL")
    n = RANGES * tasks
    some = sorted({r.id for r in few_by_hash(ids, "id", SAMPLED * n)})
    least = ids.agg(F.min("id")).first()[0]
    each = max(1, -(-len(some) // n))
    return ([least, *[i for i in some[each::each] if i != least]] if some else []), tasks


def _in_ranges(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(range, extra, id, hash, text): the rows by ranges of ids, sorted, and after each range the document that follows it."""
    begins, tasks = _ranges(docs, key)
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("hash", text_key(F.col("text")))
    known, bounds = [], np.array(begins, object if begins and isinstance(begins[0], str) else None)

    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), side="right") - 1)

    where = F.lit(0).cast("long")
    if begins:
        where = F.when(F.col("id").isNull(), len(begins)).otherwise(F.pandas_udf(range_of, "long")(F.coalesce("id", F.lit(begins[0]))))
        known = [(b,) for b in begins]
    # the first document of each range; null ids are a range of their own
    first = small(docs.sparkSession.createDataFrame(known, f"id {dict(rows.dtypes)['id']}"))
    none = rows.filter("id IS NULL")
    begin = rows.join(first, "id", "left_semi").union(none.join(none.agg(F.min("hash").alias("hash")), "hash", "left_semi").select("id", "text", "hash"))
    begin = begin.groupBy("id").agg(F.min(F.struct("hash", "text")).alias("t")).select("id", "t.text", "t.hash")
    begin = stored(begin.withColumn("range", where.cast("long")), "range-begins")
    used = [r.range for r in begin.select("range").orderBy("range").collect()]
    rows = rows.withColumn("range", where.cast("long")).withColumn("extra", F.lit(False))
    if used:  # behind the range before go the first documents, behind the last range the first of all
        before = F.create_map(*[F.lit(x).cast("long") for i, r in enumerate(used) for x in (r, used[i - 1])])
        rows = rows.unionByName(begin.withColumn("range", F.element_at(before, F.col("range"))).withColumn("extra", F.lit(True)))
    return rows.repartition(tasks, "range").sortWithinPartitions("range", "extra", "id", "hash", "text").select("range", "extra", "id", "hash", "text")


def with_edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row the fingerprints of its text and of its edited text, what they have in common with each other and
    with the next document's, and (node, n, parity): the text's hash, and its set of shingles' size and parities."""
    dealt = _in_ranges(docs, key, text)
    shape = ROWS.format(id=dict(docs.dtypes)[key])
    schema = to_arrow_schema(StructType.fromDDL(shape))

    def about(text: str) -> tuple:
        s = shingle_set(text)
        return text, signature(s), len(s), parity(s).tolist()

    def row(doc_id, node: int, own: tuple, following: tuple) -> tuple:
        text, sig, n, odd = own
        new = edited(text, following[0])
        other = sig if new == text else fingerprint(new)
        return doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), sig.tobytes(), other.tobytes(), likeness(sig, other), likeness(sig, following[1]), node, n, odd

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = None, None
        for batch in batches:
            out = []
            for r, extra, i, node, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = held if held is not None and held[0] == text else about(text)
                if held is not None and at[0] == r:
                    out.append(row(*at[1:], held, found))
                held, at = None if extra else found, (r, i, node)
            columns = zip(*out, strict=True) if out else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return dealt.mapInArrow(run, shape)


def band_keys(print_: Column) -> Column:
    """One 64-bit key for each band of a signature in binary form."""
    width = 2 * BAND
    return F.array(*[F.xxhash64(F.lit(i), F.substring(print_, 1 + i * width, width)) for i in range(PERMUTATIONS // BAND)])


def _maybe(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(u, v) of the pairs that size and parity do not rule out; columns end in the names of the sides."""
    x = pairs.filter(F.col(f"node{a}") != F.col(f"node{b}")).filter(near_dedup._fit(F.col(f"n{a}"), F.col(f"n{b}")))
    x = x.filter(near_dedup._close(f"parity{a}", f"parity{b}", F.col(f"n{a}") + F.col(f"n{b}")))
    return x.select(F.least(f"node{a}", f"node{b}").alias("u"), F.greatest(f"node{a}", f"node{b}").alias("v"))


def similar_groups(nodes: DataFrame, rows: DataFrame, few: int = FEW) -> DataFrame:
    """(node, root): of nodes (node, fingerprint, n, parity) those whose shingle set is similar to another's,
    and the least node of their group, which has no row itself. ``rows`` (node, text) has a text for each node."""
    side = lambda s: [F.col(c).alias(c + s) for c in ("node", "n", "parity")]
    about = lambda s: small(nodes.select(*side(s)).dropDuplicates([f"node{s}"]))
    keyed = nodes.select("node", F.explode(band_keys(F.col("fingerprint"))).alias("key"))
    keys = keyed.groupBy("key").agg(F.count("*").alias("k"), F.min("node").alias("u"), F.max("node").alias("v")).filter("u < v")
    keys = stored(keys, "band-keys")
    met = stored(keyed.join(small(stored(keys.filter("k > 2").select("key", "k"), "keys-of-many")), "key"), "band-rows")

    # keys of few: all with all, by the keys' lists of at most ``few`` nodes
    lists = met.filter(F.col("k") <= few).groupBy("key").agg(F.collect_set("node").alias("a"))
    pairs = lists.select("a", F.explode("a").alias("u")).select("u", F.explode("a").alias("v")).filter("u < v")
    # common keys: each node with the key's least
    lead = keys.filter(F.col("k") > few).select("key", F.col("u").alias("lead"))
    star = met.filter(F.col("k") > few).join(small(lead), "key").filter("node != lead").select(F.col("lead").alias("u"), F.col("node").alias("v"))
    pairs = stored(keys.filter("k = 2").select("u", "v").union(pairs).union(star).distinct(), "band-pairs")
    pairs = pairs.join(about("_u").withColumnRenamed("node_u", "u"), "u").join(about("_v").withColumnRenamed("node_v", "v"), "v")
    pairs = _maybe(pairs.withColumnsRenamed({"u": "node_u", "v": "node_v"}), "_u", "_v")
    links = near_dedup.verified(stored(pairs, "maybe-similar"), rows)
    if keys.filter(F.col("k") > few).isEmpty():
        return components(links)

    # common keys again: those outside the key's largest group with all that are not of theirs
    groups = stored(components(links), "near-groups")
    near = near_dedup._by_group(met.filter(F.col("k") > few).drop("k"), groups)
    other = near.filter("root != main")
    # the larger side of a key is cut into blocks, each of which meets a copy of the smaller side
    counts = near.groupBy("key").agg(F.count("*").alias("all"), F.count_if(F.col("root") != F.col("main")).alias("others")).filter("others > 0")
    blocks = small(stored(counts.select("key", F.ceil(F.col("all") * F.col("others") / SALTED).cast("int").alias("blocks")), "key-blocks"))
    x = other.join(blocks, "key").select("key", F.col("node").alias("node_x"), F.col("root").alias("root_x"), "main", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    y = near.join(blocks, "key").select("key", "node", "root", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    x = x.join(about("_x"), "node_x")
    y = y.withColumnRenamed("node", "node_y").join(about("_y"), "node_y")
    far = x.join(y, ["key", "block"]).filter("root_x != root AND (root = main OR node_x < node_y)")
    far = stored(_maybe(far, "_x", "_y").distinct(), "maybe-similar")
    return components(links.union(near_dedup.verified(far, rows)))


def near_classes(prints: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(node, class_id) for the nodes of ``prints`` (the stored rows of ``with_edited`` of ``docs``) that several rows or a group
    of near-duplicates have: the group's smallest id."""
    once = stored(prints.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "nodes")
    copied = small(stored(once.filter("rows > 1").select("node", F.col("least").alias("first"), F.lit(True).alias("copied")), "copied-texts"))
    one = F.col("copied").isNull() | F.col("id").eqNullSafe(F.col("first"))
    # a row for each node, and one more for a row that is repeated, which changes nothing
    nodes = prints.select(F.col("doc_id").alias("id"), "node", "fingerprint", "n", "parity").join(copied, "node", "left").filter(one)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("id"), text_key(body).alias("node"), body.alias("text")).join(copied, "node", "left")
    rows = rows.filter(one).select("node", "text")
    with scratch(docs.sparkSession):
        groups = similar_groups(nodes.select("node", "fingerprint", "n", "parity"), rows)
        groups = stored(groups.union(groups.select("root", "root").distinct()), "groups", lasting=True)
    grouped = groups.join(once.select("node", "least"), "node")
    named = grouped.join(small(stored(grouped.groupBy("root").agg(F.min("least").alias("class_id")), "class-ids")), "root").select("node", "class_id")
    return named.union(copied.join(groups, "node", "left_anti").select("node", "first"))


def fingerprint_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: its fingerprint, that of its edited text, and its class of near-duplicates."""
    prints = stored(with_edited(docs, key, text), "min-hashes")
    named = small(stored(near_classes(prints, docs, key, text).withColumn("named", F.lit(True)), "classes"))
    hexed = lambda c: F.lower(F.hex(c)).alias(c)
    return prints.join(named, "node", "left").select(
        "doc_id", "n_chars", "edited_sha256", hexed("fingerprint"), hexed("edited_fingerprint"), "near_edited", "near_next",
        F.when(F.col("named"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
    )
