"""Near-duplicate groups by SimHash fingerprints and multi-index hashing.

Fingerprints are made by numpy inside tasks; the index, the links and the groups are
DataFrame joins. Defined results:

* null, empty or blank text: fingerprint 0, linked like any other;
* fewer than three words: the whole word sequence is the one shingle;
* repeated rows and equal texts share a fingerprint, hence a group; they are never paired;
* null ids stay in the result; a group's id is its smallest id that is not null;
* an empty table gives an empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexlake.llm.shared import stored, text_key

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 2
#: Shingles whose bits are counted at once, which bounds memory for a very long text.
CHUNK = 1 << 18


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of a text's lower-cased word shingles."""
    # bytes.lower() and bytes.split() know ASCII only: A-Z, and space, \t, \n, \v, \f, \r
    tokens = text.encode().lower().split() if text else []
    if not tokens:
        return 0
    hashed, n = xxhash.xxh64_intdigest, max(1, len(tokens) - SHINGLE_WORDS + 1)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    joined, starts = b" ".join(tokens), [0, *ends[: n - 1].tolist()]
    stops = (ends[-n:] - 1).tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        values = [hashed(joined[a:b], SEED) for a, b in zip(starts[at : at + CHUNK], stops[at : at + CHUNK], strict=True)]
        bits = np.unpackbits(np.array(values, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([fingerprint(t) for t in texts], dtype="int64")


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """The rows with their texts' fingerprints (long) in column ``out``."""
    return docs.withColumn(out, F.pandas_udf(_fingerprints, "long")(F.col(text)))


def _part(value: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(value, shift).bitwiseAND(F.lit((1 << width) - 1))


def _raised(value: Column, width: int, at: int) -> Column:
    """``value`` with one more of its bits from ``at`` on set, once for each that is not."""
    bits = F.array(*[F.lit(1 << (at + i)) for i in range(width)])
    return F.transform(F.filter(bits, lambda b: value.bitwiseAND(b) == 0), lambda b: value.bitwiseOR(b))


def links(prints: DataFrame) -> DataFrame:
    """Pairs (u, v), u < v, of distinct fingerprints that differ in one or two bits.

    A fingerprint is two segments of 32 bits, each two blocks of 16. For a pair within
    two bits, one of these holds, so a lookup with all of one segment and one block of the
    other, 48 bits in all, finds it:

    * the high segments are equal: then of the low blocks the first is within one bit or the
      second is equal;
    * the high segments differ in one bit: then one of the low blocks is equal;
    * the low segments are equal: as above with the high blocks.

    So each fingerprint is entered under four keys and looks up small balls of radius one.
    Of two values that differ in one bit just one has it clear, so only bits that are clear
    are flipped. Keys of 48 bits keep the table's entries few: entries under one key differ in
    16 bits only. Every match is verified on the whole fingerprint.
    """
    x = F.col("fingerprint")
    high, low = _part(x, 32, 32), _part(x, 0, 32)
    kinds = [F.shiftleft(s, 16).bitwiseOR(_part(x, at, 16)) for s, at in ((high, 16), (high, 0), (low, 48), (low, 32))]
    #: flipped bits of each kind of key: the segment is in bits 16-47, the block in 0-15
    flips = [((16, 0), (32, 16)), ((32, 16),), ((16, 0),), ()]
    tag = lambda k, key: key.bitwiseOR(F.lit(k << 48))
    entries = F.array(*[tag(k, key) for k, key in enumerate(kinds)])
    balls = F.flatten(F.array(*[_raised(tag(k, key), *f) for k, key in enumerate(kinds) for f in flips[k]]))
    # so few bytes that they would be put together in a few tasks, each row of which makes 50 more
    prints = prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fingerprint")
    table = prints.select(F.explode(entries).alias("key"), x.alias("v"))
    lookups = prints.select(F.explode(F.concat(entries, balls)).alias("key"), x.alias("u"))
    met = lookups.join(table, "key").filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))).between(1, RADIUS))
    return met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root) for the nodes of the edges (u, v): root is their component's least node, which
    has no row itself.

    Alternates large-star and small-star steps, each an aggregate and a join, until the edges
    no longer change. No node's neighbours are ever gathered; every round's edges are stored.
    """
    state = lambda e: e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
    edges = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "links")
    was = state(edges)
    for _ in range(max_rounds):
        if not was[0]:
            break
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        stars = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = stars.groupBy("u").agg(F.min("v").alias("m"))
        moved = stars.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(moved.union(least.select("u", "m")).distinct(), "links")
        now = state(edges)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def groups(prints: DataFrame) -> DataFrame:
    """(fingerprint, root) for every distinct fingerprint of a stored table."""
    nodes = prints.select("fingerprint").distinct()
    found = components(links(nodes))
    return nodes.join(found, nodes["fingerprint"] == found["node"], "left").select(
        "fingerprint", F.coalesce("root", "fingerprint").alias("root")
    )


def simhash_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: its id, fingerprint (16 hex digits), component_id (smallest id
    that links of at most two differing bits reach)."""
    prints = stored(with_fingerprint(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))).drop("text"), "fingerprints")
    roots = stored(groups(prints), "groups")
    ids = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    named = ids.join(roots, "fingerprint").groupBy("root").agg(F.min("least").alias("component_id"))
    member = roots.join(named, "root").select("fingerprint", "component_id")
    return prints.join(member, "fingerprint", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def rows_named(docs: DataFrame, kept: DataFrame, key: str, text: str) -> DataFrame:
    """The input's rows that ``least`` of ``kept`` names by id and text hash; of repeated rows one."""
    name = lambda i, h: F.struct(i.alias("id"), h.alias("hash")).alias("key")  # noqa: E731  structs with null fields are equal
    kept = kept.select(name(F.col("least.id"), F.col("least.hash")))
    rows = docs.select(F.struct("*").alias("row"), name(F.col(key), text_key(F.col(text))))
    return rows.join(kept, "key", "left_semi").dropDuplicates(["key"]).select("row.*")


def one_of_each_group(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The input's rows, columns unchanged, one for each group: that with the smallest id
    (null ids last; among equal ids that with the least text hash; of repeated rows one)."""
    named = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    prints = stored(with_fingerprint(named).select("id", text_key(F.col("text")).alias("hash"), "fingerprint"), "fingerprints")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "hash")
    least = prints.groupBy("fingerprint").agg(F.min(order).alias("least"))
    kept = least.join(groups(prints), "fingerprint").groupBy("root").agg(F.min("least").alias("least"))
    return rows_named(docs, kept, key, text)
