"""The trie of all conversations' beginnings, as balanced parentheses in sorted shards.

1. Each conversation becomes a path: the 16-byte digests of its turns, one after the other, and their texts'
   lengths. Texts go no further. Equal paths are one row with their count, least id and digest of all ids.
2. Paths are dealt to shards by ranges. Cuts come from a sample by hash, of bounded size; they decide only
   how even the shards are. A shard sorts its paths and writes its part of the trie in preorder as balanced
   parentheses (``Parens``): blocks of excess with a tree of range minima and maxima find where each node
   closes, ranks of the pairs "()" count leaves, and cumulative sums over the preorder count members and savings.
3. A node can be in several shards only if it is a proper prefix of a cut, so each shard knows its shared
   spines, and gives them in parts that add up: members, and leaves and savings of nodes that are not shared. Spark merges
   the parts, adds up what shared nodes save along their spines, and counts shared children once.

Defined results: null role or text is empty; null turns come first; turns of equal number are ordered by the
digest of role and text, then repeated rows stay as turns of their own; rows without conv_id belong to no conversation; an empty
table has no nodes; very long texts are digested in place, and a very long conversation is one row of 20 bytes a turn. Other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexlake.llm.shared import few_by_hash, small, stored

#: Bytes of a turn's digest in a path.
TURN = 16
#: Nodes that a shard holds about; there are as many shards as shuffle partitions at least.
SHARD_NODES = 100_000
#: Sampled paths for each shard, to choose cuts from, and turns that a cut keeps of one.
SAMPLED, CUT_TURNS = 8, 256
#: Width of the id ranges whose members' ids are put together before they are hashed in order.
IDS = 4096
EMPTY = hashlib.sha256(b"").hexdigest()


class Parens:
    """Balanced parentheses (True opens) with excess blocks under a tree of range minima and maxima."""

    BLOCK = 64

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.excess = np.cumsum(np.where(bits, 1, -1))
        n = max(1, -(-len(bits) // self.BLOCK))
        n = 1 << (n - 1).bit_length()
        low, high = (np.full(n * self.BLOCK, x, np.int64) for x in (1 << 60, -(1 << 60)))
        low[: len(bits)] = high[: len(bits)] = self.excess
        self.least, self.most = [low.reshape(n, -1).min(axis=1)], [high.reshape(n, -1).max(axis=1)]
        while len(self.least[-1]) > 1:
            self.least.append(self.least[-1].reshape(-1, 2).min(axis=1))
            self.most.append(self.most[-1].reshape(-1, 2).max(axis=1))
        leaf = np.zeros(len(bits) + 1, np.int64)
        leaf[1:-1] = bits[:-1] & ~bits[1:]
        self._leaf = leaf[1:]

    def opens(self) -> np.ndarray:
        return np.flatnonzero(self.bits)

    def _within(self, at: np.ndarray, target: np.ndarray) -> np.ndarray:
        """For each position the first from there on, within its block, with that excess; -1 if none."""
        out = np.full(len(at), -1)
        end = np.minimum((at // self.BLOCK + 1) * self.BLOCK, len(self.bits))
        left = np.flatnonzero(at < end)
        pos = at.copy()
        while len(left):
            hit = self.excess[pos[left]] == target[left]
            out[left[hit]] = pos[left[hit]]
            left = left[~hit]
            pos[left] += 1
            left = left[pos[left] < end[left]]
        return out

    def _holds(self, level: int, block: np.ndarray, target: np.ndarray) -> np.ndarray:
        return (self.least[level][block] <= target) & (target <= self.most[level][block])

    def find_close(self, at: np.ndarray) -> np.ndarray:
        """Where the parentheses that open at these positions close."""
        target = self.excess[at] - 1
        out = self._within(at + 1, target) if len(at) else at
        # a position at a block's end looks on from the next block, as do those not found in their own
        out[(at + 1) // self.BLOCK != at // self.BLOCK] = -1
        todo, level = np.flatnonzero(out < 0), 0
        block, found = at[todo] // self.BLOCK, []
        while len(todo) and level < len(self.least) - 1:  # up: is it in the range to the right?
            right = block | 1
            hit = (block & 1 == 0) & self._holds(level, right, target[todo])
            found.append((todo[hit], right[hit], level))
            todo, block, level = todo[~hit], block[~hit] >> 1, level + 1
        for some, block, level in found:  # down to the first block that has it
            for k in range(level - 1, -1, -1):
                block = block * 2
                block = np.where(self._holds(k, block, target[some]), block, block + 1)
            out[some] = self._within(block * self.BLOCK, target[some])
        return out

    def leaf_rank(self, counted: np.ndarray) -> np.ndarray:
        """Before each position, the number of pairs "()" whose opening one is counted."""
        return np.concatenate([[0], np.cumsum(self._leaf * counted)])


def common_turns(a: bytes, b: bytes) -> int:
    n, k = min(len(a), len(b)) // TURN, 0
    while k < n and a[k * TURN : (k + 1) * TURN] == b[k * TURN : (k + 1) * TURN]:
        k += 1
    return k


def shard_nodes(paths: list[bytes], lens: list[list[int]], n: np.ndarray, least: np.ndarray, ends: list[str], low: bytes | None, high: bytes | None) -> dict[str, list | np.ndarray]:
    """The nodes of one shard's sorted distinct paths, in preorder. Of a shared node, a proper prefix of a
    cut, ``n_leaves`` and ``saved_tokens`` hold what its nodes that are not shared have."""
    common = [0, *(common_turns(a, b) for a, b in zip(paths, paths[1:], strict=False))]
    sizes = [len(p) // TURN for p in paths]
    closing = [0, *(s - k for s, k in zip(sizes, common[1:], strict=False))]
    opening = [s - k for s, k in zip(sizes, common, strict=True)]
    opening[0] += 1  # the root
    runs = np.stack([closing, opening], axis=1).ravel()
    bits = np.concatenate([np.repeat(np.tile([False, True], len(paths)), runs), np.zeros(sizes[-1] + 1, bool)])
    tree = Parens(bits)
    opens = tree.opens()
    closes = tree.find_close(opens)
    depth = tree.excess[opens] - 1
    end = np.arange(len(opens)) + (closes - opens + 1) // 2  # preorder number after the subtree's last
    last = np.cumsum(opening) - 1  # the node where each path ends
    chars = np.concatenate([[0], *(x[k:] for x, k in zip(lens, common, strict=True))]).astype(np.int64)

    members, first = np.zeros(len(opens), np.int64), np.full(len(opens), np.iinfo(np.int64).max)
    members[last], first[last] = n, least
    within = lambda x: (c := np.concatenate([[0], np.cumsum(x)]))[end] - c[:-1]
    n_convs = within(members)
    parent = np.full(len(opens), -1)
    by_depth = np.argsort(depth, kind="stable")
    levels = np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1)
    for above, level in zip(levels, levels[1:], strict=False):
        parent[level] = above[np.searchsorted(above, level) - 1]  # preorder: the last one before it
    for level in reversed(levels[1:]):
        np.minimum.at(first, parent[level], first[level])

    shared = np.zeros(len(opens), bool)
    for cut, at in ((low, 0), (high, len(paths) - 1)):
        if cut is not None:
            top = min(common_turns(paths[at], cut), len(cut) // TURN - 1)
            i = last[at]
            while i >= 0:
                shared[i] |= depth[i] <= top
                i = parent[i]
    saved = within(np.where(shared, 0, (n_convs - 1) * chars))
    counted = np.zeros(len(bits), np.int64)
    counted[opens] = ~shared
    rank = tree.leaf_rank(counted)
    child = parent[~shared]
    children = np.bincount(child[child >= 0], minlength=len(opens))

    texts: list = [None] * len(opens)
    for i, e in zip(last.tolist(), ends, strict=True):
        texts[i] = e
    path_of = np.searchsorted(last, np.arange(len(opens)))  # the first path through a node is the one that opened it
    prefix = lambda i: paths[path_of[i]][: int(depth[i]) * TURN]
    above_shared = (parent >= 0) & ~shared & shared[parent]
    own_parent = (parent >= 0) & ~shared & ~shared[parent]
    return {
        "shared": shared,
        "path": [prefix(i) if s else None for i, s in enumerate(shared.tolist())],
        "under": [prefix(p) if a else None for p, a in zip(parent.tolist(), above_shared.tolist(), strict=True)],
        "conv_id": first,
        "depth": depth,
        "parent_conv_id": pa.array(first[parent], pa.int64(), mask=~own_parent),
        "n_convs": n_convs,
        "n_children": children,
        "n_leaves": rank[closes] - rank[opens],
        "saved_tokens": saved,
        "chars": chars,
        "ends_sha256": texts,
    }


NODES = (
    "shared boolean, path binary, under binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, chars long, ends_sha256 string"
)


def turns_of(rows: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): for each conversation its turns in order, as structs of digest and code points."""
    c = lambda x: F.coalesce(F.col(x), F.lit(""))
    digest = F.md5(F.concat(F.length(c(role)).cast("string"), F.lit(":"), c(role), c(text)).cast("binary"))
    t = F.struct(F.col(order).alias("n"), digest.alias("turn"), F.length(c(text)).alias("chars"))
    turns = rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(t)).alias("t"))
    return turns.select("conv_id", F.transform("t", lambda x: F.struct(x["turn"].alias("turn"), x["chars"].alias("chars"))).alias("turns"))


def rebuilt(turns: DataFrame, every: int = 100, most: int = 5) -> DataFrame:
    """(conv_id, turns): conversation c begins with the first h original turns of conversation c - c % every, and
    goes on with its own after its first h; h = crc32(c) % (most + 1)."""
    heads = turns.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("head_id"), F.slice("turns", 1, most).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    x = turns.withColumn("h", h).withColumn("head_id", F.col("conv_id") - F.col("conv_id") % every).join(heads, "head_id", "left")
    none = F.array().cast(dict(turns.dtypes)["turns"])
    head = F.when(F.col("h") > 0, F.slice(F.coalesce("head", none), F.lit(1), F.col("h"))).otherwise(none)
    return x.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def _ids_digest(members: DataFrame) -> DataFrame:
    """(name, ends_sha256): the hash of each path's members' ids in ascending order. Ids of one range of
    ``IDS`` make one string each, so that those of a path that very many share are put together in many tasks; one then
    hashes the strings as they come."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    some = members.groupBy("name", F.floor(F.col("conv_id") / IDS).alias("range")).agg(ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, h = None, None
        for batch in batches:
            names, digests = [], []
            for who, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if who == name:
                    h.update(b",")
                else:
                    if h is not None:
                        names.append(name)
                        digests.append(h.hexdigest())
                    name, h = who, hashlib.sha256()
                h.update(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(digests, pa.string())], ["name", "ends_sha256"])
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([h.hexdigest()])], ["name", "ends_sha256"])

    return some.repartition("name").sortWithinPartitions("name", "range").select("name", "ids").mapInArrow(run, "name string, ends_sha256 string")


def distinct_paths(conversations: DataFrame) -> DataFrame:
    """(name, path, lens, n, least, ends_sha256) of (conv_id, turns): one row for each sequence of turns."""
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["turn"]), ""))
    rows = conversations.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["chars"]).alias("lens"))
    rows = stored(rows.withColumn("name", F.md5("path")), "paths")
    once = rows.groupBy("name").agg(F.any_value("path").alias("path"), F.any_value("lens").alias("lens"), F.count("*").alias("n"), F.min("conv_id").alias("least"))
    return once.join(_ids_digest(rows.select("name", "conv_id")), "name")


def _cuts(paths: DataFrame) -> tuple[list[bytes], int]:
    """Where shards begin (all but the first), sorted, and the number of partitions to deal them to."""
    total = paths.agg(F.count("*").alias("n"), F.sum(F.size("lens")).alias("nodes")).first()
    shards = max(int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")), (total.nodes or 0) // SHARD_NODES + 1)
    cut = F.substring("path", 1, CUT_TURNS * TURN)
    some = sorted({bytes(r.cut) for r in few_by_hash(paths.select("name", cut.alias("cut")), "name", SAMPLED * shards, total.n)} - {b""})
    each = max(1, -(-len(some) // shards))
    return some[each::each], shards


def _at(path: Column, size: Column) -> Column:
    return F.substring(path, F.lit(1), (size * TURN).cast("int"))


def _merged(parts: DataFrame) -> DataFrame:
    """Shared nodes, each from its parts in several shards."""
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    one = [F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("chars").alias("chars"), F.max("ends_sha256").alias("ends_sha256")]
    nodes = stored(parts.groupBy("path").agg(*sums, *one), "spines")
    own = ((F.col("n_convs") - 1) * F.col("chars")).alias("own")
    up = nodes.select("path", own, F.explode(F.sequence(F.lit(0), F.col("depth").cast("int"))).alias("at"))
    spine = up.groupBy(_at(F.col("path"), F.col("at")).alias("path")).agg(F.sum("own").alias("own"))
    child = nodes.filter("depth > 0").groupBy(_at(F.col("path"), F.col("depth") - 1).alias("path")).agg(F.count("*").alias("more"))
    return nodes.join(spine, "path").join(child, "path", "left").withColumns(
        {"saved_tokens": F.col("saved_tokens") + F.col("own"), "n_children": F.col("n_children") + F.coalesce("more", F.lit(0))}
    )


def trie(conversations: DataFrame) -> DataFrame:
    """A row for each node of the trie of (conv_id, turns): conv_id, its smallest member; depth; parent_conv_id; n_convs;
    n_children; n_leaves; saved_tokens; ends_sha256."""
    paths = stored(distinct_paths(conversations), "distinct-paths")
    cuts, shards = _cuts(paths)

    def shard_of(column: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(cuts, p) for p in column], dtype="int64")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for k, group in groupby(rows, key=lambda r: r[0]):
            _, path, lens, n, least, ends = zip(*group, strict=True)
            low, high = cuts[k - 1] if k else None, cuts[k] if k < len(cuts) else None
            found = shard_nodes(list(path), list(lens), np.array(n), np.array(least), list(ends), low, high)
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) if isinstance(x, np.ndarray) else pa.array(x, pa.string() if c == "ends_sha256" else pa.binary()) for c, x in found.items()], list(found))

    dealt = paths.withColumn("shard", F.pandas_udf(shard_of, "long")("path")).repartition(shards, "shard").sortWithinPartitions("shard", "path")
    nodes = stored(dealt.select("shard", "path", "lens", "n", "least", "ends_sha256").mapInArrow(run, NODES), "trie-nodes")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    ends = F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")
    shared = stored(_merged(nodes.filter("shared")), "spine-nodes")
    above = small(shared.select(F.col("path").alias("under"), F.col("conv_id").alias("above")))
    top = shared.withColumn("under", F.when(F.col("depth") > 0, _at(F.col("path"), F.col("depth") - 1))).join(above, "under", "left")
    top = top.withColumn("parent_conv_id", F.col("above")).select(*names, ends)
    inner = nodes.filter("NOT shared").join(above, "under", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    return inner.select(*names, ends).unionByName(top)


def trie_report(rows: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of (conv_id, turn, role, text)."""
    return trie(rebuilt(stored(turns_of(rows), "turns")))
