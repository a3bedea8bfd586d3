"""Product quantisation of vectors in whole numbers, exact on every machine.

A component x becomes floor(1024 * x). Vectors are cut into four parts; each part has a codebook of up to
256 entries, trained by rounds of assigning and averaging. A round is one pass over the vectors: tasks
assign batches and give one row of sums for each entry they met, Spark adds the rows up, and only a codebook
(256 entries, whatever the number of vectors) comes to the driver.

Distances come from matrix products of float64 that are exact: integers are cut into limbs so narrow that no
sum of a product reaches 2^53, products of limbs are put together in int64, and the first least distance wins.
However many limbs a batch needs, every round's result is that of integer arithmetic.

Defined results: a null vector, one with a null or non-finite component, an empty one, and one whose length
is not that of the kept vector with the smallest id, are dropped; so is one with a component so large that a
squared distance might not fit in a long (``largest``: about 2 * 10^5 at 64 components). Rows of null or
repeated ids are coded like others; null ids come last when a codebook is begun, and among equal ids the
lesser vector comes first. Fewer than 256 kept rows begin smaller codebooks. A length that four does not
divide gives the last part the rest. Repeated rows stay. An empty table gives an empty result. Other columns are not
looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexlake.llm.shared import small, stored

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Rows whose distances to a codebook are held at once.
BATCH = 4096
#: Bits of the whole numbers that float64 holds exactly.
EXACT_BITS = 53

Codebooks = list[np.ndarray]


def largest(length: int) -> int:
    """Components up to this keep the squared distance of two vectors, and all on the way to it, in a long."""
    return math.isqrt((1 << 62) // (4 * max(1, length)))


def part_ends(length: int, parts: int = PARTS) -> list[tuple[int, int]]:
    each = length // parts
    return [(i * each, length if i == parts - 1 else (i + 1) * each) for i in range(parts)]


def limbs(x: np.ndarray, width: int) -> list[np.ndarray]:
    """Float64 arrays L with x == sum of L[i] * 2^(i * width); all but the last are in [0, 2^width), and the
    last in [-2^width, 2^width)."""
    out = []
    while len(x) and (x.min() < -(1 << width) or x.max() >= 1 << width):
        out.append((x & ((1 << width) - 1)).astype(np.float64))
        x = x >> width
    return [*out, x.astype(np.float64)]


def exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integer matrices by float64 products of limbs. The result must fit in int64."""
    n = max(1, a.shape[1])
    width = (EXACT_BITS - 1 - (n - 1).bit_length()) // 2  # n * 2^(2 * width) <= 2^52
    left, right = limbs(a, width), limbs(b, width)
    out = np.zeros((len(a), len(b)), np.int64)
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            out += (x @ y.T).astype(np.int64) << np.int64(width * (i + j))
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the index of the nearest entry (the first of equals) and the squared distance."""
    far = (book * book).sum(axis=1) - 2 * exact_product(x, book)
    at = far.argmin(axis=1)
    return at, far[np.arange(len(x)), at] + (x * x).sum(axis=1)


def kept(vectors: DataFrame, key: str, vector: str, label: str | None) -> DataFrame:
    """(id, label, v) of the rows whose vector has finite components only; v is an array of longs. Components
    that no long holds become null."""
    v = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * SCALE).try_cast("long"))
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != F.lit(math.inf)), F.lit(False)))
    rows = vectors.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & finite)
    return rows.select(F.col(key).alias("id"), (F.col(label) if label else F.lit(None)).alias("label"), v.alias("v"))


def fits(v: Column, length: int) -> Column:
    most = largest(length)
    return (F.size(v) == length) & F.forall(v, lambda x: F.coalesce(x.between(-most, most), F.lit(False)))


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, length)


def _sums(rows: DataFrame, books: Codebooks, length: int) -> DataFrame:
    """(part, entry, place, total, n): for each component of each used entry the sum of its parts', and their number."""
    ends = part_ends(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros_like(b) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            x = _matrix(batch.column(0), length)
            for a in range(0, len(x), BATCH):
                for (i, j), book, total, count in zip(ends, books, totals, counts, strict=True):
                    at, _ = nearest(x[a : a + BATCH, i:j], book)
                    np.add.at(total, at, x[a : a + BATCH, i:j])
                    count += np.bincount(at, minlength=len(book))
        for k, (total, count) in enumerate(zip(totals, counts, strict=True)):
            used = np.flatnonzero(count)
            if len(used) and total.shape[1]:
                w = total.shape[1]
                columns = [np.full(len(used) * w, k), np.repeat(used, w), np.tile(np.arange(w), len(used)), total[used].ravel(), np.repeat(count[used], w)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["part", "entry", "place", "total", "n"])

    sums = rows.select("v").mapInArrow(run, "part long, entry long, place long, total long, n long")
    # sums of longs may pass a long on the way to a mean, decimals don't
    return sums.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))


def first_codebooks(rows: DataFrame, length: int, entries: int = ENTRIES) -> Codebooks:
    """The parts of the rows with the smallest ids."""
    begin = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    x = np.array([r.v for r in begin], np.int64).reshape(-1, length)
    return [x[:, i:j].copy() for i, j in part_ends(length)]


def trained(rows: DataFrame, length: int, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks after so many rounds; an entry that no part is nearest to stays as it is."""
    books = first_codebooks(rows, length, entries)
    for _ in range(rounds):
        new = [b.copy() for b in books]
        for r in _sums(rows, books, length).collect():  # at most entries times length rows
            new[r.part][r.entry, r.place] = int(r.total) // r.n
        books = new
    return books


def digest(books: Codebooks) -> str:
    """SHA-256 of all components by part, entry, place, with commas between."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def coded(rows: DataFrame, books: Codebooks, length: int) -> DataFrame:
    """(id, label, code, error): two hex digits for each part, and the squared distance to what they stand for."""
    ends = part_ends(length)
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                part = batch.slice(a, BATCH)
                x = _matrix(part.column(2), length)
                found = [nearest(x[:, i:j], book) for (i, j), book in zip(ends, books, strict=True)]
                codes = np.stack([at for at, _ in found], axis=1).astype(np.uint8)
                error = sum(far for _, far in found)
                columns = [part.column(0), part.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "label", "code", "error"])

    return rows.select("id", "label", "v").mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def decoded(code: str, books: Codebooks) -> list[int]:
    """The vector that a code stands for."""
    return [x for at, book in zip(bytes.fromhex(code), books, strict=True) for x in book[at].tolist()]


def compressed(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | None = "label") -> tuple[DataFrame, Codebooks]:
    """((id, label, code, error) of the kept rows, the codebooks they are coded by)."""
    rows = kept(vectors, key, vector, label)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").select(F.size("v").alias("n")).first()
    length = first.n if first else PARTS
    rows = rows.filter(fits(F.col("v"), length))
    books = trained(rows, length)
    return coded(rows, books, length), books


def code_report(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """A row for each kept vector: its code, its error, all error of its label, the codebooks' digest."""
    codes, books = compressed(vectors, key, vector, label)
    codes = stored(codes, "codes")
    by_label = stored(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    by_label = small(by_label.withColumnRenamed("label", "of"))
    return codes.join(by_label, F.col("label").eqNullSafe(F.col("of")), "left").select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )
