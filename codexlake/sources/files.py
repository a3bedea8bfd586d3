"""Files in and out: inventories, pages, JSON lines, JSON documents, embedding records."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codexlake.functions.metadata import collection
from codexlake.functions.text import hash_parts
from codexlake.operators.structure import KEYS
from codexlake.operators.vectors import latest

_S, _I, _L = T.StringType(), T.IntegerType(), T.ArrayType(T.StringType())


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


STRUCTURE = _struct(**{k: _S for k in KEYS})
PAGE = _struct(
    document_id=_S, page_id=_S, dataset_id=_S, relative_path=_S, page_index=_I, printed_page_number=_I, text=_S, raw_text=_S, ocr_used=T.BooleanType(),
    extraction_method=_S, extraction_failed=T.BooleanType(), failure_reason=_S, page_text_sha256=_S,
)
PROVENANCE = _struct(
    source_file=_S, relative_path=_S, document_id=_S, page_id=_S, pdf_page_start=_I, pdf_page_end=_I, printed_page_start=_I, printed_page_end=_I,
    **{k: _S for k in KEYS if k not in ("judgment", "order")},
)
CHUNK = _struct(
    corpus_id=_S, chunk_id=_S, document_id=_S, page_id=_S, dataset_id=_S, document_name=_S, chunk_index=_I, text=_S, embedding_text=_S, token_count=_I, character_count=_I,
    provenance=PROVENANCE,
    metadata=_struct(document_type=_S, jurisdiction=_S, authority=_S, language=_S, legal_domains=_L, dataset_id=_S, document_id=_S, section=_S, article=_S, chapter=_S, case_name=_S),
    hashes=_struct(source_sha256=_S, chunk_text_sha256=_S),
)
EMBEDDING = _struct(
    chunk_id=_S, cache_key=_S, embedding_model=_S, embedding_provider=_S, embedding_dimension=_I, embedding=T.ArrayType(T.DoubleType()), embedding_input_sha256=_S,
    normalized=T.BooleanType(), model_revision=_S, indexing_version=_S,
)


def inventory(spark: SparkSession, root: str, suffix: str = ".pdf", corpus_id: str = "corpus") -> DataFrame:
    """Files below a folder whose name ends so, in any case: path, collection, id, content hash."""
    glob = "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)  # contents of other files are not read
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    top = "/" + root.split("://")[-1].strip("/") + "/"
    path = F.substring("path", F.instr("path", top) + len(top), F.length("path"))  # only the first time that it occurs
    x = files.select(path.alias("relative_path"), F.sha2("content", 256).alias("source_sha256"))
    x = x.withColumn("dataset_id", collection(F.col("relative_path")))
    return x.withColumn("document_id", hash_parts(F.lit(corpus_id), F.col("dataset_id"), F.col("relative_path")))


RAW = "relative_path string, page_index int, raw_text string, extraction_failed boolean, failure_reason string, error string"


def extracted(files: DataFrame, factory: Callable[[], Callable[[str, bytes], Iterable[str | None]]]) -> DataFrame:
    """The pages of files (relative_path, content), read by a user's reader, which is made once a task: it gives the pages' texts, one
    after the other, None for a page that cannot be read. A file whose reader fails has one more row, with the error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = factory()
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = 0
                try:
                    for text in reader(path, content):
                        lost = text is None
                        yield _raw([(path, n, text or "", lost, "no text" if lost else None, None)])
                        n += 1
                except Exception as e:  # whatever a file holds, others go on
                    yield _raw([(path, None, None, None, None, f"{type(e).__name__}: {e}")])

    return files.select("relative_path", "content").repartition("relative_path").mapInArrow(run, RAW)


def _raw(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in RAW.split(", ")])


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType = CHUNK) -> DataFrame:
    """Rows of a declared schema; blank lines are none."""
    return spark.read.schema(schema).json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """One object a line, fields in order of name, other alphabets as they are."""
    df.select(*sorted(df.columns)).write.mode("errorifexists").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def write_json(df: DataFrame, path: str) -> None:
    """One row as one document."""
    df.coalesce(1).write.mode("errorifexists").json(path)


def read_embeddings(spark: SparkSession, path: str, order: str | None = None) -> DataFrame:
    """Embedding records; with an order column, of one key the last."""
    df = spark.read.parquet(path)
    return latest(df, order) if order else df.dropDuplicates(["cache_key"])


def write_embeddings(df: DataFrame, path: str) -> None:
    df.select(*[f.name for f in EMBEDDING]).write.mode("errorifexists").parquet(path)
