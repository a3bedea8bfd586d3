"""The composed jobs: ingest pages, build indexes, answer a table of queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexlake.functions import metadata, query_text
from codexlake.functions.text import cleaned, hash_parts, printed_page_number
from codexlake.operators import audit, chunking, evidence, fusion, lexical, quality, structure, vectors
from codexlake.sources import files as sinks
from codexlake.sources.snapshots import Snapshots
from codexlake.sources.stage import stored


@dataclass(frozen=True)
class Ingested:
    documents: DataFrame
    pages: DataFrame
    blocks: DataFrame
    chunks: DataFrame
    findings: DataFrame


def cleaned_pages(raw: DataFrame) -> DataFrame:
    """Raw pages (document_id, page_index, raw_text) with clean text, printed number, id and hash. They are
    dealt out page by page first, so that neither a few large files nor one long document keep them in few tasks."""
    raw = raw.repartition("document_id", "page_index")
    marks = quality.repeated_lines(raw, "raw_text").groupBy("document_id").agg(F.collect_set("line").alias("_marks"))  # a few lines a document
    x = raw.join(marks, "document_id", "left").withColumn("text", cleaned(F.col("raw_text"), F.col("_marks"))).drop("_marks")
    return x.withColumns({"printed_page_number": printed_page_number(F.col("raw_text")), "page_id": hash_parts(F.col("document_id"), F.col("page_index")), "page_text_sha256": hash_parts(F.col("text"))})


#: Documents that another version processed are not taken over.
PROCESSOR_VERSION = "1"


@dataclass(frozen=True)
class Processed:
    """What is made of each document by itself. ``failed``: (document_id, relative_path, error); such documents have a row in
    ``documents`` and nothing else."""

    documents: DataFrame
    pages: DataFrame
    blocks: DataFrame
    chunks: DataFrame
    failed: DataFrame


def inventoried(files: DataFrame, size: int, overlap: int, corpus_id: str) -> DataFrame:
    """The files with the keys by which an earlier result fits."""
    keys = {"document_id": hash_parts(F.lit(corpus_id), metadata.collection(F.col("relative_path")), F.col("relative_path"))}
    return files.withColumns(keys | {"processor_version": F.lit(PROCESSOR_VERSION), "chunk_size": F.lit(size), "chunk_overlap": F.lit(overlap)})


def process(files: DataFrame, raw: DataFrame, size: int = chunking.SIZE, overlap: int = chunking.OVERLAP, corpus_id: str = "corpus", with_chunks: bool = True, cut: Callable = chunking.split_large) -> Processed:
    """``ingest`` up to the chunks, each document by itself: one that cannot be read (a row of ``raw`` with an ``error``) or
    packed fails alone. All tables are stored as they are made, for all that reads them, and so are
    the raw pages, which several steps read and which may be dear to make."""
    raw = stored(raw, "raw-pages")
    errors = raw.filter("error IS NOT NULL").groupBy("relative_path").agg(F.min("error").alias("error")) if "error" in raw.columns else raw.limit(0).select("relative_path", F.lit("").alias("error"))
    unread = stored(errors, "unread")
    raw = raw.join(unread, "relative_path", "left_anti").drop("error")
    head = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("page_index") < 3, F.struct("page_index", "raw_text")))), lambda x: x["raw_text"]), "\n")
    first = raw.groupBy("relative_path").agg(head.alias("first_pages_text"))
    known = inventoried(files, size, overlap, corpus_id).drop("document_id")
    documents = stored(metadata.described(known.join(first, "relative_path", "left"), corpus_id), "documents")
    named = documents.select("relative_path", "document_id", "dataset_id")
    pages = stored(cleaned_pages(raw.join(named, "relative_path")), "clean-pages")
    blocks = stored(structure.structural_blocks(pages), "blocks")
    packed = stored(chunking.pack_each(blocks, size, overlap, cut), "packed") if with_chunks else blocks.sparkSession.createDataFrame([], f"{chunking.PACKED}, error string")
    unpacked = packed.filter("error IS NOT NULL").select("document_id", "error").join(named.select("document_id", "relative_path"), "document_id")
    failed = stored(unread.join(named, "relative_path").select("document_id", "relative_path", "error").unionByName(unpacked), "failed")
    good = lambda rows: rows.join(failed, "document_id", "left_anti")
    chunks = stored(chunking.chunk_rows(documents, blocks, good(packed).drop("error"), corpus_id), "chunks")
    why = failed.select("document_id", F.col("error").alias("failure_reason"))
    lost = F.col("failure_reason").isNotNull()
    documents = documents.join(why, "document_id", "left").withColumns({
        "page_count": F.when(lost, 0).otherwise(F.col("page_count")), "document_type": F.when(lost, "Other").otherwise(F.col("document_type")),
        **{c: F.when(~lost, F.col(c)) for c in ("title", "jurisdiction", "authority", "language")},
        "legal_domains": F.when(lost, F.array().cast("array<string>")).otherwise(F.col("legal_domains")),
    })
    return Processed(documents, good(pages), good(blocks), chunks, failed)


def finished(x: Processed, with_chunks: bool = True) -> Ingested:
    """What depends on all documents: duplicate flags and findings."""
    pages = stored(quality.with_duplicate_flags(x.pages), "pages")
    good = x.documents.filter("failure_reason IS NULL")
    found = quality.all_of(
        quality.page_findings(pages), quality.document_findings(good, pages, x.chunks), quality.duplicate_findings(x.documents, pages, x.chunks),
        quality.processed_findings(good, pages), quality.failed_findings(x.failed),
    )
    if not with_chunks:
        found = found.filter("code != 'NO_CHUNKS'")
    return Ingested(x.documents, pages, x.blocks, x.chunks, quality.with_page_path(found, x.documents))


def ingest(files: DataFrame, raw: DataFrame, size: int = chunking.SIZE, overlap: int = chunking.OVERLAP, corpus_id: str = "corpus", with_chunks: bool = True, cut: Callable = chunking.split_large) -> Ingested:
    """Files (relative_path, source_sha256, page_count) and raw pages (relative_path, page_index, raw_text,
    extraction_failed, failure_reason; and perhaps error, why a file could not be read) to chunks and findings. With
    ``with_chunks`` off, only validates."""
    return finished(process(files, raw, size, overlap, corpus_id, with_chunks, cut), with_chunks)


@dataclass(frozen=True)
class Update:
    """What a run on a stored corpus did: (document_id, action) of every document, and the corpus as it is now."""

    actions: DataFrame
    corpus: Ingested


def ingest_again(files: DataFrame, raw: DataFrame, store: Snapshots, size: int = chunking.SIZE, overlap: int = chunking.OVERLAP, corpus_id: str = "corpus", force: bool = False, cut: Callable = chunking.split_large) -> Update:
    """``ingest`` into a store of snapshots, whose key is document_id. Documents whose file, sizes and processor are those of the last snapshot
    are not touched, the others processed, those that are gone left out; failed ones are tried again. Only buckets with a
    changed document are written, and the new snapshot becomes the current one by its last step."""
    old = store.current()
    files = stored(files, "files")  # held against the last snapshot in several places
    now = inventoried(files, size, overlap, corpus_id)
    if old is None:
        actions = now.select("document_id", F.lit("process").alias("action"))
        x = process(files, raw, size, overlap, corpus_id, cut=cut)
    else:
        known = old["documents"]
        plan = quality.incremental_plan(now, known.filter("failure_reason IS NULL"), force=force)
        gone = known.filter("failure_reason IS NOT NULL").join(now, "document_id", "left_anti").select("document_id", F.lit("remove").alias("action"))
        actions = stored(plan.union(gone), "actions")
        todo = now.join(actions.filter("action = 'process'"), "document_id", "left_semi").select(*files.columns)
        x = process(todo, raw.join(todo, "relative_path", "left_semi"), size, overlap, corpus_id, cut=cut)
    tables = {t: getattr(x, t) for t in ("documents", "pages", "blocks", "chunks", "failed")}
    changed = None if old is None else actions.filter("action != 'reuse'").select("document_id")
    return Update(actions, finished(Processed(**store.update(tables, changed))))


@dataclass(frozen=True)
class Indexes:
    judged: DataFrame
    embeddings: DataFrame | None
    bm25: lexical.Bm25Index | None
    points: DataFrame | None


def build_indexes(
    chunks: DataFrame, pairs: DataFrame, factory: Callable, provider: str, model: str, revision: str | None = None, normalize: bool = True, cache: DataFrame | None = None,
    index_collisions: bool = False, skip_embeddings: bool = False, skip_bm25: bool = False, skip_vectors: bool = False,
) -> Indexes:
    """Independent branches over the eligible chunks; each may be left out."""
    if skip_embeddings and not skip_vectors:
        raise ValueError("points need embeddings")
    judged = audit.with_eligibility(chunks, audit.collision_groups(pairs), index_collisions)
    eligible = judged.filter("reason IS NULL")
    embeddings = None if skip_embeddings else stored(vectors.generate(eligible, factory, provider, model, revision, normalize, cache), "embeddings")
    bm25 = None if skip_bm25 else lexical.build(eligible)
    points = None if skip_vectors else vectors.payload(eligible).join(embeddings.select("chunk_id", "embedding"), "chunk_id")
    return Indexes(judged, embeddings, bm25, points)


def write_indexes(indexes: Indexes, documents: DataFrame, path: str, config: dict) -> None:
    """Store what was built below a new folder, and with it the manifest (``config`` and the counts), what was
    skipped, and the place of every chunk in the word index."""
    x = indexes
    tables = {"skipped_chunks": audit.skipped_chunks(x.judged), "skipped_documents": audit.skipped_documents(documents, x.judged), "collision_documents": audit.collision_documents(x.judged)}
    if x.bm25 is not None:
        x.bm25.write(f"{path}/bm25")
        tables["bm25_chunks"] = audit.placed(x.judged.filter("reason IS NULL")).select("chunk_id", "position")
    if x.points is not None:
        tables["points"] = x.points
    for name, table in tables.items():
        table.write.mode("errorifexists").parquet(f"{path}/{name}")
    if x.embeddings is not None:
        sinks.write_embeddings(x.embeddings, f"{path}/embeddings")
    lexical_stats = None if x.bm25 is None else x.bm25.corpus_stats
    sinks.write_json(audit.index_manifest(x.judged, x.embeddings, lexical_stats, x.points, config), f"{path}/manifest")


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored table, or None if there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def revalidate(spark: SparkSession, path: str, chunks: DataFrame, pairs: DataFrame, source: dict | None = None, index_collisions: bool = False) -> DataFrame:
    """Findings, verdict included, on indexes that ``write_indexes`` stored, held against the chunks as they are
    now. Nothing is built again; a table that is gone counts as empty, and a word index that is gone is a finding."""
    judged = audit.with_eligibility(chunks, audit.collision_groups(pairs), index_collisions)
    manifest = sinks.read_json(spark, f"{path}/manifest").first().asDict()
    embeddings, lexical_rows, points = (_table(spark, f"{path}/{t}") for t in ("embeddings", "bm25_chunks", "points"))
    if embeddings is None:
        embeddings = spark.createDataFrame([], sinks.EMBEDDING)
    if points is None and manifest["vector_store_enabled"]:
        points = spark.createDataFrame([], "chunk_id string")
    meta = {"indexed_chunks": manifest.get("bm25_indexed_chunks")} if manifest["bm25_enabled"] else None
    eligible = audit.placed(judged.filter("reason IS NULL"))
    return audit.with_verdict(audit.index_findings(eligible, embeddings, manifest, lexical_rows, meta, points, source))


def retrieve(
    queries: DataFrame, texts: DataFrame, bm25: lexical.Bm25Index | None, points: DataFrame | None = None, query_vectors: DataFrame | None = None, mode: str = "both",
    bm25_k: int = lexical.TOP_K, dense_k: int = vectors.TOP_K, hybrid_k: int = fusion.TOP_K, rerank_k: int = fusion.RERANK_TOP_K, scorer=fusion.overlap_score, filters: dict | None = None,
) -> DataFrame:
    """Final hits of every query (query_id, query), with all scores.

    ``texts``: (id, text, document_name, section, page_start, page_end); a hit that it lacks stays, with nulls. ``scorer``: an expression of
    query and text; None passes the shortlist through, without a rerank score. The boost counts
    twice, before and after reranking, and where the query names a reference or act it decides
    the final order."""
    lists = {}
    if mode != "dense_only":
        lists["bm25"] = lexical.search(bm25, lexical.query_terms(queries), bm25_k)
    if mode != "bm25_only":
        lists["dense"] = vectors.search(points, query_vectors, dense_k, filters, key="id")
    hits = fusion.hybrid(lists.get("bm25"), lists.get("dense"), mode, hybrid_k)
    hits = hits.join(texts, "id", "left").join(queries.select("query_id", "query"), "query_id")
    first = fusion.reference_boost(hits, queries)
    if scorer is None:
        short = fusion.passthrough(first, rerank_k)
    else:
        short = fusion.rerank(first, scorer(F.col("query"), F.col("text")), rerank_k)
    return fusion.reference_boost(short.drop("boosted_score"), queries, times=2)


def answer(queries: DataFrame, hits: DataFrame, factory: Callable | None = None) -> DataFrame:
    """(query_id, answer, confidence, grounded): extractive, or by a user's generator."""
    pack = stored(evidence.evidence_pack(hits), "pack")  # read by the gate and by the answers
    return evidence.extractive_answer(queries, pack) if factory is None else evidence.answered(queries, pack, factory)


def analyzed(queries: DataFrame) -> DataFrame:
    return query_text.analyzed(queries)
