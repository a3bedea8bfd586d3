"""The registered queries of the library's own operators, over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codexlake import corpora
from codexlake.corpora import table
from codexlake.functions import metadata, query_text, text
from codexlake.operators import audit, chunking, evidence, fusion, lexical, quality, structure, vectors
from codexlake.plans import pipelines
from codexlake.sources.snapshots import Snapshots
from codexlake.sources.stage import shared_folder, stored

Query = Callable[[SparkSession, str], DataFrame]
BM25_K, DENSE_K, HYBRID_K, RERANK_K = 10, 10, 20, 5


def _r(c: str) -> Column:
    return F.round(c, 6).alias(c)


def content_hash(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", text.hash_parts(F.col("text")).alias("text_sha256"))


def _bm25(s: SparkSession, d: str, k: int = BM25_K) -> DataFrame:
    terms = lexical.query_terms(corpora.queries(s, d))
    hits = lexical.search(lexical.for_queries(table(s, d, "documents"), terms, "doc_id"), terms, k)
    return stored(hits, "hits")  # few rows, known to be few: what they are joined with is not shuffled


def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    return _bm25(s, d).select("query_id", "rank", F.col("id").alias("doc_id"), _r("score"))


def bm25_topk_all(s: SparkSession, d: str) -> DataFrame:
    """The library's own number of hits for each query, from the whole index as it was stored and loaded again."""
    path = f"{shared_folder(s).rstrip('/')}/bm25-{uuid.uuid4().hex}"
    lexical.build(table(s, d, "documents"), "doc_id").write(path)
    hits = lexical.search(lexical.Bm25Index.read(s, path), lexical.query_terms(corpora.queries(s, d)))
    return hits.select("query_id", "rank", F.col("id").alias("doc_id"), _r("score"))


def bm25_term_stats(s: SparkSession, d: str) -> DataFrame:
    return lexical.term_stats(table(s, d, "documents"), "doc_id").select("term", "df", _r("idf"))


def token_counts(s: SparkSession, d: str) -> DataFrame:
    x = lexical.tokenized(table(s, d, "documents"), "doc_id", drop_stop_words=True)
    return x.select(F.col("id").alias("doc_id"), F.col("dl").cast("long").alias("n_tokens"), F.size(F.array_distinct("tokens")).cast("long").alias("n_distinct"))


def _query_vectors(s: SparkSession, d: str) -> DataFrame:
    """Queries that grow with the table: every vector whose id is divisible by 50."""
    return table(s, d, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _dense(s: SparkSession, d: str, filters: dict | None = None) -> DataFrame:
    return vectors.search(table(s, d, "embeddings"), _query_vectors(s, d), DENSE_K, filters)


def dense_topk(s: SparkSession, d: str) -> DataFrame:
    return _dense(s, d).select("query_id", "rank", F.col("id").alias("vec_id"), _r("score"))


def dense_topk_all(s: SparkSession, d: str) -> DataFrame:
    """The library's own number of hits for each query, from an index of all vectors."""
    hits = vectors.search_index(vectors.build_index(table(s, d, "embeddings")), _query_vectors(s, d))
    return hits.select("query_id", "rank", F.col("id").alias("vec_id"), _r("score"))


def dense_topk_filtered(s: SparkSession, d: str) -> DataFrame:
    return _dense(s, d, {"label": [1, 3, 5]}).select("query_id", "rank", F.col("id").alias("vec_id"), _r("score"))


FUSED = ["query_id", "rank", "id", "bm25_rank", "dense_rank"]


def rrf_fusion(s: SparkSession, d: str) -> DataFrame:
    return fusion.hybrid(_bm25(s, d), _dense(s, d), "both", HYBRID_K).select(*FUSED, _r("hybrid_score")).withColumnRenamed("id", "doc_id")


def fusion_bm25_only(s: SparkSession, d: str) -> DataFrame:
    return fusion.hybrid(_bm25(s, d), None, "bm25_only", HYBRID_K).select(*FUSED, _r("hybrid_score")).withColumnRenamed("id", "doc_id")


def _all_queries(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "conversations").filter("role = 'user'")
    x = x.select((F.col("conv_id") * 100 + F.col("turn")).cast("long").alias("query_id"), F.col("text").alias("query")).distinct()
    return corpora.literal_queries(s).unionByName(x.withColumn("query_id", F.col("query_id") + 100_000))


def query_analysis(s: SparkSession, d: str) -> DataFrame:
    x = query_text.analyzed(_all_queries(s, d))
    return x.select("query_id", "normalized_query", F.array_join("legal_references", "|").alias("refs"), F.col("detected_document_type").alias("doc_type"), F.col("detected_domain").alias("domain"))


def metadata_filter(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "documents").select("doc_id").join(table(s, d, "labels"), "doc_id", "left")
    return fusion.filtered(x, {"quality": 1, "toxic": [0], "no such column": "x"}).select("doc_id", "quality", "toxic")


def _statute_hits(s: SparkSession, d: str) -> DataFrame:
    """BM25 hits of the statute queries among statute lines, with names and sections."""
    rows = stored(corpora.statute(s, d), "statutes")
    terms = lexical.query_terms(corpora.statute_queries(s, d))
    hits = lexical.search(lexical.for_queries(rows, terms, "line_id"), terms, HYBRID_K)
    about = rows.select(
        F.col("line_id").alias("id"), "text",
        F.when(F.col("line_id") % 3 == 0, "patents_act.pdf").when(F.col("line_id") % 3 == 1, "tk_guidelines.pdf").otherwise("biodiversity_rules.pdf").alias("document_name"),
        F.when(F.col("line_id") % 2 == 0, F.concat(F.lit("Section "), (F.col("line_id") % 20).cast("string"))).alias("section"),
    )
    return hits.withColumnRenamed("score", "hybrid_score").join(about, "id")


def reference_boost(s: SparkSession, d: str) -> DataFrame:
    x = fusion.reference_boost(_statute_hits(s, d), corpora.statute_queries(s, d))
    return x.select("query_id", "rank", F.col("id").alias("line_id"), _r("hybrid_score"), _r("boosted_score"))


def _pack(s: SparkSession, d: str) -> DataFrame:
    """Reranked hits of the benchmark queries, cited."""
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), "text", F.concat("source", F.lit(".txt")).alias("document_name"), F.col("lang").alias("section"), (F.col("doc_id") % 7).cast("int").alias("page_start"), (F.col("doc_id") % 7 + F.col("doc_id") % 2).cast("int").alias("page_end"))
    hits = _bm25(s, d).withColumnRenamed("score", "hybrid_score").join(docs, "id").join(corpora.queries(s, d), "query_id")
    return stored(evidence.evidence_pack(fusion.rerank(hits, fusion.overlap_score(F.col("query"), F.col("text")), RERANK_K)), "pack")


def rerank_overlap(s: SparkSession, d: str) -> DataFrame:
    return _pack(s, d).select("query_id", "rank", F.col("id").alias("doc_id"), _r("rerank_score"))


def rerank_passthrough(s: SparkSession, d: str) -> DataFrame:
    hits = _bm25(s, d).withColumnRenamed("score", "hybrid_score")
    return fusion.passthrough(hits, RERANK_K).select("query_id", "rank", F.col("id").alias("doc_id"), _r("hybrid_score"))


def _chunk_rows(s: SparkSession, d: str) -> DataFrame:
    """Documents as chunk rows, with sections here and there."""
    n = F.col("doc_id")
    none = F.lit(None).cast("string")
    page = lambda k: (n % 7 + k).cast("int")
    where = F.struct(
        F.concat(F.lit("p"), (n % 97).cast("string")).alias("relative_path"), page(0).alias("pdf_page_start"), page(1).alias("pdf_page_end"), none.cast("int").alias("printed_page_start"), page(3).alias("printed_page_end"),
        F.when(n % 3 == 0, "").when(n % 3 == 1, F.concat(F.lit("Section "), (n % 20).cast("string"))).alias("section"), none.alias("subsection"), F.when(n % 4 == 0, "Article 3").alias("article"), none.alias("chapter"),
        F.when(n % 9 == 0, "Rule 2").alias("rule"), none.alias("regulation"),
    )
    about = F.struct(F.lit("Act").alias("document_type"), none.alias("jurisdiction"), F.array(F.col("lang")).alias("legal_domains"), F.lit("of the metadata").alias("section"), none.alias("article"), F.col("source").alias("chapter"))
    return table(s, d, "documents").select(n.cast("string").alias("chunk_id"), F.col("source").alias("document_id"), F.lit("set").alias("dataset_id"), F.concat("source", F.lit(".txt")).alias("document_name"), "text", F.col("text").alias("embedding_text"), where.alias("provenance"), about.alias("metadata"), (n % 5 == 0).alias("content_collision"), F.when(n % 5 == 0, "g").alias("collision_group_id"))


def provenance(s: SparkSession, d: str) -> DataFrame:
    """The hits of the benchmark queries as retrieved chunks."""
    hits = _bm25(s, d).withColumn("id", F.col("id").cast("string"))
    x = fusion.projected(hits, _chunk_rows(s, d)).drop("text", "score")
    return x.withColumn("legal_domains", F.array_join("legal_domains", "|"))


def payloads(s: SparkSession, d: str) -> DataFrame:
    """What is stored with the vectors of all documents."""
    return vectors.payload(_chunk_rows(s, d)).drop("provenance").withColumns({"legal_domains": F.array_join("legal_domains", "|"), "text": text.hash_parts(F.col("text"))})


def evidence_pack(s: SparkSession, d: str) -> DataFrame:
    return _pack(s, d).select("query_id", "citation_id", F.col("id").alias("doc_id"), _r("hybrid_score"), _r("rerank_score"))


def _gate_queries(s: SparkSession, d: str) -> DataFrame:
    """The benchmark queries and some that find nothing."""
    return corpora.queries(s, d).unionByName(corpora.literal_queries(s))


def grounding_gate(s: SparkSession, d: str) -> DataFrame:
    return evidence.grounding(_gate_queries(s, d), _pack(s, d), min_score=0.9).select("query_id", _r("top_score"), "confidence", "grounded")


def extractive_answer(s: SparkSession, d: str) -> DataFrame:
    return evidence.extractive_answer(_gate_queries(s, d), _pack(s, d)).select("query_id", "answer", "confidence", "grounded")


def prompt_text(s: SparkSession, d: str) -> DataFrame:
    return evidence.prompt(_gate_queries(s, d), _pack(s, d))


def citation_cards(s: SparkSession, d: str) -> DataFrame:
    pack = _pack(s, d)
    none = F.lit(None).cast("string")
    cited = pack.select("query_id", "citation_id", "id", "document_name", "page_start", "page_end", "section", none.alias("article"), F.when(F.col("id") % 3 == 0, F.lit("CHAPTER I")).alias("chapter"), none.alias("rule"), none.alias("regulation"))
    return evidence.citation_cards(cited, pack.filter("id % 5 != 0"))


def response_state(s: SparkSession, d: str) -> DataFrame:
    pack = _pack(s, d)
    x = evidence.state(evidence.grounding(_gate_queries(s, d), pack, min_score=0.9), pack)
    return x.select("query_id", "tier", "score_label", F.array_join("documents", "|").alias("documents"))


def sanitized_texts(s: SparkSession, d: str) -> DataFrame:
    """Documents, every ninth of them with a failure's text, as they would be shown."""
    raw = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("LLM generation failed: <urlopen error> "), "text")).otherwise(F.col("text"))
    return table(s, d, "documents").select("doc_id", evidence.sanitized(raw).alias("shown"))


def _prose(s: SparkSession, d: str) -> DataFrame:
    """Prose pages, stored for queries that read them more than once."""
    return stored(corpora.prose(s, d), "prose")


def repeated_lines(s: SparkSession, d: str) -> DataFrame:
    return quality.repeated_lines(corpora.prose(s, d))


def page_profile(s: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    x = corpora.prose(s, d)
    return x.select("document_id", "page_index", F.length(c).cast("long").alias("n_chars"), text.word_count(c).cast("long").alias("n_words"), text.is_low_text(c).alias("low_text"), text.printed_page_number(c).alias("printed"))


def page_clean(s: SparkSession, d: str) -> DataFrame:
    x = pipelines.cleaned_pages(corpora.prose(s, d).select("document_id", "page_index", F.col("text").alias("raw_text")))
    return x.select("document_id", "page_index", "text", "page_text_sha256")


def dup_files(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select(text.hash_parts(F.col("text")).alias("source_sha256"), F.col("doc_id").cast("string").alias("relative_path"))
    x = quality.duplicate_file_members(docs)
    return x.select(F.col("source_sha256").alias("hash"), "n", "first_path", "relative_path")


def _flagged(s: SparkSession, d: str, flag: str) -> DataFrame:
    x = quality.with_duplicate_flags(_prose(s, d)).filter(flag)
    return x.select("document_id", "page_index", F.col("page_text_sha256").alias("hash"))


def dup_pages_within(s: SparkSession, d: str) -> DataFrame:
    return _flagged(s, d, "duplicate_within_document")


def dup_pages_across(s: SparkSession, d: str) -> DataFrame:
    return _flagged(s, d, "duplicate_across_documents")


def doc_page_classes(s: SparkSession, d: str) -> DataFrame:
    return quality.page_classes(corpora.prose(s, d))


def doc_collisions(s: SparkSession, d: str) -> DataFrame:
    pages = _prose(s, d)
    x = quality.document_collisions(pages).unionByName(quality.copies(pages))
    return x.select("left_id", "right_id", "shared", _r("overlap"))


def dup_chunks(s: SparkSession, d: str) -> DataFrame:
    return quality.duplicated_chunks(corpora.prose(s, d), "page_text_sha256")


def _checked(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Prose documents with planted defects, by doc_id: page counts off, pages and chunks missing."""
    pages = _prose(s, d).withColumn("doc_id", F.regexp_extract("relative_path", r"(\d+)\.txt$", 1).cast("long"))
    docs = pages.groupBy("document_id", "relative_path", "doc_id").agg(F.count("*").alias("n"))
    docs = docs.withColumn("page_count", F.when(F.col("doc_id") % 11 == 0, F.col("n") + 1).otherwise(F.col("n")))
    docs = docs.withColumns({"filename": F.concat(F.col("doc_id").cast("string"), F.lit(".txt")), "dataset_id": metadata.collection(F.col("relative_path")), "source_sha256": F.sha2("relative_path", 256)})
    pages = pages.withColumn("ocr_used", F.col("doc_id") % 6 == 0)
    failed = (F.col("doc_id") % 13 == 0) & (F.col("page_index") == 0)
    pages = pages.filter("NOT (doc_id % 17 = 0 AND page_index = 0)").withColumn("extraction_failed", failed).withColumn("text", F.when(failed, "").otherwise(F.col("text")))
    chunks = pages.filter("doc_id % 19 != 0").select("document_id", F.col("page_index").alias("chunk_index"), (text.word_count(F.col("text")) * 5).alias("token_count"))
    return docs, pages, chunks, quality.document_findings(docs, pages, chunks)


def document_findings(s: SparkSession, d: str) -> DataFrame:
    return _checked(s, d)[3].select("severity", "code", "message", "document_id")


def severity_counts(s: SparkSession, d: str) -> DataFrame:
    return quality.severity_counts(_checked(s, d)[3])


def doc_status(s: SparkSession, d: str) -> DataFrame:
    docs, _, _, found = _checked(s, d)
    return quality.document_status(docs, found)


def manifest_totals(s: SparkSession, d: str) -> DataFrame:
    docs, pages, chunks, found = _checked(s, d)
    return quality.manifest(docs, pages, chunks, found)


def manifest_documents(s: SparkSession, d: str) -> DataFrame:
    docs, _, chunks, found = _checked(s, d)
    return quality.manifest_documents(docs, chunks, found)


def line_classes(s: SparkSession, d: str) -> DataFrame:
    return structure.classified(corpora.statute(s, d)).select("document_id", F.col("line_no").cast("long").alias("line_no"), "key", "value")


CONTEXT = ("chapter", "section", "subsection", "clause", "proviso", "article")


def structure_context(s: SparkSession, d: str) -> DataFrame:
    x = structure.with_context(corpora.statute(s, d), ["line_no"])
    return x.select("document_id", F.col("line_no").cast("long").alias("line_no"), *[F.col(f"structure.{k}").alias(k) for k in CONTEXT])


#: What the first lines of a case may say; a document has one of each of these, by its number.
CASE_HEADS = (
    ("Asha Devi v. State of Kerala", "Ram & Sons vs. Union", "no parties here", "In re a petition"),
    ("Civil Appeal No. 12 of 1999", "heard in Writ Petition No. 7/2001", "no number", "Suit No 3"),
    ("Supreme Court of India", "in the High Court of Madras", "a tribunal", "Court of Appeal"),
)


def case_heads(s: SparkSession, d: str) -> DataFrame:
    """The context at the end of every document, whose first lines are a case's head and whose last is another's."""
    x = table(s, d, "documents").select("doc_id", text.lines(F.col("text")).alias("l"))
    pick = lambda k, of: F.element_at(F.array(*map(F.lit, of)), (F.floor(F.col("doc_id") / 4**k) % 4).cast("int") + 1)
    head = F.array(*[pick(k, of) for k, of in enumerate(CASE_HEADS)])
    rows = x.select(F.col("doc_id").alias("document_id"), F.posexplode(F.concat(head, F.slice("l", 1, 3), F.array(F.lit("Other v. Another"), F.lit("Suit No. 99"), F.lit("Court of Late")))).alias("line_no", "text"))
    last = structure.with_context(rows, ["line_no"]).groupBy("document_id").agg(F.max_by("structure", "line_no").alias("s"))
    return last.select(F.col("document_id").alias("doc_id"), *[F.col(f"s.{k}").alias(k) for k in structure.STICKY])


def page_structure(s: SparkSession, d: str) -> DataFrame:
    """The context at the end of each page of statute lines."""
    x = corpora.statute(s, d).withColumn("page_index", F.floor((F.col("line_no") - 1) / corpora.STATUTE_PAGE).cast("int"))
    rows = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    pages = x.groupBy("document_id", "page_index").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("text"))
    return structure.page_structure(pages).select("document_id", "page_index", *[F.col(f"structure.{k}").alias(k) for k in CONTEXT])


def page_counts(s: SparkSession, d: str) -> DataFrame:
    return quality.page_counts(quality.with_duplicate_flags(_prose(s, d)))


def page_findings(s: SparkSession, d: str) -> DataFrame:
    x = corpora.prose(s, d)
    return quality.page_findings(x.withColumns({"raw_text": F.col("text"), "extraction_failed": F.lit(False), "failure_reason": F.lit(None).cast("string")})).select("severity", "code", "document_id", "page_index")


def manifest_hashes(s: SparkSession, d: str) -> DataFrame:
    """The hash of each source's manifest text; every third source has none."""
    x = table(s, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    text_ = F.when(F.length("source") % 3 != 0, F.concat("source", F.lit(":"), F.col("n").cast("string")))
    return x.select("source", audit.manifest_hash(text_).alias("manifest_hash"))


def structural_blocks(s: SparkSession, d: str) -> DataFrame:
    pages = corpora.statute(s, d).select("document_id", F.col("line_no").alias("page_index"), F.lit(None).cast("int").alias("printed_page_number"), "text")
    x = structure.structural_blocks(pages)
    return x.select("document_id", "block_no", "n_paras", F.col("structure.section").alias("section"), text.hash_parts(F.col("text")).alias("text_sha256"))


def doc_metadata(s: SparkSession, d: str) -> DataFrame:
    """Metadata of prose documents, each with a phrase of its own added by doc_id."""
    x = table(s, d, "documents")
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("doc_id") % len(PHRASES)).cast("int") + 1)
    place = F.element_at(F.array(*map(F.lit, (*metadata.COLLECTIONS, "Other"))), (F.col("doc_id") % (len(metadata.COLLECTIONS) + 1)).cast("int") + 1)
    files = x.select("doc_id", F.concat(place, F.lit("/file_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("relative_path"), F.concat(F.lit("x\n"), phrase, F.lit("\n"), "text").alias("first_pages_text"))
    y = metadata.described(files)
    return y.select("doc_id", "document_id", "title", "document_type", "jurisdiction", "authority", F.array_join("legal_domains", "|").alias("domains"), "language")


#: Second lines of the documents of doc_metadata.
PHRASES = (
    "The Patents Act, 1970", "Trade Marks (Amendment Act) text", "Gazette of India notification", "WIPO GRATK treaty on genetic resources", "Manual of practice and procedure",
    "In the court of appeal, judgment", "Guidelines for traditional knowledge", "Convention on Biological Diversity", "Case studies in brief", "Some plain words here", "Drugs and Cosmetics Rules",
)


def _ingested(s: SparkSession, d: str) -> pipelines.Ingested:
    return pipelines.ingest(*corpora.statute_files(s, d), size=60, overlap=12)


def chunks(s: SparkSession, d: str) -> DataFrame:
    x = _ingested(s, d).chunks
    return x.select("chunk_id", "document_id", "chunk_index", "token_count", "character_count", "text", "provenance.pdf_page_start", "provenance.pdf_page_end", "provenance.section", "provenance.chapter")


def chunk_rollup(s: SparkSession, d: str) -> DataFrame:
    x = _ingested(s, d)
    return chunking.rollup(x.pages, x.chunks)


def ingest_findings(s: SparkSession, d: str) -> DataFrame:
    return _ingested(s, d).findings


def ingest_reuse(s: SparkSession, d: str) -> DataFrame:
    """What a second run on stored statutes does, and how each document stands after it: some files changed, some of these cannot be
    read, some are gone, some are new."""
    files, raw = corpora.statute_files(s, d)
    n = F.regexp_extract("relative_path", r"_(\d+)_act_", 1).cast("int")
    changed, broken = n % 3 == 0, n % 6 == 3
    store = Snapshots(s, f"{shared_folder(s).rstrip('/')}/corpus-{uuid.uuid4().hex}", "document_id", 8)
    pipelines.ingest_again(files.filter(n % 5 != 1), raw.filter(n % 5 != 1), store, size=60, overlap=12)
    files = files.filter(n % 5 != 4).withColumn("source_sha256", F.when(changed, F.sha2(F.concat("source_sha256", F.lit("+")), 256)).otherwise(F.col("source_sha256")))
    raw = raw.filter(n % 5 != 4).withColumn("raw_text", F.when(changed, F.concat("raw_text", F.lit(" anew"))).otherwise(F.col("raw_text")))
    raw = raw.withColumn("error", F.when(broken & (F.col("page_index") == 0), "not readable"))
    x = pipelines.ingest_again(files, raw, store, size=60, overlap=12)
    told = x.corpus.findings.filter("document_id IS NOT NULL").groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_set("code")), "|").alias("codes"))
    listed = quality.manifest_documents(x.corpus.documents, x.corpus.chunks, x.corpus.findings).select("document_id", F.col("page_count").cast("long").alias("page_count"), "validation_status")
    return x.actions.join(listed, "document_id", "left").join(told, "document_id", "left")


def embedding_text(s: SparkSession, d: str) -> DataFrame:
    x = structure.with_context(corpora.statute(s, d), ["line_no"])
    fields = {"title": F.col("document_id"), "document_type": F.lit("Statute"), "jurisdiction": F.lit("")} | {k: F.col(f"structure.{k}") for k in ("chapter", "section", "article")}
    return x.select(F.col("line_id").alias("chunk_id"), text.hash_parts(text.embedding_text(fields, F.col("text"))).alias("embedding_text_sha256"))


def _versions(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents now, and as a previous run had them: some gone, some since changed, some new."""
    x = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "doc_id", text.hash_parts(F.col("text")).alias("source_sha256"), F.lit("1").alias("processor_version"), F.lit(600).alias("chunk_size"), F.lit(80).alias("chunk_overlap"))
    new = x.filter("doc_id % 29 != 0")
    old = x.filter("doc_id % 5 != 0").withColumn("source_sha256", F.when(F.col("doc_id") % 7 == 0, "changed").otherwise(F.col("source_sha256")))
    return new, old


def incremental_plan(s: SparkSession, d: str) -> DataFrame:
    return quality.incremental_plan(*_versions(s, d)).select(F.col("document_id").alias("key"), "action")


def embed_cache_plan(s: SparkSession, d: str) -> DataFrame:
    new, old = (x.select(F.col("document_id").alias("chunk_id"), text.embedding_cache_key(F.col("document_id"), F.col("source_sha256"), F.lit("hash"), F.lit("hash-16"), F.lit(None), F.lit(True)).alias("cache_key")) for x in _versions(s, d))
    return vectors.cache_plan(new, old).select(F.col("chunk_id").alias("key"), "action")


def embedding_reuse(s: SparkSession, d: str) -> DataFrame:
    """Embeddings of the documents, with a cache of an earlier version's: of other models, lengths and texts, and records written twice."""
    rows = table(s, d, "documents").filter("doc_id % 29 != 0").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("embedding_text"), "doc_id")
    made = stored(vectors.generate(rows, vectors.make_embedder("hash", "hash-8"), "hash", "hash-8", "deterministic", True), "embeddings")
    old = made.filter("CAST(chunk_id AS LONG) % 5 != 0").withColumns({"doc_id": F.col("chunk_id").cast("long"), "written": F.lit(1)})
    spoilt = lambda k, name, value: F.when(F.col("doc_id") % k == 0, value).otherwise(F.col(name))
    old = old.withColumns({
        "embedding_model": spoilt(7, "embedding_model", F.lit("other")), "embedding": spoilt(11, "embedding", F.slice("embedding", 1, 7)), "normalized": spoilt(13, "normalized", F.lit(False)),
        "embedding_input_sha256": spoilt(17, "embedding_input_sha256", F.lit("stale")), "indexing_version": spoilt(19, "indexing_version", F.lit("0")),
    })
    again = old.filter("doc_id % 3 = 0").withColumns({"written": F.lit(2), "model_revision": F.when(F.col("doc_id") % 2 == 0, "late").otherwise(F.col("model_revision"))})
    x = vectors.generate(rows, vectors.make_embedder("hash", "hash-8"), "hash", "hash-8", "deterministic", True, old.unionByName(again), order="written")
    return x.select(F.col("chunk_id").alias("key"), "cached", "embedding_input_sha256", F.size("embedding").alias("n"))


def vector_sync(s: SparkSession, d: str) -> DataFrame:
    """The stored points after two runs, and what the second did."""
    new, old = _versions(s, d)
    points = lambda x: x.select(F.col("document_id").alias("point_id"), F.col("source_sha256").alias("content_hash"), "doc_id")
    store = Snapshots(s, f"{shared_folder(s).rstrip('/')}/points-{uuid.uuid4().hex}", "point_id", 32)
    vectors.sync(points(old), store)
    plan = vectors.sync(points(new), store)
    return plan.join(store.current()["points"], "point_id", "full_outer").select(F.col("point_id").alias("key"), "action", "content_hash")


def vector_sync_plan(s: SparkSession, d: str) -> DataFrame:
    new, old = (x.select(F.col("document_id").alias("point_id"), F.col("source_sha256").alias("content_hash")) for x in _versions(s, d))
    return vectors.sync_plan(old, new).select(F.col("point_id").alias("key"), "action")


def point_ids(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", text.point_id(F.col("doc_id").cast("string")).alias("point_id"))


def _judged(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    x = table(s, d, "documents").select("doc_id", F.col("source").alias("document_id"), F.col("doc_id").cast("string").alias("chunk_id"), F.struct(F.concat(F.lit("p"), (F.col("doc_id") % 97).cast("string")).alias("relative_path")).alias("provenance"), F.when(F.col("doc_id") % 23 == 0, " ").otherwise(F.col("text")).alias("text"), F.col("text").alias("embedding_text"))
    x = x.withColumn("text", F.when(F.col("document_id") == "src2", "").otherwise(F.col("text")))
    pairs = s.range(1).select(F.explode(F.array(*[F.struct(F.lit(a).alias("left_path"), F.lit(b).alias("right_path")) for a, b in (("p3", "p5"), ("p7", "p5"))])).alias("p")).select("p.*")
    docs = table(s, d, "documents").select(F.col("source").alias("document_id")).distinct().union(s.range(1).select(F.lit("no chunks")))
    return docs, audit.with_eligibility(x, audit.collision_groups(pairs))


def eligible_chunks(s: SparkSession, d: str) -> DataFrame:
    return _judged(s, d)[1].select("chunk_id", "content_collision", "collision_group_id", "reason")


def skipped_documents(s: SparkSession, d: str) -> DataFrame:
    return audit.skipped_documents(*_judged(s, d))


def index_validation(s: SparkSession, d: str) -> DataFrame:
    """Findings on an index of all documents, with defects planted by doc_id."""
    x = table(s, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("chunk_id"), "text", F.col("doc_id").alias("position"))
    page = F.when(F.col("doc_id") % 41 != 0, F.lit(0))
    rows = x.select("chunk_id", "position", F.when(F.col("doc_id") % 31 == 0, "").otherwise(F.col("text")).alias("text"), F.col("text").alias("embedding_text"), F.struct(F.lit("a.pdf").alias("relative_path"), page.alias("pdf_page_start"), page.alias("pdf_page_end")).alias("provenance"))
    bad = F.when(F.col("doc_id") % 43 == 0, F.lit(float("nan"))).otherwise(F.lit(1.0))
    made = x.filter("doc_id % 37 != 0").select(
        "chunk_id", F.array(bad, F.lit(0.5)).alias("embedding"), F.when(F.col("doc_id") % 47 == 0, 3).otherwise(2).alias("embedding_dimension"), F.lit("hash").alias("embedding_provider"),
        F.when(F.col("doc_id") % 53 == 0, "other").otherwise("hash-2").alias("embedding_model"), F.lit("r1").alias("model_revision"), F.lit(True).alias("normalized"),
        F.when(F.col("doc_id") % 59 == 0, "stale").otherwise(text.hash_parts(F.col("text"))).alias("embedding_input_sha256"),
    )
    manifest = {"embedding_dimension": 2, "embedding_provider": "hash", "embedding_model": "hash-2", "embedding_model_revision": "r1", "embedding_normalize": True, "corpus_id": "corpus", "vector_store_enabled": True, "source_corpus_manifest_hash": "a"}
    lexical_rows = x.select("chunk_id", F.when(F.col("position") < 2, 1 - F.col("position")).otherwise(F.col("position")).alias("position"))
    points = x.select(F.when(F.col("doc_id") % 61 == 0, F.lit(None).cast("string")).when(F.col("doc_id") % 67 == 0, F.concat(F.lit("x"), "chunk_id")).otherwise(F.col("chunk_id")).alias("chunk_id"))
    found = audit.index_findings(rows, made, manifest, lexical_rows, {"indexed_chunks": -5}, points, {"corpus_id": "corpus", "manifest_hash": "b"})
    return audit.with_verdict(found).select("severity", "code", F.coalesce("chunk_id", F.lit("")).alias("key"))


INDEX_CONFIG = {"corpus_id": "corpus", "source_corpus_manifest_hash": "a", "embedding_provider": "hash", "embedding_model": "hash-16", "embedding_model_revision": "deterministic", "embedding_normalize": True}


def _stored_indexes(s: SparkSession, d: str) -> tuple[str, DataFrame, DataFrame]:
    """Where the indexes of all ingested chunks are stored, the chunks, and the pairs: one document is another's copy."""
    x = _ingested(s, d)
    pairs = s.range(1).select(F.lit("Dataset_1/statute_1_act_.pdf").alias("left_path"), F.lit("elsewhere.pdf").alias("right_path"))
    c = INDEX_CONFIG
    built = pipelines.build_indexes(x.chunks, pairs, vectors.make_embedder("hash", c["embedding_model"]), "hash", c["embedding_model"], c["embedding_model_revision"])
    path = f"{shared_folder(s).rstrip('/')}/indexes-{uuid.uuid4().hex}"
    pipelines.write_indexes(built, x.documents, path, c)
    return path, x.chunks, pairs


def index_manifest(s: SparkSession, d: str) -> DataFrame:
    return s.read.json(f"{_stored_indexes(s, d)[0]}/manifest")


def index_revalidation(s: SparkSession, d: str) -> DataFrame:
    """Findings on stored indexes after chunks of every other document have changed, and with them the corpus."""
    path, chunks, pairs = _stored_indexes(s, d)
    changed = F.when(F.xxhash64("document_id") % 2 == 0, F.concat("embedding_text", F.lit(" anew"))).otherwise(F.col("embedding_text"))
    found = pipelines.revalidate(s, path, chunks.withColumn("embedding_text", changed), pairs, {"corpus_id": "corpus", "manifest_hash": "b"})
    return found.select("severity", "code", F.coalesce("chunk_id", F.lit("")).alias("key"))


def hash_embeddings(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("embedding_text"))
    return vectors.embedded(rows, vectors.make_embedder("hash", "hash-8")).select(F.col("chunk_id").alias("doc_id"), "embedding")


def _texts(s: SparkSession, d: str) -> DataFrame:
    return corpora.statute(s, d).select(F.col("line_id").alias("id"), "text", F.concat(F.translate("document_id", " ", "_"), F.lit("_patents_act.pdf")).alias("document_name"), F.lit(None).cast("string").alias("section"), F.col("line_no").alias("page_start"), F.col("line_no").alias("page_end"))


def _retrieved(s: SparkSession, d: str) -> DataFrame:
    qs, rows = stored(corpora.statute_queries(s, d), "asked"), stored(_texts(s, d), "texts")
    index = lexical.for_queries(rows, lexical.query_terms(qs), "id")
    make = vectors.make_embedder("hash", "hash-16")
    points = stored(vectors.embedded_once(rows, make, "id", "text"), "points")
    asked = stored(vectors.embedded_once(qs, make, "query_id", "query"), "asked-vectors")
    return pipelines.retrieve(qs, rows, index, points, asked)


def retrieve_bundle(s: SparkSession, d: str) -> DataFrame:
    return _retrieved(s, d).select("query_id", "rank", F.col("id").alias("line_id"), "bm25_rank", "dense_rank", _r("hybrid_score"), _r("rerank_score"), _r("boosted_score"))


def answer_batch(s: SparkSession, d: str) -> DataFrame:
    return pipelines.answer(corpora.statute_queries(s, d), _retrieved(s, d))


def queries() -> dict[str, Query]:
    own = (
        bm25_topk, bm25_topk_all, bm25_term_stats, content_hash, token_counts, dense_topk, dense_topk_all, dense_topk_filtered, rrf_fusion, fusion_bm25_only, query_analysis, metadata_filter,
        reference_boost, rerank_overlap, rerank_passthrough, evidence_pack, grounding_gate, extractive_answer, prompt_text, citation_cards, response_state, sanitized_texts,
        repeated_lines, page_profile, page_clean, dup_files, dup_pages_within, dup_pages_across, doc_page_classes, doc_collisions, dup_chunks, document_findings,
        severity_counts, doc_status, manifest_totals, page_counts, page_findings, manifest_hashes, line_classes, structure_context, page_structure, structural_blocks, doc_metadata, chunks, chunk_rollup, ingest_findings, embedding_text,
        ingest_reuse, manifest_documents, case_heads, provenance, payloads, embedding_reuse, vector_sync,
        incremental_plan, embed_cache_plan, vector_sync_plan, point_ids, eligible_chunks, skipped_documents, index_validation, index_manifest, index_revalidation, hash_embeddings, retrieve_bundle, answer_batch,
    )
    return {f.__name__: f for f in own}
