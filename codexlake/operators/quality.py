"""Findings about documents, pages and chunks, and what follows from them.

A finding is a row (severity, code, message, document_id, relative_path, page_index); a report is
a union of findings. No pairwise loop: documents that share pages meet on page hashes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from codexlake.functions.text import filled_lines, head_and_tail, is_blank, is_low_text
from codexlake.operators.joins import split_join
from codexlake.sources.stage import stored

CRITICAL, WARNING, INFO = "CRITICAL", "WARNING", "INFO"
#: Repeated marginal lines.
MARGIN, MIN_PAGES, MIN_TIMES, PAGE_SHARE, MAX_CHARS = 3, 4, 3, 0.45, 140
KEPT_WORDS = r"(?iU)\b(section|article|rule|chapter)\b"
#: Documents collide from this share of common pages on; a longer chunk is oversize.
COLLISION_PERCENT = 80
MAX_CHUNK_TOKENS = 900


def finding(severity: str, code: str, message: Column, document: str | None = "document_id", path: str | None = "relative_path", page: str | None = None) -> list[Column]:
    pick = lambda c, kind: F.col(c).cast(kind) if c else F.lit(None).cast(kind)
    return [
        F.lit(severity).alias("severity"), F.lit(code).alias("code"), message.alias("message"),
        pick(document, "string").alias("document_id"), pick(path, "string").alias("relative_path"), pick(page, "int").alias("page_index"),
    ]


def all_of(*findings: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, findings)


def repeated_lines(pages: DataFrame, text: str = "text") -> DataFrame:
    """(document_id, line, n): lines that stand at the top or bottom of many of a document's pages."""
    filled = pages.select("document_id", filled_lines(F.col(text)).alias("l"))
    # outer, as Spark would else filter on the array's size first and for that make it again
    at_edge = filled.select("document_id", F.explode_outer(head_and_tail(F.col("l"), MARGIN)).alias("line")).filter("line IS NOT NULL")
    n = at_edge.groupBy("document_id", "line").agg(F.count("*").alias("n"))
    size = pages.groupBy("document_id").agg(F.count("*").alias("pages")).filter(F.col("pages") >= MIN_PAGES)
    often = F.col("n") >= F.greatest(F.lit(MIN_TIMES), F.floor(F.col("pages") * PAGE_SHARE))
    return n.join(size, "document_id").filter(often & (F.length("line") <= MAX_CHARS) & ~F.col("line").rlike(KEPT_WORDS)).select("document_id", "line", "n")


def page_findings(pages: DataFrame) -> DataFrame:
    """Pages (document_id, relative_path, page_index, raw_text, text, extraction_failed, failure_reason)."""
    number = (F.col("page_index") + 1).cast("string")
    say = lambda a, b="": F.concat(F.lit(f"{a} "), number, F.lit(b))
    ok = ~F.coalesce(F.col("extraction_failed"), F.lit(False))
    return all_of(
        pages.filter(ok & is_low_text(F.coalesce("raw_text", F.lit("")))).select(*finding(WARNING, "OCR_NEEDED_BUT_DISABLED", say("Too little text was read from page", ", and no OCR is set up"), page="page_index")),
        pages.filter(~ok).select(*finding(CRITICAL, "PAGE_EXTRACTION_FAILED", F.concat(say("No text could be read from page", ": "), F.coalesce("failure_reason", F.lit(""))), page="page_index")),
        pages.filter(is_blank(F.col("text"))).select(*finding(WARNING, "EMPTY_PAGE_TEXT", say("Nothing but blanks on page"), page="page_index")),
    )


def document_findings(documents: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Counts, order and emptiness of each document's pages and chunks."""
    p = pages.groupBy("document_id").agg(
        F.count("*").alias("n"), F.countDistinct("page_index").alias("d"), F.min("page_index").alias("lo"), F.max("page_index").alias("hi"),
        F.count_if(is_blank(F.col("text"))).alias("empty"), F.count_if(F.col("extraction_failed")).alias("failed"),
    )
    c = chunks.groupBy("document_id").agg(F.count("*").alias("chunks"))
    x = documents.select("document_id", "relative_path", "page_count").join(p, "document_id", "left").join(c, "document_id", "left")
    x = x.na.fill(0, ["n", "empty", "failed", "chunks"])
    rel = F.col("relative_path")
    say = lambda *parts: F.concat(rel, F.lit(": "), *[q if isinstance(q, Column) else F.lit(q) for q in parts])
    gap = (F.col("n") > 0) & ((F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1) | (F.col("d") != F.col("n")))
    long = chunks.filter(F.col("token_count") > MAX_CHUNK_TOKENS).join(documents.select("document_id", "relative_path"), "document_id")
    count = lambda c: F.col(c).cast("string")
    # one row of counts says all of a document: were each code a branch of a union, each would join the counts again, all in one task
    told = [
        (F.col("page_count") != F.col("n"), finding(CRITICAL, "PAGE_COUNT_MISMATCH", say("the file's number of pages is not that of the pages read"))),
        (gap, finding(CRITICAL, "PAGE_SEQUENCE_GAP", say("pages are missing or out of order"))),
        (F.col("empty") > 0, finding(WARNING, "EMPTY_PAGES", say(count("empty"), " blank pages"))),
        (F.col("failed") > 0, finding(CRITICAL, "FAILED_PAGES", say(count("failed"), " pages could not be read"))),
        ((F.col("chunks") == 0) & (F.col("n") > 0), finding(CRITICAL, "NO_CHUNKS", say("nothing was cut into chunks"))),
    ]
    own = x.select(F.explode(F.array_compact(F.array(*[F.when(c, F.struct(*f)) for c, f in told]))).alias("f")).select("f.*")
    return own.unionByName(long.select(*finding(WARNING, "OVERSIZE_CHUNK", say(count("token_count"), " words in chunk ", count("chunk_index")))))


def duplicate_files(documents: DataFrame) -> DataFrame:
    """(source_sha256, n, first_path): contents that several files have. A content may have any number
    of files, so they are counted and not gathered; ``duplicate_file_members`` lists them."""
    return documents.groupBy("source_sha256").agg(F.count("*").alias("n"), F.min("relative_path").alias("first_path")).filter("n > 1")


def duplicate_file_members(documents: DataFrame) -> DataFrame:
    """(source_sha256, n, first_path, relative_path): a row for each file whose content others have too."""
    return documents.select("source_sha256", "relative_path").join(duplicate_files(documents), "source_sha256")


def with_duplicate_flags(pages: DataFrame, hash_: str = "page_text_sha256") -> DataFrame:
    """The pages with duplicate_within_document and duplicate_across_documents; blank ones never are.

    Pages of one text may be many (a common blank form, say), so hashes are counted in a partial aggregate
    and joined back, not gathered."""
    real = pages.filter(~is_blank(F.col("text")))
    within = real.groupBy("document_id", hash_).agg((F.count("*") > 1).alias("duplicate_within_document"))
    across = within.groupBy(hash_).agg((F.count("*") > 1).alias("duplicate_across_documents"))
    flags = within.join(across, hash_)
    out = pages.join(flags, ["document_id", hash_], "left")
    blank = is_blank(F.col("text"))
    return out.withColumns({c: ~blank & F.coalesce(F.col(c), F.lit(False)) for c in ("duplicate_within_document", "duplicate_across_documents")})


def page_classes(pages: DataFrame, hash_: str = "page_text_sha256") -> DataFrame:
    """(document_id, class_id, n_pages): documents with just the same set of pages are one class,
    named after its least document. Documents without a filled page are in none."""
    sets = pages.filter(~is_blank(F.col("text"))).groupBy("document_id").agg(F.array_sort(F.collect_set(hash_)).alias("set"))
    sets = sets.select("document_id", F.sha2(F.array_join("set", ""), 256).alias("set"), F.size("set").cast("long").alias("n_pages"))
    names = sets.groupBy("set").agg(F.min("document_id").alias("class_id"))
    return sets.join(names, "set").select("document_id", "class_id", "n_pages")


def document_collisions(pages: DataFrame, percent: int = COLLISION_PERCENT, hash_: str = "page_text_sha256") -> DataFrame:
    """(left_id, right_id, shared, overlap): pairs of classes, each by its least document, that share
    enough of the smaller one's pages. Copies of a document are not paired with each other;
    ``page_classes`` has them.

    To share enough, two classes must share one of the rarest pages of the smaller: of n, all but as many as
    may be missing, and one more. Only these look for partners, so a page that a third of all
    documents have makes no pairs unless they have little else; and counting them is exact."""
    member = page_classes(pages, hash_)
    own = member.filter("document_id = class_id").select("document_id", "n_pages")
    sets = pages.filter(~is_blank(F.col("text"))).join(own, "document_id").select(F.col("document_id").alias("id"), F.col("n_pages").alias("n"), F.col(hash_).alias("h")).distinct()
    sets = stored(sets, "page-sets")
    often = sets.groupBy("h").agg(F.count("*").alias("f"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("f", "h"))
    need = F.ceil(F.col("n") * percent / 100)
    rare = sets.join(often, "h").withColumn("k", rank).filter(F.col("k") <= F.col("n") - need + 1)
    first = rare.select("h", F.col("id").alias("a"), F.col("n").alias("an"))
    other = sets.select("h", F.col("id").alias("b"), F.col("n").alias("bn"))
    # a page may be in very many documents, and a document similar to very many
    pairs = split_join(other, first, "h", "b").filter((F.col("a") != F.col("b")) & (F.col("an") <= F.col("bn"))).select("a", "an", "b").distinct()
    both = split_join(stored(pairs, "page-pairs"), sets.select(F.col("id").alias("a"), "h"), "a", "b").join(sets.select(F.col("id").alias("b"), "h"), ["b", "h"])
    shared = both.groupBy("a", "an", "b").agg(F.count("*").alias("shared")).filter(F.col("shared") * 100 >= percent * F.col("an"))
    out = shared.select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"), "shared", (F.col("shared") / F.col("an")).alias("overlap"))
    return out.distinct()


def copies(pages: DataFrame, hash_: str = "page_text_sha256") -> DataFrame:
    """(left_id, right_id, shared, overlap): each copy with the least document of its class."""
    x = page_classes(pages, hash_).filter("document_id != class_id")
    return x.select(F.col("class_id").alias("left_id"), F.col("document_id").alias("right_id"), F.col("n_pages").alias("shared"), F.lit(1.0).alias("overlap"))


def duplicated_chunks(chunks: DataFrame, hash_: str = "chunk_text_sha256") -> DataFrame:
    """One row: how many chunk texts occur more than once."""
    return chunks.groupBy(hash_).count().filter("count > 1").agg(F.count("*").alias("n_duplicated_hashes"))


def duplicate_findings(documents: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files, pages, documents and chunks that occur twice. A copy collides with the least of its class."""
    paths = documents.select("document_id", "relative_path")
    real = pages.filter(~is_blank(F.col("text"))).groupBy("document_id", "page_text_sha256").agg(F.count("*").alias("n")).filter("n > 1").join(paths, "document_id")
    pairs = document_collisions(pages).unionByName(copies(pages)).drop("shared")
    for side in ("left", "right"):
        pairs = pairs.join(paths.select(F.col("document_id").alias(f"{side}_id"), F.col("relative_path").alias(f"{side}_path")), f"{side}_id")
    percent = F.concat(F.round(F.col("overlap") * 100).cast("int").cast("string"), F.lit("%"))
    return all_of(
        duplicate_files(documents).select(*finding(WARNING, "DUPLICATE_PDF_FILE", F.concat(F.col("n").cast("string"), F.lit(" files have the content of "), F.col("first_path")), None, None)),
        real.select(*finding(WARNING, "DUPLICATE_PAGE_WITHIN_DOCUMENT", F.concat(F.col("relative_path"), F.lit(": "), F.col("n").cast("string"), F.lit(" pages of one text")))),
        pairs.select(*finding(CRITICAL, "CRITICAL_DOCUMENT_CONTENT_COLLISION", F.concat(percent, F.lit(" of the pages are the same in "), "left_path", F.lit(" and "), "right_path"), None, None)),
        duplicated_chunks(chunks.select("hashes.chunk_text_sha256")).filter("n_duplicated_hashes > 0").select(*finding(WARNING, "DUPLICATE_CHUNKS", F.concat(F.col("n_duplicated_hashes").cast("string"), F.lit(" texts are those of several chunks")), None, None)),
    )


def status(severity: Column) -> Column:
    """The aggregate status of findings' severities."""
    worst = F.max(F.when(severity == CRITICAL, 2).when(severity == WARNING, 1).otherwise(0))
    return F.when(worst == 2, F.lit("FAILED")).when(worst == 1, F.lit("PASS_WITH_WARNINGS")).otherwise(F.lit("PASS"))


def document_status(documents: DataFrame, findings: DataFrame) -> DataFrame:
    """(document_id, status); a collision names no document, so it fails the corpus alone."""
    own = findings.filter("document_id IS NOT NULL").groupBy("document_id").agg(status(F.col("severity")).alias("status"))
    return documents.select("document_id").join(own, "document_id", "left").withColumn("status", F.coalesce("status", F.lit("PASS")))


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n"))


def report_lines(findings: DataFrame) -> DataFrame:
    """The report as ordered text lines: CRITICAL, WARNING, INFO."""
    rank = F.array_position(F.array(*map(F.lit, (CRITICAL, WARNING, INFO))), F.col("severity"))
    line = F.concat(F.lit("["), F.col("severity"), F.lit("] "), F.col("code"), F.lit(": "), F.col("message"))
    return findings.select(rank.alias("rank"), F.col("code"), line.alias("line")).orderBy("rank", "code", "line").select("line")


def manifest(documents: DataFrame, pages: DataFrame, chunks: DataFrame, findings: DataFrame) -> DataFrame:
    """One row of totals. Pages without the mark ``ocr_used`` were read without it."""
    s = document_status(documents, findings)
    d = s.agg(F.count("*").alias("documents_total"), F.count_if(F.col("status") != "FAILED").alias("documents_successful"), F.count_if(F.col("status") == "FAILED").alias("documents_failed"))
    m = findings.agg(F.count_if(F.col("severity") == WARNING).alias("warnings"), F.count_if(F.col("severity") == CRITICAL).alias("critical_errors"), status(F.col("severity")).alias("validation_status"))
    p, c = pages.agg(F.count("*").alias("pages_total"), F.count_if(_ocr(pages)).alias("ocr_pages")), chunks.agg(F.count("*").alias("chunks_total"))
    return d.crossJoin(p).crossJoin(c).crossJoin(m)  # four single rows


def _ocr(pages: DataFrame) -> Column:
    return F.coalesce(F.col("ocr_used"), F.lit(False)) if "ocr_used" in pages.columns else F.lit(False)


#: What a manifest says of each document, beside its counts and status.
LISTED = ("document_id", "filename", "relative_path", "dataset_id", "page_count", "source_sha256")


def manifest_documents(documents: DataFrame, chunks: DataFrame, findings: DataFrame) -> DataFrame:
    """The manifest's table of documents: a row for each, as a corpus may have any number of them."""
    n = chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))
    x = documents.select(*LISTED).join(n, "document_id", "left").join(document_status(documents, findings), "document_id")
    return x.select(*LISTED, F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.col("status").alias("validation_status"))


def incremental_plan(inventory: DataFrame, previous: DataFrame, keys: tuple[str, ...] = ("processor_version", "source_sha256", "chunk_size", "chunk_overlap"), force: bool = False) -> DataFrame:
    """(document_id, action): reuse if all keys equal the previous run's, else process; remove what is gone."""
    old = previous.select("document_id", F.struct(*keys).alias("_old"))
    new = inventory.select("document_id", F.struct(*keys).alias("_new"))
    x = new.join(old, "document_id", "full_outer")
    same = (F.col("_new") == F.col("_old")) & F.lit(not force)
    action = F.when(F.col("_new").isNull(), F.lit("remove")).when(F.coalesce(same, F.lit(False)), F.lit("reuse")).otherwise(F.lit("process"))
    return x.select("document_id", action.alias("action"))


def with_page_path(findings: DataFrame, documents: DataFrame) -> DataFrame:
    """Findings whose path is missing get their document's."""
    known = documents.select("document_id", F.col("relative_path").alias("_path"))
    return findings.join(known, "document_id", "left").withColumn("relative_path", F.coalesce("relative_path", "_path")).drop("_path")


def failed_findings(failed: DataFrame) -> DataFrame:
    """Of (document_id, relative_path, error) rows."""
    return failed.select(*finding(CRITICAL, "DOCUMENT_PROCESSING_FAILED", F.concat(F.col("relative_path"), F.lit(": "), F.col("error"))))


def split_failed(results: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Rows that went well, and findings for those that did not, so one failure stops nothing else."""
    bad = results.filter(F.col(error).isNotNull())
    return results.filter(F.col(error).isNull()).drop(error), failed_findings(bad.withColumnRenamed(error, "error"))


def processed_findings(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """How many pages were read of each document (document_id, relative_path)."""
    n = pages.groupBy("document_id").agg(F.count("*").alias("n"))
    x = documents.select("document_id", "relative_path").join(n, "document_id", "left")
    say = F.concat("relative_path", F.lit(": "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" pages were read"))
    return x.select(*finding(INFO, "DOCUMENT_PROCESSED", say))


def page_counts(pages: DataFrame) -> DataFrame:
    """Per document: duplicated, empty, low-text and failed pages."""
    return pages.groupBy("document_id").agg(
        F.count_if(F.col("duplicate_within_document") | F.col("duplicate_across_documents")).alias("duplicate_pages"),
        F.count_if(is_blank(F.col("text"))).alias("empty_pages"),
        F.count_if(is_low_text(F.col("text"))).alias("suspicious_pages"),
    )
