"""Structure of a document carried from line to line: parts, chapters, sections, clauses.

Reading a line depends on all lines of its document before it, and a document may be of any length. So it
is cut into spans, and what a span of lines does to a context is put in one row: for each key its last
value, and whether it was cleared. Such rows are an associative summary: spans are read each for itself,
their rows are scanned per document, and what is carried into a span completes its lines. No task holds a
document, but one row for each of its spans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from codexlake.functions.text import collapsed, lines, strip
from codexlake.sources.stage import stored

#: Pages (or lines, where they are numbered through) in a span.
SPAN = 256

#: The keys of a context.
KEYS = (
    "part", "chapter", "sub_chapter", "section", "subsection", "clause", "sub_clause", "proviso", "explanation", "schedule",
    "article", "rule", "regulation", "case_name", "court", "case_number", "judgment", "order",
)

#: What a line is, by the first pattern that fits, and its groups.
PATTERNS = (
    ("part", r"(?iU)^\s*(PART\s+[IVXLCDM0-9A-Z]+)\b", 1),
    ("chapter", r"(?iU)^\s*(CHAPTER\s+[IVXLCDM0-9A-Z]+)\b", 1),
    ("sub_chapter", r"(?iU)^\s*(SUB-?CHAPTER\s+[IVXLCDM0-9A-Z]+)\b", 1),
    ("schedule", r"(?iU)^\s*(THE\s+)?((?:FIRST|SECOND|THIRD|FOURTH|FIFTH|SIXTH|SEVENTH|EIGHTH|NINTH|TENTH|\d+)(?:\s+SCHEDULE)|SCHEDULE\s+[IVXLCDM0-9A-Z]*)\b", 2),
    ("section", r"(?iU)^\s*(?:Section\s+)?(\d+[A-Z]?)\.\s+|^\s*Section\s+(\d+[A-Z]?)\b", 2),
    ("article", r"(?iU)^\s*(Article\s+\d+[A-Z]?)\b", 1),
    ("rule", r"(?iU)^\s*(Rule\s+\d+[A-Z]?|\d+[A-Z]?\.\s+)", 1),
    ("regulation", r"(?iU)^\s*(Regulation\s+\d+[A-Z]?)\b", 1),
    ("subsection", r"(?U)^\s*(\(\d+[A-Z]?\))\s+", 1),
    ("clause", r"(?U)^\s*(\([a-z]{1,3}\))\s+", 1),
    ("sub_clause", r"(?iU)^\s*(\([ivxlcdm]+\))\s+", 1),
    ("proviso", r"(?U)^\s*(Provided\s+that|PROVIDED\s+that)\b", 1),
    ("explanation", r"(?iU)^\s*(Explanation(?:\s+\d+)?)\b", 1),
    ("judgment", r"(?iU)^\s*(JUDGMENT|JUDGEMENT)\b", 1),
    ("order", r"(?iU)^\s*(ORDER)\b", 1),
)
#: What the head of a case says; the first hit in a document stays.
STICKY = {
    "case_name": r"(?iU)^\s*([A-Z][A-Za-z0-9 .,&'()/-]+\s+(?:v\.|vs\.|versus)\s+[A-Z][A-Za-z0-9 .,&'()/-]+)\s*$",
    "case_number": r"(?iU)\b((?:Civil|Criminal|Writ|Appeal|Petition|Suit|Application)[A-Za-z .]*No\.?\s*[\w./ -]+)",
    "court": r"(?iU)\b(Supreme Court of India|High Court of [A-Za-z ]+|Court of [A-Za-z ]+)\b",
}
#: What clears a key: a line of one of these kinds after it.
MAJOR = ("part", "chapter", "article", "section", "rule", "regulation", "schedule")
CLEARED_BY = {
    "subsection": MAJOR,
    "clause": (*MAJOR, "subsection"),
    "sub_clause": (*MAJOR, "subsection", "clause"),
    "proviso": (*MAJOR, "subsection", "clause"),
    "explanation": (*MAJOR, "subsection", "clause"),
}
#: A paragraph that sets one of these anew begins a block.
BOUNDARIES = ("part", "chapter", "schedule", "section", "article", "rule", "regulation", "judgment", "order")


def classified(rows: DataFrame, text: str = "text") -> DataFrame:
    """The lines with ``key`` and ``value``; both null for a line that is nothing special."""
    c = F.col(text)
    key = F.coalesce(*[F.when(c.rlike(p), F.lit(k)) for k, p, _ in PATTERNS])
    filled = lambda p, n: F.coalesce(*[F.nullif(F.regexp_extract(c, p, g), F.lit("")) for g in range(1, n + 1)])
    value = F.coalesce(*[F.when(F.col("key") == k, filled(p, n)) for k, p, n in PATTERNS])
    value = collapsed(value)
    named = F.when(F.col("key") == "section", F.concat(F.lit("Section "), value))
    return rows.withColumn("key", key).withColumn("value", F.coalesce(named, value))


def _carried(ends: DataFrame, document: str) -> DataFrame:
    """(document, _span, _carried): the context before each span, of the summaries (document, _span, _end)."""
    before = Window.partitionBy(document).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    out = []
    for k in KEYS:
        v, cleared = F.col(f"_end.{k}.v"), F.col(f"_end.{k}.cleared")
        told = F.first(v, ignorenulls=True).over(before) if k in STICKY else F.last(F.when(v.isNotNull() | cleared, F.struct(v.alias("v"))), ignorenulls=True).over(before)["v"]
        out.append(told.alias(k))
    return ends.select(document, "_span", F.struct(*out).alias("_carried"))


def with_context(rows: DataFrame, order: list[str], document: str = "document_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """The classified lines with ``structure``, the context after each line. Spans are of so many values of the first
    column of the order."""
    rows = classified(rows, text).withColumn("_span", F.floor(F.col(order[0]) / span))
    window = Window.partitionBy(document, "_span").orderBy(*order)
    w = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_n", F.row_number().over(window))
    at = lambda keys: F.coalesce(F.max(F.when(F.col("key").isin(*keys), F.col("_n"))).over(w), F.lit(0))
    own = []
    for k in KEYS:
        v, cleared = F.first(collapsed(F.nullif(F.regexp_extract(F.col(text), STICKY[k], 1), F.lit(""))), ignorenulls=True).over(w) if k in STICKY else None, F.lit(False)
        if k not in STICKY:
            last = F.last(F.when(F.col("key") == k, F.struct(F.col("_n").alias("n"), F.col("value").alias("v"))), ignorenulls=True).over(w)
            v = F.when(last["n"] > at(CLEARED_BY[k]), last["v"]) if k in CLEARED_BY else last["v"]
            cleared = at(CLEARED_BY[k]) > 0 if k in CLEARED_BY else cleared
        own.append(F.struct(v.alias("v"), cleared.alias("cleared")).alias(k))
    rows = rows.withColumn("_own", F.struct(*own))
    ends = rows.groupBy(document, "_span").agg(F.max_by("_own", "_n").alias("_end"))
    rows = rows.join(_carried(ends, document), [document, "_span"], "left")
    out = []
    for k in KEYS:
        v, told = F.col(f"_own.{k}.v"), F.col(f"_carried.{k}")
        out.append((F.coalesce(told, v) if k in STICKY else F.coalesce(v, F.when(~F.col(f"_own.{k}.cleared"), told))).alias(k))
    return rows.withColumn("structure", F.struct(*out)).drop("_n", "_span", "_own", "_carried")


def page_structure(pages: DataFrame) -> DataFrame:
    """The pages (document_id, page_index, text) with the context at their end."""
    rows = pages.select("document_id", "page_index", F.posexplode(lines(F.col("text"))).alias("line_no", "text"))
    last = with_context(rows, ["page_index", "line_no"]).groupBy("document_id", "page_index").agg(F.max_by("structure", "line_no").alias("structure"))
    return pages.join(last, ["document_id", "page_index"], "left")


def paragraphs(c: Column) -> Column:
    """Parts between blank lines; if that is one at most, the lines."""
    filled = lambda x: F.filter(F.transform(x, strip), lambda p: p != "")
    parts = filled(F.split(strip(c), r"(?U)\n[\s\x1c-\x1f]*\n"))
    return F.when(F.size(parts) <= 1, filled(lines(c))).otherwise(parts)


def structural_blocks(pages: DataFrame, span: int = SPAN) -> DataFrame:
    """Blocks of the pages (document_id, page_index, printed_page_number, text): document_id,
    block_no, n_paras, text, pages from and to, and the structure at the last paragraph."""
    paras = pages.select("document_id", "page_index", "printed_page_number", F.posexplode(paragraphs(F.col("text"))).alias("para_no", "para"))
    rows = paras.select("*", F.posexplode(lines(F.col("para"))).alias("line_no", "text"))
    keys = ["document_id", "page_index", "para_no"]
    rows = with_context(rows, ["page_index", "para_no", "line_no"], span=span)
    paras = rows.groupBy(*keys).agg(F.max_by("structure", "line_no").alias("structure"), F.first("para").alias("para"), F.first("printed_page_number").alias("printed"))
    place = F.struct("page_index", "para_no")
    blocks = _numbered(stored(paras, "paragraphs"), span).groupBy("document_id", "block_no").agg(
        F.count("*").alias("n_paras"),
        F.array_sort(F.collect_list(F.struct("page_index", "para_no", "para"))).alias("p"),
        (F.min("page_index") + 1).alias("page_start"), (F.max("page_index") + 1).alias("page_end"),
        F.min_by("printed", place).alias("printed_page_start"), F.max_by("printed", place).alias("printed_page_end"),
        F.max_by("structure", place).alias("structure"),
    )
    return blocks.withColumn("text", F.array_join(F.transform("p", lambda x: x["para"]), "\n\n")).drop("p")


def _numbered(paras: DataFrame, span: int) -> DataFrame:
    """Stored paragraphs with ``block_no``: how many of their document up to there begin a block. Counted by
    spans, as contexts are: the last structure and the count of each span go to those after it."""
    paras = paras.withColumn("_span", F.floor(F.col("page_index") / span))
    spans = Window.partitionBy("document_id").orderBy("_span")
    inside = Window.partitionBy("document_id", "_span").orderBy("page_index", "para_no")
    running = lambda w, end: w.rowsBetween(Window.unboundedPreceding, end)
    of_span = lambda rows, x: rows.groupBy("document_id", "_span").agg(x)
    last = of_span(paras, F.max_by("structure", F.struct("page_index", "para_no")).alias("_end")).select("document_id", "_span", F.lag("_end").over(spans).alias("_before"))

    def flagged(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("_b", F.lag("structure").over(inside)).join(last, ["document_id", "_span"], "left").withColumn("_b", F.coalesce("_b", "_before"))
        new = [F.col(f"structure.{k}").isNotNull() & ~F.col(f"structure.{k}").eqNullSafe(F.col(f"_b.{k}")) for k in BOUNDARIES]
        return rows.withColumn("_new", reduce(Column.__or__, new, F.col("_b").isNull()).cast("int")).drop("_b", "_before")

    counts = of_span(flagged(paras.drop("para", "printed")), F.sum("_new").alias("_news"))
    counts = counts.select("document_id", "_span", F.coalesce(F.sum("_news").over(running(spans, -1)), F.lit(0)).alias("_ahead"))
    rows = flagged(paras).withColumn("_at", F.sum("_new").over(running(inside, Window.currentRow)))
    return rows.join(counts, ["document_id", "_span"]).withColumn("block_no", F.col("_ahead") + F.col("_at")).drop("_span", "_new", "_at", "_ahead")
