"""Reading a query's text: references, document type, domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexlake.functions.text import collapsed

#: What counts as a reference, in this order.
REFERENCES = (
    r"(?iU)\b(?:section|sec\.?)\s+\d+[a-z]?(?:\(\w+\))*",
    r"(?iU)\b(?:article|art\.?)\s+\d+[a-z]?(?:\(\w+\))*",
    r"(?iU)\b(?:rule|regulation|reg\.?)\s+\d+[a-z]?(?:\(\w+\))*",
    r"(?iU)\b(?:chapter)\s+(?:\d+|[IVXLCDM]+)",
)

#: Whole words that name a document type; the first in this order decides.
DOCUMENT_TYPES = (
    ("act", "Statute"), ("statute", "Statute"), ("rule", "Rule"), ("rules", "Rule"), ("regulation", "Regulation"), ("regulations", "Regulation"),
    ("notification", "Notification"), ("treaty", "Treaty"), ("protocol", "Protocol"), ("convention", "Convention"), ("manual", "Manual"),
    ("guideline", "Guideline"), ("guidelines", "Guideline"), ("case", "Case Study"), ("judgement", "Case Study"), ("judgment", "Case Study"),
    ("order", "Order"), ("circular", "Circular"),
)

#: Phrases that name a domain; the first in this order decides.
DOMAINS = (
    ("patent", "intellectual property"), ("patents", "intellectual property"), ("trademark", "intellectual property"),
    ("trade mark", "intellectual property"), ("copyright", "intellectual property"), ("design", "intellectual property"),
    ("biodiversity", "biodiversity"), ("biological diversity", "biodiversity"), ("traditional knowledge", "traditional knowledge"),
    ("geographical indication", "intellectual property"), ("plant variety", "plant variety"), ("nagoya", "international law"),
    ("trips", "international law"), ("wipo", "international law"), ("paris convention", "international law"),
)


def references(c: Column) -> Column:
    """All references, kind by kind, each once, as written."""
    found = F.concat(*[F.regexp_extract_all(c, F.lit(p), F.lit(0)) for p in REFERENCES])
    return F.array_distinct(F.transform(found, collapsed))


def _first(rules: tuple[tuple[str, str], ...], fits) -> Column:
    return F.coalesce(*[F.when(fits(k), F.lit(v)) for k, v in rules])


def document_type(c: Column) -> Column:
    low = F.lower(c)
    return _first(DOCUMENT_TYPES, lambda k: low.rlike(rf"(?U)\b{k}\b"))


def domain(c: Column) -> Column:
    low = F.lower(c)
    return _first(DOMAINS, low.contains)


def analyzed(queries: DataFrame, text: str = "query") -> DataFrame:
    """The queries with normalized_query, legal_references, document_type, domain and the filters
    that these suggest (which retrieval reports and does not apply)."""
    out = queries.withColumn("normalized_query", collapsed(F.col(text)))
    c = F.col("normalized_query")
    out = out.withColumns({"legal_references": references(c), "detected_document_type": document_type(c), "detected_domain": domain(c)})
    return out.withColumn("filters", F.struct(F.col("detected_document_type").alias("document_type"), F.col("detected_domain").alias("legal_domain")))
