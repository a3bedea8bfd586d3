"""What a document's name and first pages say of it. Rule tables are parameters with defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codexlake.functions.text import collapsed, filled_lines

#: Words of a title.
TITLE_WORDS = r"(?iU)\b(Act|Rules|Regulations|Notification|Protocol|Treaty|Guidelines|Manual|Digest|Convention)\b"

#: Fixed values: (type, pattern) in order; "~" at the front means a regular expression, else any of the phrases.
TYPE_RULES = (
    ("Amendment", ("amendment act",)),
    ("Statute", ("~\\bact,?\\s+\\d{4}\\b", "_act_", "~ act\\z")),
    ("Case_Study", ("case stud", "digest")),
    ("Case_Law", ("~\\b(judgment|judgement|court of|versus| v\\. )\\b",)),
    ("Manual", ("manual", "practice and procedure")),
    ("Guideline", ("guideline",)),
    ("Protocol", ("protocol",)),
    ("Treaty", ("treaty", "convention", "wipo gratk")),
    ("Notification", ("notification", "gazette")),
    ("Regulation", ("regulation",)),
    ("Rule", ("rules",)),
)

#: Collections whose documents have a place by themselves.
INTERNATIONAL = ("Dataset_4_International",)
NATIONAL = ("Dataset_1", "Dataset_2", "Dataset_3_TK")

#: Descriptions of the collections.
COLLECTIONS = {
    "Dataset_1": "Indian statutory/legal foundation documents",
    "Dataset_2": "Drugs, cosmetics, consumer/regulatory documents",
    "Dataset_3_TK": "Traditional Knowledge documents",
    "Dataset_4_International": "International treaties and international TK/biodiversity documents",
    "Dataset_5_CaseLaw": "Case-law, manuals, practice/procedure, and case-study documents",
}

#: Domains and the phrases that name them.
DOMAIN_RULES = (
    ("patent law", ("patent",)),
    ("trademark law", ("trade mark", "trademark")),
    ("biodiversity", ("biological diversity", "biodiversity", "biological resources")),
    ("traditional knowledge", ("traditional knowledge", "tkdl", "indigenous", "gratk")),
    ("drugs and cosmetics", ("drugs", "cosmetics")),
    ("consumer protection", ("consumer protection", "ccpa")),
    ("international law", ("treaty", "protocol", "convention", "wipo")),
    ("intellectual property", ("intellectual property", "wipo", "patent", "trade mark", "trademark")),
)


def any_of(text: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | (text.rlike(f"(?U){p[1:]}") if p.startswith("~") else text.contains(p))
    return out


def collection(relative_path: Column) -> Column:
    """The first component of a path."""
    first = F.split_part(F.coalesce(relative_path, F.lit("")), F.lit("/"), F.lit(1))
    return F.when(first != "", first).otherwise(F.lit("UNKNOWN"))


def title(filename: Column, text: Column) -> Column:
    usable = F.filter(filled_lines(text), lambda x: F.length(x).between(8, 180))
    named = F.get(F.filter(F.slice(usable, 1, 40), lambda x: x.rlike(TITLE_WORDS)), F.lit(0))
    stem = collapsed(F.translate(F.regexp_replace(filename, r"(?<=.)\.[^.]*\z", ""), "_", " "))
    return F.coalesce(collapsed(named), F.when(stem != "", stem))


def _evidence(filename: Column, text: Column, n: int) -> Column:
    return F.lower(F.concat(filename, F.lit("\n"), F.substring(text, 1, n)))


def document_type(filename: Column, text: Column, dataset: Column, rules=TYPE_RULES) -> Column:
    evidence = _evidence(filename, text, 5000)
    found = [F.when(any_of(evidence, phrases), F.lit(kind)) for kind, phrases in rules]
    return F.coalesce(*found, F.when(dataset.isin(*INTERNATIONAL), F.lit("Treaty")), F.lit("Other"))


def jurisdiction(filename: Column, text: Column, dataset: Column) -> Column:
    national = _evidence(filename, text, 5000).contains("india") | dataset.isin(*NATIONAL)
    return F.when(dataset.isin(*INTERNATIONAL), F.lit("International")).when(national, F.lit("India"))


def authority(place: Column, text: Column) -> Column:
    head = F.lower(F.substring(text, 1, 5000))
    return (
        F.when((place == "India") & any_of(head, ("government of india", "ministry", "gazette of india")), F.lit("Government of India"))
        .when(any_of(head, ("world intellectual property organization", "wipo")), F.lit("WIPO"))
        .when(any_of(head, ("convention on biological diversity", "cbd")), F.lit("Convention on Biological Diversity"))
    )


def legal_domains(filename: Column, text: Column, rules=DOMAIN_RULES) -> Column:
    evidence = _evidence(filename, text, 10000)
    return F.array_compact(F.array(*[F.when(any_of(evidence, phrases), F.lit(name)) for name, phrases in rules]))


def language(text: Column) -> Column:
    return F.when(text.rlike("[A-Za-z]{20,}"), F.lit("en"))


def described(documents, corpus_id: str = "corpus"):
    """Documents (relative_path, source_sha256, page_count, first_pages_text) with their metadata."""
    from codexlake.functions.text import hash_parts

    path, text = F.col("relative_path"), F.coalesce(F.col("first_pages_text"), F.lit(""))
    out = documents.withColumns({"dataset_id": collection(path), "filename": F.element_at(F.split(path, "/"), -1)})
    name, dataset = F.col("filename"), F.col("dataset_id")
    about = F.create_map(*[F.lit(x) for kv in COLLECTIONS.items() for x in kv])
    out = out.withColumns({
        "corpus_id": F.lit(corpus_id), "document_id": hash_parts(F.lit(corpus_id), dataset, path), "dataset_description": F.try_element_at(about, dataset),
        "title": title(name, text), "document_type": document_type(name, text, dataset), "jurisdiction": jurisdiction(name, text, dataset),
        "language": language(text), "legal_domains": legal_domains(name, text), "publication_date": F.lit(None).cast("date"), "effective_date": F.lit(None).cast("date"),
    })
    return out.withColumn("authority", authority(F.col("jurisdiction"), text)).drop("first_pages_text")
