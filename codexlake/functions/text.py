"""Scalar text functions: expressions over columns, all of them JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str methods know it: Java's Unicode class lacks the four separators.
_S = r"[\s\x1c-\x1f]"
WHITE = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Line ends as Python's splitlines knows them.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
SEPARATOR = "\x1f"

#: The tokenizer's alternatives, in order, and its optional stop words.
TOKEN = (
    r"(?iuU)\b(?:section|article|rule|regulation)\s+\d+[a-z]?(?:\(\w+\))*"
    r"|\b\d+[a-z]?(?:\(\w+\))+|\b[a-zA-Z][a-zA-Z0-9_-]*\b|\b\d+[a-zA-Z]?\b"
)
STOP_WORDS = ("the", "and", "or", "of", "to", "in", "for", "by", "with", "as", "on", "is", "are")

#: Labels of the embedding text, in order, and the fields they show.
EMBEDDING_LABELS = (
    ("TITLE", "title"), ("DOCUMENT TYPE", "document_type"), ("JURISDICTION", "jurisdiction"), ("PART", "part"), ("CHAPTER", "chapter"),
    ("SCHEDULE", "schedule"), ("SECTION", "section"), ("ARTICLE", "article"), ("RULE", "rule"), ("REGULATION", "regulation"), ("CASE", "case_name"),
)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def lines(c: Column) -> Column:
    """Lines as splitlines gives them, but for an empty last one."""
    return F.split(c, LINE_END)


def filled_lines(c: Column) -> Column:
    """Stripped lines that are not blank."""
    return F.filter(F.transform(lines(c), strip), lambda x: x != "")


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def hash_parts(*parts: Column) -> Column:
    """SHA-256 over all parts, each followed by a separator byte; a null part reads "None"."""
    return F.sha2(F.concat(*[x for p in parts for x in (F.coalesce(p.cast("string"), F.lit("None")), F.lit(SEPARATOR))]), 256)


def hash_flag(c: Column) -> Column:
    """How a boolean goes into a hash."""
    return F.when(c, F.lit("True")).when(~c, F.lit("False"))


def normalized(c: Column) -> Column:
    """Line ends and blanks made uniform, words joined that a hyphen splits over lines."""
    c = F.replace(F.replace(c, F.lit("\ufeff"), F.lit("")), F.lit("\u00a0"), F.lit(" "))
    c = F.regexp_replace(c, "\r\n|\r", "\n")
    c = F.regexp_replace(c, "[ \t]{2,}|\t", " ")
    c = F.regexp_replace(c, "([A-Za-z])-\n([a-z])", "$1$2")
    return strip(F.regexp_replace(c, "\n{3,}", "\n\n"))


def cleaned(c: Column, repeated: Column | None = None) -> Column:
    """A page without repeated marginal lines and page numbers, soft line breaks joined."""
    kept = F.transform(lines(normalized(c)), strip)
    if repeated is not None:
        repeated = F.coalesce(repeated, F.array().cast("array<string>"))
        kept = F.filter(kept, lambda x: (x == "") | ~F.array_contains(repeated, x))
    kept = F.filter(kept, lambda x: ~x.rlike(r"(?i)\A\s*(?:page\s*)?\d+\s*\z"))
    c = F.regexp_replace(F.array_join(kept, "\n"), "\n{3,}", "\n\n")
    c = F.regexp_replace(c, r"(?<![.;:!?])\n(?!\n|[A-Z][A-Z\s]{3,}\z|(?:CHAPTER|PART|SECTION|Article|Rule|Regulation)\b)", " ")
    return normalized(c)


def head_and_tail(x: Column, n: int) -> Column:
    """The first n and the last n entries; a short array's come twice."""
    return F.concat(F.slice(x, 1, n), F.slice(x, F.greatest(F.size(x) - (n - 1), F.lit(1)), n))


def printed_page_number(c: Column) -> Column:
    first = F.get(F.filter(head_and_tail(filled_lines(c), 5), lambda x: x.rlike(r"(?i)\A(?:Page\s*)?\d{1,4}\z")), F.lit(0))
    return F.regexp_replace(first, r"\D", "").cast("int")


def word_count(c: Column) -> Column:
    """Runs of anything but white space."""
    return F.regexp_count(c, F.lit(r"(?U)[^\s\x1c-\x1f]+"))


def is_low_text(c: Column) -> Column:
    """Too little text on a page: under 40 characters, or under 8 words of two letters."""
    c = strip(c)
    return (F.length(c) < 40) | (F.regexp_count(c, F.lit("[A-Za-z]{2,}")) < 8)


def sentences(c: Column) -> Column:
    parts = F.transform(F.split(c, rf"(?U)(?<=[.!?]){_S}+(?=[A-Z0-9(])"), strip)
    return F.filter(parts, lambda x: x != "")


def collapsed(c: Column) -> Column:
    """All white space as single spaces."""
    return strip(F.regexp_replace(c, rf"(?U){_S}+", " "))


def tokens(c: Column, lowercase: bool = True, drop_stop_words: bool = False) -> Column:
    """Search tokens; references such as "section 3(1)(a)" stay whole."""
    out = F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))
    if lowercase:
        # all at once: a function called for every word costs more than finding it; no word has a separator
        out = F.when(F.size(out) > 0, F.split(F.lower(F.array_join(out, SEPARATOR)), SEPARATOR)).otherwise(F.array().cast("array<string>"))
    if drop_stop_words:
        out = F.filter(out, lambda x: ~x.isin(*STOP_WORDS))
    return out


def embedding_text(fields: dict[str, Column], text: Column) -> Column:
    """Labelled header fields, then the content; empty ones are left out."""
    shown = [(label, fields[name]) for label, name in EMBEDDING_LABELS if name in fields] + [("CONTENT", text)]
    return F.concat_ws("\n\n", *[F.when(v != "", F.concat(F.lit(f"{label}:\n"), v)) for label, v in shown])


def embedding_input_hash(c: Column) -> Column:
    return hash_parts(c)


def embedding_cache_key(chunk_id: Column, input_hash: Column, provider: Column, model: Column, revision: Column, normalize: Column) -> Column:
    return hash_parts(chunk_id, input_hash, provider, model, revision, hash_flag(normalize))


def point_id(chunk_id: Column, prefix: str = "chunks") -> Column:
    """UUID version 5 of "prefix:chunk_id" in the URL namespace."""
    space = F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8"))  # fixed value: the URL namespace
    h = F.sha1(F.concat(space, F.encode(F.concat(F.lit(f"{prefix}:"), chunk_id), "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))
