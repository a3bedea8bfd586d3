"""Scalar functions: known facts, and Python's own string methods as the measure."""

import hashlib
import re
import uuid

import pytest
from pyspark.sql import functions as F

from codexlake.functions import metadata, query_text, text

TEXTS = ["", "a", "  a \t b  c \n", "x\x1c\x1dy\x85z w", "one\r\ntwo\rthree\fpage\vend\n", "Section 3(1)(a) of 5A, étude d'été 12(b) naïve_x-y", "A. B! C? d. 9 (x). Z", "﻿hy-\nphen X-\nRay  a\n\n\n\nb"]


def column(spark, c, values=TEXTS, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, t {kind}")
    return [r[0] for r in df.select(c(F.col("t")).alias("x"), "i").orderBy("i").collect()]


def test_white_space_is_pythons(spark):
    assert column(spark, text.strip) == [t.strip() for t in TEXTS]
    assert column(spark, text.word_count) == [len(t.split()) for t in TEXTS]
    assert column(spark, text.collapsed) == [" ".join(t.split()) for t in TEXTS]
    assert column(spark, text.filled_lines) == [[x.strip() for x in t.splitlines() if x.strip()] for t in TEXTS]


def test_tokens_are_pythons(spark):
    pattern = text.TOKEN.replace("(?iuU)", "")
    assert column(spark, text.tokens) == [[m.group(0).lower() for m in re.finditer(pattern, t, re.I)] for t in TEXTS]
    assert column(spark, text.tokens, ["Section 3(1)(a) and Article 5"]) == [["section 3(1)(a)", "and", "article 5"]]
    assert column(spark, lambda c: text.tokens(c, False, True), ["The of X"]) == [["The", "X"]]


def test_hashes(spark):
    assert column(spark, lambda c: text.hash_parts(c, F.lit(1), F.lit(None))) == [hashlib.sha256(f"{t}\x1f1\x1fNone\x1f".encode()).hexdigest() for t in TEXTS]
    assert column(spark, text.point_id) == [str(uuid.uuid5(uuid.NAMESPACE_URL, f"chunks:{t}")) for t in TEXTS]


def test_pages(spark):
    assert column(spark, text.cleaned, ["Head\nbiologi-\ncal text\nPage 1\n2\nends here.\nNext"]) == ["Head biological text ends here.\nNext"]
    assert column(spark, lambda c: text.cleaned(c, F.array(F.lit("Head"))), ["Head\nbody"]) == ["body"]
    assert column(spark, text.printed_page_number, ["x\nPage 12\ny", "7", "none", "a\n" * 30 + "page 9"]) == [12, 7, None, 9]
    assert column(spark, text.is_low_text, ["", "word " * 8 + "x" * 20, "1 " * 50]) == [True, False, True]
    assert column(spark, text.sentences, ["One. Two! (Three) four? five. 6"]) == [["One.", "Two!", "(Three) four? five.", "6"]]


def test_embedding_text(spark):
    c = text.embedding_text({"title": F.lit("T"), "section": F.lit(""), "article": F.lit(None).cast("string")}, F.lit("body"))
    assert column(spark, lambda _: c, ["x"]) == ["TITLE:\nT\n\nCONTENT:\nbody"]


def test_cache_key_changes_with_every_part(spark):
    keys = [text.embedding_cache_key(F.lit("c"), F.lit("h"), F.lit(p), F.lit(m), F.lit(r).cast("string"), F.lit(n)) for p, m, r, n in (("p", "m", None, True), ("q", "m", None, True), ("p", "n", None, True), ("p", "m", "r", True), ("p", "m", None, False))]
    assert len(set(spark.range(1).select(*keys).first())) == 5


def test_query_analysis(spark):
    df = spark.createDataFrame([(1, "  hello   world  "), (2, "What is section 3(1)(a), Art. 5 and Rule 2 in Chapter IV? section 3(1)(a)"), (3, "order under the patent act and biodiversity"), (4, None)], "query_id long, query string")
    r = {x.query_id: x for x in query_text.analyzed(df).collect()}
    assert r[1].normalized_query == "hello world" and r[1].legal_references == [] and r[1].detected_domain is None
    assert r[2].legal_references == ["section 3(1)(a)", "Art. 5", "Rule 2", "Chapter IV"] and r[2].detected_document_type == "Rule"
    assert r[3].detected_document_type == "Statute" and r[3].filters.legal_domain == "intellectual property"


@pytest.mark.parametrize(
    ("name", "body", "kind"),
    [("x.pdf", "the amendment act", "Amendment"), ("the_act_.pdf", "", "Statute"), ("x.pdf", "patents act, 1970 text", "Statute"), ("x.pdf", "Court of appeal", "Case_Law"), ("x.pdf", "nothing", "Other"), ("x.pdf", "rules", "Rule")],
)
def test_document_type(spark, name, body, kind):
    assert spark.range(1).select(metadata.document_type(F.lit(name), F.lit(body), F.lit("D"))).first()[0] == kind


def test_described(spark):
    df = spark.createDataFrame([("Dataset_1/a_b.pdf", "x\nThe  Patents Act\nGazette of India"), ("", None)], "relative_path string, first_pages_text string")
    a, b = metadata.described(df).orderBy(F.desc("relative_path")).collect()
    assert (a.title, a.dataset_id, a.jurisdiction, a.authority) == ("The Patents Act", "Dataset_1", "India", "Government of India")
    assert "patent law" in a.legal_domains and b.dataset_id == "UNKNOWN" and b.document_type == "Other" and b.title is None
