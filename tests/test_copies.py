"""Searches over rows that are mostly copies: each class once, all members found."""

import random

import numpy as np
import pytest

from codexlake.operators import copies, lexical, vectors
from tests.test_retrieval import brute_bm25


def test_bm25_of_copies_equals_all_pairs(spark, tmp_path):
    """Ids of a class are scattered, and more of them tie than are asked for; equal queries by other words' order."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 6))) for _ in range(25)] + [""]
    docs = [(i, rng.choice(texts)) for i in range(400)]
    asked = [(q, rng.choice(texts[:6])) for q in range(30)] + [(40, "w1 w2"), (41, "w2 w1"), (42, "w2"), (43, "unknown"), (44, "w2 w2")]
    frame = spark.createDataFrame(docs, "chunk_id long, text string")
    terms = lexical.query_terms(spark.createDataFrame(asked, "query_id long, query string"))
    want = sorted(brute_bm25(docs, asked, 7))
    built = lexical.build(frame)
    assert built.postings.select("id").distinct().count() <= 25
    built.write(str(tmp_path / "i"))
    for index in (lexical.Bm25Index.read(spark, str(tmp_path / "i")), lexical.for_queries(frame, terms)):
        got = sorted(tuple(r) for r in lexical.search(index, terms, 7).collect())
        assert [r[:3] for r in got] == [r[:3] for r in want] and [r[3] for r in got] == pytest.approx([r[3] for r in want])


@pytest.mark.parametrize("queries, block", [(vectors.MAX_QUERIES, vectors.BATCH_QUERIES), (vectors.MAX_QUERIES, 4), (5, 4)])
def test_dense_search_of_copies_equals_all_pairs(spark, monkeypatch, queries, block):
    monkeypatch.setattr(vectors, "MAX_QUERIES", queries)
    monkeypatch.setattr(vectors, "BATCH_QUERIES", block)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(40, 8))
    rows = [(i, v[k].tolist()) for i, k in enumerate(rng.integers(0, 40, 500))] + [(900, None)]
    asked = [(q, v[q % 9].tolist()) for q in range(30)]
    kind = "{} long, embedding array<double>"
    got = vectors.search(spark.createDataFrame(rows, kind.format("vec_id")), spark.createDataFrame(asked, kind.format("query_id")), 15)
    unit = lambda x: np.array(x) / np.linalg.norm(x)
    want = set()
    for q, a in asked:
        best = sorted((-round(float(unit(a) @ unit(e)), 9), i) for i, e in rows if e)[:15]
        want |= {(q, n + 1, i) for n, (_, i) in enumerate(best)}
    assert {tuple(r)[:3] for r in got.collect()} == want


def test_few_copies_make_no_classes(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c")], "id long, x string")
    assert copies.members(rows, "id", rows.x) is None and copies.members(rows.limit(0), "id", rows.x) is None
    assert sorted(tuple(r) for r in copies.members(rows.filter("id < 3"), "id", rows.x).collect()) == [(1, 2, 1), (1, 2, 2)]


def test_each_text_is_embedded_once(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "chunk_id long, embedding_text string")
    make = vectors.make_embedder("hash", "hash-4")
    got, want = (dict(map(tuple, f(rows, make).collect())) for f in (vectors.embedded_once, vectors.embedded))
    assert got == want


@pytest.mark.parametrize("matrix, counted", [(lexical.MATRIX, lexical.COUNTED), (lexical.MATRIX, 3), (0, 3)])
def test_search_where_the_documents_are_equals_all_pairs(spark, monkeypatch, matrix, counted):
    """By the matrix of few queries and by blocks; ids are strings, of which many tie; words are counted in small groups."""
    monkeypatch.setattr(lexical, "MATRIX", matrix)
    monkeypatch.setattr(lexical, "COUNTED", counted)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    docs = [(f"d{i}", " ".join(rng.choices(words, k=rng.randrange(0, 5)))) for i in range(300)] + [("none", None)]
    asked = [(q, " ".join(rng.choices(words, k=3))) for q in range(20)] + [(30, ""), (31, "unknown")]
    frame = spark.createDataFrame(docs, "chunk_id string, text string")
    terms = lexical.query_terms(spark.createDataFrame(asked, "query_id long, query string"))
    index = lexical.for_queries(frame, terms)
    assert index.postings is None
    want = brute_bm25([(i, t or "") for i, t in docs], asked, 6)
    got = sorted(tuple(r) for r in lexical.search(index, terms, 6).collect())
    assert [r[:3] for r in got] == sorted(r[:3] for r in want) and [r[3] for r in got] == pytest.approx([r[3] for r in sorted(want)])


def test_term_stats_alone_are_the_whole_index_s(spark):
    docs = [(1, "red red fish"), (2, "blue fish fish"), (3, ""), (4, None), (5, "Fish SECTION 3(1)"), (6, "red red fish")]
    frame = spark.createDataFrame(docs, "chunk_id long, text string")
    for rows in (frame, frame.filter("chunk_id IN (1, 6)"), frame.limit(0)):
        got, want = (sorted(tuple(r) for r in x.collect()) for x in (lexical.term_stats(rows), lexical.build(rows).term_stats))
        assert got == want
