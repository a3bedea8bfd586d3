"""Indexes, search, fusion, evidence, and the registered queries against their SQL."""

import glob
import math
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from codexlake import catalog, oracles
from codexlake.functions.text import TOKEN
from codexlake.operators import audit, evidence, fusion, lexical, vectors
from codexlake.plans import pipelines
from codexlake.sources import files
from codexlake.streaming import live

SF = "/root/testdata/sf0.001"
HITS = "query_id long, id string, rank int, score double"


def brute_bm25(docs, queries, k):
    """(query_id, rank, id, score) of all pairs."""
    tok = lambda t: re.findall(r"[a-z][a-z0-9]*", t)
    bags = {i: Counter(tok(t)) for i, t in docs}
    avg = sum(sum(b.values()) for b in bags.values()) / len(bags)
    df = Counter(w for b in bags.values() for w in b)
    out = []
    for q, t in queries:
        s = {}
        for i, b in bags.items():
            n = sum(b.values())
            s[i] = round(sum(c * math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.5 / (b[w] + 1.5 * (0.25 + 0.75 * n / avg)) for w, c in Counter(tok(t)).items() if b[w]), 9)
        best = sorted((-x, i) for i, x in s.items() if x > 0)[:k]
        out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(best)]
    return out


@pytest.mark.parametrize("hot, block, looked, left", [(lexical.HOT, lexical.BLOCK_DOCS, lexical.LOOKED, lexical.LEFT), (40, 4, 20, 1.0), (7, 1, 3, 0.0)])
def test_pruned_search_equals_all_pairs(spark, monkeypatch, hot, block, looked, left):
    """Words by Zipf's law, so that nearly all pairs share some; ties by copies; queries of common words only."""
    for name, x in (("HOT", hot), ("BLOCK_DOCS", block), ("LOOKED", looked), ("LEFT", left)):
        monkeypatch.setattr(lexical, name, x)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(600)]
    draw = lambda n: " ".join(rng.choices(words, [1 / (i + 1) for i in range(600)], k=n))
    docs = [(i, draw(rng.randrange(1, 60))) for i in range(700)]
    docs += [(1000 + i, docs[i][1]) for i in range(30)] + [(2000, ""), (2001, None)]
    asked = [(q, draw(12)) for q in range(25)] + [(30, "w0"), (31, "w0 w0 w1"), (32, "w599 w598"), (33, "unknown"), (34, "")]
    index = lexical.build(spark.createDataFrame(docs, "chunk_id long, text string"))
    terms = lexical.query_terms(spark.createDataFrame(asked, "query_id long, query string"))
    got = [tuple(r) for r in lexical.search(index, terms, 5).collect()]
    want = brute_bm25([(i, t or "") for i, t in docs], asked, 5)
    assert sorted(r[:3] for r in got) == sorted(r[:3] for r in want)
    assert [r[3] for r in sorted(got)] == pytest.approx([r[3] for r in sorted(want)])
    share = lexical._Scorer(lexical.K1, lexical.B, index.corpus_stats.first().avgdl)
    found, others = lexical.candidates(index, lexical._weighted(index, terms, share), share, 5)
    pairs = index.postings.join(terms, "term").select("query_id", "id").distinct().count()
    assert 5 * 25 <= found.count() < pairs / 5 or left == 1.0


def test_bm25_by_hand(spark, tmp_path):
    docs = spark.createDataFrame([("c1", "red red fish"), ("c2", "blue fish and more words"), ("c3", ""), ("c4", None)], "chunk_id string, text string")
    qs = spark.createDataFrame([(1, "red fish fish"), (2, "nothing")], "query_id long, query string")
    index = lexical.build(docs)
    index.write(str(tmp_path / "i"))
    got = lexical.search(lexical.Bm25Index.read(spark, str(tmp_path / "i")), lexical.query_terms(qs)).collect()
    n, avg = 4, 8 / 4
    idf = lambda df: math.log(1 + (n - df + 0.5) / (df + 0.5))
    part = lambda tf, dl: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    want = [("c1", idf(1) * part(2, 3) + 2 * idf(2) * part(1, 3)), ("c2", 2 * idf(2) * part(1, 5))]
    assert [(r.id, r.rank) for r in got] == [("c1", 1), ("c2", 2)]
    assert all(math.isclose(r.score, s, abs_tol=1e-8) for r, (_, s) in zip(got, want, strict=True))
    assert lexical.search(lexical.for_queries(docs, lexical.query_terms(qs)), lexical.query_terms(qs)).collect() == got


def test_bm25_in_all_alphabets_equals_brute_force(spark):
    words = lambda t: [m.group(0).lower() for m in re.finditer(TOKEN.replace("(?iuU)", ""), t, re.I)]
    docs = {r.doc_id: words(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    asked = {r.query_id: words(r.query) for r in catalog.corpora.queries(spark, SF).collect()}
    counts, n, avg = {d: Counter(w) for d, w in docs.items()}, len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(t for c in counts.values() for t in c)
    want = set()
    for q, terms in asked.items():
        scores = {}
        for d, c in counts.items():
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * len(docs[d]) / avg)) for t in terms if c[t])
            if round(s, 9) > 0:
                scores[d] = round(s, 9)
        want |= {(q, i + 1, d, round(s, 6)) for i, (d, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:10])}
    got = {(r.query_id, r.rank, r.doc_id, round(r.score, 6)) for r in catalog.bm25_topk(spark, SF).collect()}
    assert sorted(got - want) == sorted(want - got) == []


def test_fusion(spark):
    a = spark.createDataFrame([(1, "c1", 1, 9.0), (1, "c2", 2, 8.0)], HITS)
    b = spark.createDataFrame([(1, "c2", 1, 0.9), (1, "c3", 2, 0.8)], HITS)
    got = fusion.reciprocal_rank_fusion({"bm25": a, "dense": b}).orderBy("rank").collect()
    assert [r.id for r in got] == ["c2", "c1", "c3"] and got[0].bm25_rank == 2 and got[1].dense_score is None
    assert fusion.reciprocal_rank_fusion({"bm25": a.limit(0), "dense": b.limit(0)}).count() == 0
    assert [r.hybrid_score for r in fusion.hybrid(a, None, "bm25_only").orderBy("rank").collect()] == [9.0, 8.0]
    assert fusion.reciprocal_rank_fusion({}).count() == 0


def test_boost(spark):
    kind = "query_id long, id string, rank int, hybrid_score double, text string, document_name string, section string"
    hits = spark.createDataFrame([(1, "c1", 1, 0.03, "other", "x_guidelines.pdf", None), (1, "c2", 2, 0.02, "see section 3(1)(a)", "patents_act.pdf", "Section 13"), (2, "c1", 1, 0.03, "t", "d", None), (2, "c2", 2, 0.02, "t", "d", None)], kind)
    qs = spark.createDataFrame([(1, "Section 3(1)(a) of the Patents Act"), (2, "no reference")], "query_id long, query string")
    got = fusion.reference_boost(hits, qs).orderBy("query_id", "rank").collect()
    assert [r.id for r in got] == ["c2", "c1", "c1", "c2"]
    assert math.isclose(got[0].boosted_score, 0.02 + 0.020 + 0.010 + 0.015) and math.isclose(got[1].boosted_score, 0.03 - 0.005) and got[2].boosted_score == 0.03


def test_filters(spark):
    df = spark.createDataFrame([(1, "A", ["x", "y"]), (2, None, None), (3, "B", ["z"])], "i int, kind string, tags array<string>")
    ids = lambda x: [r.i for r in x.orderBy("i").collect()]
    assert ids(fusion.filtered(df, {"kind": "A", "tags": ["y"], "unknown": 1})) == [1, 2]
    assert ids(df.filter(vectors.must_match(df, {"kind": ["A", "B"], "tags": "z"}))) == [3]


def test_dense_search_and_store(spark):
    rows = spark.createDataFrame([(i, [math.cos(i / 9), math.sin(i / 9)], i % 2) for i in range(50)] + [(99, None, 0)], "vec_id long, embedding array<double>, label int")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert [r.id for r in vectors.search(rows, q, 3).orderBy("rank").collect()] == [0, 1, 2]
    assert [r.id for r in vectors.search(rows, q, 3, {"label": 1}).orderBy("rank").collect()] == [1, 3, 5]
    assert vectors.search(rows, q.limit(0), 3).count() == 0 and vectors.search(rows.limit(0), q, 3).count() == 0
    with pytest.raises(ValueError):
        vectors.check_store(rows.filter("embedding IS NOT NULL"), 3, "cosine")


def test_embedding_cache(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "text a"), ("b", "text b")], "chunk_id string, embedding_text string")
    make = lambda m: vectors.make_embedder("hash", m)
    first = vectors.generate(chunks, make("hash-16"), "hash", "hash-16", None, True)
    files.write_embeddings(first, str(tmp_path / "e"))
    cache = files.read_embeddings(spark, str(tmp_path / "e"))
    plan = lambda m: Counter(r.action for r in vectors.cache_plan(vectors.with_cache_key(chunks, "hash", m, None, True), cache).collect())
    assert plan("hash-16") == {"hit": 2} and plan("hash-8") == {"miss": 2}
    again = {r.chunk_id: r.embedding for r in vectors.generate(chunks, make("hash-16"), "hash", "hash-16", None, True, cache).collect()}
    assert again == {r.chunk_id: r.embedding for r in first.collect()} and len(again["a"]) == 16
    assert math.isclose(sum(x * x for x in again["a"]), 1) and vectors.HashEmbedder("other").dimension == 128
    with pytest.raises(ValueError):
        make_unknown = vectors.make_embedder("unknown", "m")
        make_unknown()


def test_evidence(spark):
    kind = "query_id long, id string, rank int, rerank_score double, text string, document_name string, section string, page_start int, page_end int"
    hits = spark.createDataFrame([(1, "a", 1, 0.6, "text a", "doc", "S", 0, 2), (1, "b", 2, 0.2, "text b", "doc", None, None, None), (2, "a", 1, 0.1, "t", "d", None, 1, 1), (3, "a", 1, None, "t", "d", None, 1, 1)], kind)
    qs = spark.createDataFrame([(i, f"q{i}") for i in range(1, 5)], "query_id long, query string")
    pack = evidence.evidence_pack(hits)
    assert {r.query_id: (r.confidence, r.grounded) for r in evidence.grounding(qs, pack).collect()} == {1: ("high", True), 2: ("low", False), 3: ("medium", True), 4: ("none", False)}
    said = {r.query_id: r for r in evidence.extractive_answer(qs, pack).collect()}
    assert said[1].answer == "Based on doc [1]: text a...\nBased on doc [2]: text b..." and said[1].confidence == "dummy" and said[4].answer == evidence.ABSTENTION
    p = {r.query_id: r.prompt for r in evidence.prompt(qs, pack).collect()}
    assert "--- [1] doc — S (p.0-2) ---\ntext a\n" in p[1] and p[4].startswith("QUESTION: q4")

    def factory():
        def run(prompt):
            if "q3" in prompt:
                raise RuntimeError("timed out")
            return "fine"

        return run

    got = {r.query_id: (r.confidence, r.grounded) for r in evidence.answered(qs, pack, factory).collect()}
    assert got == {1: ("high", True), 2: ("low", False), 3: ("error", False), 4: ("none", False)}
    shown = spark.createDataFrame([("LLM generation failed: x",), ("ok",)], "a string").select(evidence.sanitized(F.col("a"))).collect()
    assert shown[0][0] == evidence.UNREACHABLE and shown[1][0] == "ok"


def test_model_rerank(spark):
    hits = spark.createDataFrame([(1, "a", 1, "q", "long text"), (1, "b", 2, "q", "x")], "query_id long, id string, rank int, query string, text string")
    scored = fusion.scored(hits, lambda: lambda pairs: [-len(t) for _, t in pairs])
    assert [r.id for r in fusion.rerank(scored, F.col("model_score"), 1).collect()] == ["b"]


def test_index_audit_of_a_sound_index(spark):
    from codexlake.functions.text import hash_parts

    chunks = spark.createDataFrame([("a", "t", "e", 0, ("p.pdf", 0, 0))], "chunk_id string, text string, embedding_text string, position long, provenance struct<relative_path:string,pdf_page_start:int,pdf_page_end:int>")
    made = chunks.select("chunk_id", F.array(F.lit(1.0)).alias("embedding"), F.lit(1).alias("embedding_dimension"), F.lit("hash").alias("embedding_provider"), F.lit("m").alias("embedding_model"), F.lit(None).cast("string").alias("model_revision"), F.lit(True).alias("normalized"), hash_parts(F.col("embedding_text")).alias("embedding_input_sha256"))
    manifest = {"embedding_dimension": 1, "embedding_provider": "hash", "embedding_model": "m", "embedding_model_revision": None, "embedding_normalize": True}
    found = audit.with_verdict(audit.index_findings(chunks, made, manifest, chunks.select("chunk_id", "position"), {"indexed_chunks": 1}))
    assert [r.code for r in found.collect()] == ["INDEX_VALIDATION_PASS"]
    assert {r.code for r in audit.index_findings(chunks, made, manifest, None, {"indexed_chunks": 1}).collect()} == {"BM25_INDEX_MISSING"}


def test_stored_indexes_and_their_validation_later(spark, tmp_path):
    raw = spark.createDataFrame(
        [(f"Dataset_1/{n}.pdf", i, f"Head\n{i}. Title of {n}. " + f"some words of {n} " * 6, False, None) for n in "abc" for i in range(1, 4)],
        "relative_path string, page_index int, raw_text string, extraction_failed boolean, failure_reason string",
    )
    given = raw.groupBy("relative_path").agg(F.count("*").cast("int").alias("page_count"), F.max("relative_path").alias("source_sha256"))
    x = pipelines.ingest(given, raw, size=30, overlap=5)
    pairs = spark.createDataFrame([("Dataset_1/a.pdf", "elsewhere.pdf")], "left_path string, right_path string")
    config, path, now = catalog.INDEX_CONFIG, str(tmp_path / "indexes"), {"corpus_id": "corpus", "manifest_hash": "a"}
    build = lambda chunks, **kw: pipelines.build_indexes(chunks, pairs, vectors.make_embedder("hash", "hash-16"), "hash", "hash-16", "deterministic", **kw)
    pipelines.write_indexes(build(x.chunks), x.documents, path, config)
    n = x.chunks.count()
    left = x.chunks.filter("provenance.relative_path = 'Dataset_1/a.pdf'").count()
    m = spark.read.json(f"{path}/manifest").first()
    assert (m.total_source_chunks, m.skipped_chunks, m.collision_chunks) == (n, left, left) and left > 0
    assert m.indexed_chunks == m.embedded_chunks == m.bm25_indexed_chunks == m.vector_points == n - left and m.embedding_dimension == 16
    read = lambda t: spark.read.parquet(f"{path}/{t}").collect()
    assert {r.reason for r in read("skipped_chunks")} == {"content_collision"} == {r.reason for r in read("skipped_documents")}
    assert [r.relative_path for r in read("collision_documents")] == ["Dataset_1/a.pdf"]
    codes = lambda *a, **kw: {r.code for r in pipelines.revalidate(spark, *a, **kw).collect()}
    assert codes(path, x.chunks, pairs, now) == {"INDEX_VALIDATION_PASS"}

    changed = x.chunks.withColumn("embedding_text", F.concat("embedding_text", F.lit(" anew")))
    assert codes(path, changed, pairs, now | {"manifest_hash": "b"}) == {"EMBEDDING_INPUT_HASH_MISMATCH", "SOURCE_CORPUS_MANIFEST_HASH_MISMATCH"}
    fewer = x.chunks.filter("provenance.relative_path != 'Dataset_1/c.pdf'")
    gone = {"EMBEDDING_CHUNK_ID_MISMATCH", "BM25_COUNT_MISMATCH", "BM25_INDEX_CHUNK_ORDER_MISMATCH", "BM25_INDEX_COUNT_MISMATCH", "VECTOR_COUNT_MISMATCH", "VECTOR_UNKNOWN_CHUNK_ID", "VECTOR_PAYLOAD_CHUNK_ID_MISMATCH"}
    assert codes(path, fewer, pairs, now) == gone

    (tmp_path / "indexes/bm25_chunks").rename(tmp_path / "taken")
    assert codes(path, x.chunks, pairs, now) == {"BM25_INDEX_MISSING"}
    part = str(tmp_path / "part")
    pipelines.write_indexes(build(x.chunks, skip_bm25=True, skip_vectors=True), x.documents, part, config)
    assert codes(part, x.chunks, pairs, now) == {"INDEX_VALIDATION_PASS"}
    with pytest.raises(ValueError, match="embeddings"):
        build(x.chunks, skip_embeddings=True)


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "in" / "Dataset_1").mkdir(parents=True)
    (tmp_path / "in" / "Dataset_1" / "a.PDF").write_bytes(b"x")
    (tmp_path / "in" / "b.txt").write_bytes(b"y")
    got = files.inventory(spark, str(tmp_path / "in")).collect()
    assert [(r.relative_path, r.dataset_id) for r in got] == [("Dataset_1/a.PDF", "Dataset_1")]
    rows = catalog.chunks(spark, SF).select("chunk_id", "text")
    files.write_json_lines(rows, str(tmp_path / "j"))
    assert files.read_json_lines(spark, str(tmp_path / "j")).select("chunk_id", "text").count() == rows.count()
    assert files.read_json_lines(spark, str(tmp_path / "j")).schema == files.CHUNK


def test_stream_of_queries(spark, tmp_path):
    index = lexical.build(spark.createDataFrame([("c1", "red fish")], "chunk_id string, text string"))
    spark.createDataFrame([(1, "red")], "query_id long, query string").write.parquet(str(tmp_path / "q"))
    seen = []
    s = live.bm25_stream(spark.readStream.schema("query_id long, query string").parquet(str(tmp_path / "q")), index, lambda df, n: seen.extend(df.collect()), str(tmp_path / "c"))
    s.processAllAvailable()
    s.stop()
    assert [r.id for r in seen] == ["c1"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {p.rsplit('/', 1)[1][:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    r = duck.execute(oracles.oracle_sql()[name])
    cols = [x[0] for x in r.description]
    df = catalog.queries()[name](spark, SF)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted(df.columns) == sorted(cols)
    assert Counter(tuple(plain(x[k]) for k in cols) for x in df.collect()) == Counter(tuple(map(plain, x)) for x in r.fetchall())


def test_results_do_not_depend_on_partitions(spark, monkeypatch):
    want = Counter(map(tuple, catalog.chunks(spark, SF).collect()))
    real = catalog.corpora.table
    monkeypatch.setattr(catalog.corpora, "table", lambda s, d, n: real(s, d, n).repartition(7, F.rand(3)))
    assert Counter(map(tuple, catalog.chunks(spark, SF).collect())) == want


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["query_id", "answer", "confidence", "grounded"] and df.count() == 5 + 200 // 50
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_dense_search_in_blocks_takes_all_queries(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(vectors, "MAX_QUERIES", 2)
    path = "/root/testdata/sf0.001"
    from codexlake import catalog

    rows = spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").collect()
    m = np.array([r.embedding for r in rows], np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = set()
    for i, r in enumerate(rows):
        if r.vec_id % 50 == 0:
            near = sorted((-x, o.vec_id) for x, o in zip(np.round(m @ m[i], 9), rows, strict=True))[:10]
            want |= {(r.vec_id, k, v) for k, (_, v) in enumerate(near, 1)}
    got = [(x.query_id, x["rank"], x.vec_id) for x in catalog.dense_topk(spark, path).collect()]
    assert len(got) == len(want) and set(got) == want and len({q for q, *_ in got}) > 2


@pytest.mark.parametrize("kind", ["clusters", "noise"])
def test_index_search_is_exact_and_leaves_batches_out(spark, monkeypatch, kind):
    """Ties by copies, a null and equal query ids; of clustered vectors most batches are never opened."""
    import numpy as np

    monkeypatch.setattr(vectors, "BATCH_VECTORS", 16)
    monkeypatch.setattr(vectors, "BATCH_QUERIES", 5)
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 24)) * (3 if kind == "clusters" else 0)
    v = (centers[rng.integers(0, 12, 900)] + rng.normal(size=(900, 24)) * 0.3).round(4)
    v[500:540] = v[7]  # ties
    q = np.concatenate([v[::60], (centers[:5] + rng.normal(size=(5, 24))).round(4), np.zeros((1, 24))])
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(5000, None)], "vec_id long, embedding array<double>").repartition(5)
    asked = spark.createDataFrame([(min(i, 18), x.tolist()) for i, x in enumerate(q)], "query_id long, embedding array<double>")
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    pooled = {}
    for i, s in enumerate(np.round(unit(q) @ unit(v).T, 9)):
        pooled.setdefault(min(i, 18), []).extend(sorted((-x, j) for j, x in enumerate(s))[:6])
    want = sorted((i, k, j, -x) for i, p in pooled.items() for k, (x, j) in enumerate(sorted(p)[:6], 1))
    index = vectors.build_index(table, clusters=16)
    assert max(r.n for r in index.batches.select(F.size("v").alias("n")).collect()) < 60
    seen = []
    scored = vectors._scored
    monkeypatch.setattr(vectors, "_scored", lambda i, q, pairs, *a: seen.append(pairs) or scored(i, q, pairs, *a))
    got = sorted((r.query_id, r["rank"], r.id, r.score) for r in vectors.search_index(index, asked, 6).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want] and [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=2e-9)
    assert [g[2] for g in got if g[0] < 18] == [w[2] for w in want if w[0] < 18]
    opened, pairs = sum(p.count() for p in seen), index.batches.count() * len(q)
    print(f"{kind}: {opened} of {pairs} pairs of query and batch opened")
    assert opened < pairs / 3 if kind == "clusters" else opened <= pairs
    assert vectors.build_index(table.filter("vec_id = 5000")) is None
    assert vectors.search(table.limit(0), asked, 6).count() == 0
    monkeypatch.setattr(vectors, "MAX_QUERIES", 0)
    assert vectors.search(table.limit(0), asked, 6).count() == 0 and vectors.search(table, asked.limit(0), 6).count() == 0


def test_a_cache_is_made_once(spark, tmp_path):
    log = str(tmp_path / "embedded")

    def factory():
        class Logged(vectors.HashEmbedder):
            def encode(self, texts):
                with open(log, "a") as f:
                    f.write("x\n" * len(texts))
                return super().encode(texts)

        return Logged("hash-8", None, True)

    rows = spark.createDataFrame([(str(i), f"text {i}") for i in range(6)], "chunk_id string, embedding_text string")
    cache = vectors.generate(rows.filter("chunk_id < 4"), factory, "hash", "hash-8", None, True)
    got = vectors.generate(rows, vectors.make_embedder("hash", "hash-8"), "hash", "hash-8", None, True, cache, dimension=8).collect()
    assert sorted((r.chunk_id, r.cached) for r in got) == [(str(i), i < 4) for i in range(6)]
    with open(log) as f:
        assert len(f.readlines()) == 4
