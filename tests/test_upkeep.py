"""Runs that go on after failures, runs over what is stored, embedding caches and vector stores."""

import uuid

import pytest
from pyspark.sql import functions as F

from codexlake.operators import chunking, fusion, quality, vectors
from codexlake.plans import pipelines
from codexlake.sources import files as sources
from codexlake.sources.snapshots import Snapshots
from codexlake.sources.stage import shared_folder

RAW = "relative_path string, page_index int, raw_text string, extraction_failed boolean, failure_reason string, error string"
FILE = "relative_path string, source_sha256 string, page_count int"


def new_store(spark, key, buckets=8):
    return Snapshots(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", key, buckets)


def corpus(spark, names, changed=(), broken=(), pages=2):
    text = lambda n, i: f"{i + 1}. Title of {n}.\n\n" + f"Some words of law in {n}, {'anew' if n in changed else 'once'}. " * 9
    raw = [(f"D/{n}.pdf", i, text(n, i), False, None, "cannot be opened" if n in broken and i == 0 else None) for n in names for i in range(pages)]
    return spark.createDataFrame([(f"D/{n}.pdf", f"{n}{n in changed}", pages) for n in names], FILE), spark.createDataFrame(raw, RAW)


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_one_poisoned_document_of_a_hundred_fails_alone(spark):
    def cut(text, most):
        if "doc41," in text:
            raise ValueError("a poisoned block")
        return chunking.split_large(text, most)

    names = [f"doc{i}" for i in range(100)]
    files, raw = corpus(spark, names, pages=1)
    raw = raw.withColumn("raw_text", F.concat("raw_text", F.repeat(F.concat(F.lit("more of "), F.regexp_extract("relative_path", r"(\w+)\.pdf", 1), F.lit(", ")), 400)))
    x = pipelines.ingest(files, raw.drop("error"), size=200, overlap=20, cut=cut)
    assert x.chunks.select("document_id").distinct().count() == 99
    found = {(r.severity, r.relative_path, r.message) for r in x.findings.filter("code = 'DOCUMENT_PROCESSING_FAILED'").collect()}
    assert found == {("CRITICAL", "D/doc41.pdf", "D/doc41.pdf: ValueError: a poisoned block")}
    failed = x.documents.filter("failure_reason IS NOT NULL").collect()
    assert [(r.relative_path, r.page_count, r.title, r.document_type) for r in failed] == [("D/doc41.pdf", 0, None, "Other")]
    assert x.findings.filter("code = 'DOCUMENT_PROCESSED'").count() == 99 and x.pages.count() == 99
    told = {r.relative_path: r.validation_status for r in quality.manifest_documents(x.documents, x.chunks, x.findings).collect()}
    assert told["D/doc41.pdf"] == "FAILED" and len(told) == 100
    with pytest.raises(Exception, match="cannot pack"):
        bad = spark.createDataFrame([("d", 1, None, 1, 1, 1, 1)], "document_id string, block_no int, text string, page_start int, page_end int, printed_page_start int, printed_page_end int")
        chunking.pack(bad).collect()


def test_a_long_document_is_packed_from_a_stream(spark):
    """Blocks of one document in many batches give the chunks of one walk."""
    kind = "document_id string, block_no int, text string, page_start int, page_end int, printed_page_start int, printed_page_end int"
    blocks = [(d, i, f"Block {i} of {d}. " * (i % 9 + 1), i, i, None, i) for d in ("a", "b") for i in range(400)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = chunking.pack(spark.createDataFrame(blocks[::-1], kind), 60, 9).orderBy("document_id", "chunk_index").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for d in ("a", "b"):
        p = chunking.Packer(60, 9)
        keys = kind.replace(" string", "").replace(" int", "").split(", ")
        want += [(d, c["text"], c["first_block"], c["page_end"]) for b in blocks if b[0] == d for c in p.add(dict(zip(keys, b, strict=True)))] + [(d, c["text"], c["first_block"], c["page_end"]) for c in p.end()]
    assert [(r.document_id, r.text, r.first_block, r.page_end) for r in got] == want and len(want) > 50


def test_raw_pages_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def told(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    files, raw = corpus(spark, ["a", "b", "c"], broken=("c",))
    x = pipelines.ingest(files, raw.mapInArrow(told, raw.schema))
    assert x.pages.count() == 4 and made.value == 6


def test_a_second_run_touches_what_changed(spark):
    store = new_store(spark, "document_id")
    names = [f"n{i}" for i in range(30)]
    first = pipelines.ingest_again(*corpus(spark, names, broken=("n3",)), store, size=30, overlap=5)
    assert {r.action for r in first.actions.collect()} == {"process"} and first.corpus.documents.filter("failure_reason IS NOT NULL").count() == 1
    before = {(r.name, r.bucket): r.path for r in store.listed()}
    again = pipelines.ingest_again(*corpus(spark, [*names[1:], "new"], changed=("n7",)), store, size=30, overlap=5)
    id_of = {r.relative_path[2:-4]: r.document_id for r in again.corpus.documents.collect()}
    did = {r.document_id: r.action for r in again.actions.collect()}
    assert {n: did[id_of[n]] for n in ("n7", "new", "n3", "n9")} == {"n7": "process", "new": "process", "n3": "process", "n9": "reuse"}
    assert sorted(did.values()) == ["process"] * 3 + ["remove"] + ["reuse"] * 27
    whole = pipelines.ingest(*corpus(spark, [*names[1:], "new"], changed=("n7",)), size=30, overlap=5)
    for t in ("documents", "pages", "blocks", "chunks", "findings"):
        assert rows(getattr(again.corpus, t)) == rows(getattr(whole, t)), t
    after = {(r.name, r.bucket): r.path for r in store.listed()}
    kept = [k for k in after if k[1] >= 0 and before.get(k) == after[k]]
    assert len([k for k in kept if k[0] == "chunks"]) >= 2  # buckets without a changed document keep their files
    same = pipelines.ingest_again(*corpus(spark, [*names[1:], "new"], changed=("n7",)), store, size=30, overlap=5)
    assert {r.action for r in same.actions.collect()} == {"reuse"} and {k: p for k, p in {(r.name, r.bucket): r.path for r in store.listed()}.items()} == after
    forced = pipelines.ingest_again(*corpus(spark, names[:3]), store, size=31, overlap=5)
    assert sorted(r.action for r in forced.actions.collect()) == ["process"] * 3 + ["remove"] * 28 and forced.corpus.documents.count() == 3


def test_a_lost_writer_leaves_the_last_snapshot(spark):
    store = new_store(spark, "k", 4)
    assert store.current() is None
    table = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    store.update({"t": table(("a", 1), ("b", 2), ("c", 3)), "empty": table()})
    with pytest.raises(ZeroDivisionError):

        class Lost(dict):
            def items(self):
                yield "t", table(("a", 9))
                raise ZeroDivisionError

        store.update(Lost(), table(("a", 0)).select("k"))
    assert rows(store.current()["t"]) == rows(table(("a", 1), ("b", 2), ("c", 3))) and store.current()["empty"].columns == ["k", "v"]
    store.update({"t": table(("a", 5), ("d", 4)), "empty": table()}, spark.createDataFrame([("a",), ("d",), ("b",), ("zz",)], "k string"))
    assert rows(store.current()["t"]) == rows(table(("a", 5), ("d", 4), ("c", 3)))
    store.update({"t": table(), "empty": table()}, table(("a", 0), ("c", 0), ("d", 0)).select("k"))
    assert store.current()["t"].count() == 0 and store.current()["t"].columns == ["k", "v"]


def test_pages_from_a_users_reader(spark):
    def factory():
        def read(path, content):
            for part in content.decode().split("|"):
                if part == "boom":
                    raise OSError(f"{path} is torn")
                yield part or None

        return read

    files = spark.createDataFrame([("a", b"one|two"), ("b", b"x|boom|y"), ("c", b"|z")], "relative_path string, content binary")
    got = sorted(tuple(r) for r in sources.extracted(files, factory).collect() if r.error is None)
    assert got == [("a", 0, "one", False, None, None), ("a", 1, "two", False, None, None), ("b", 0, "x", False, None, None), ("c", 0, "", True, "no text", None), ("c", 1, "z", False, None, None)]
    raw = sources.extracted(files, factory)
    x = pipelines.ingest(files.select("relative_path", F.sha2("content", 256).alias("source_sha256"), F.lit(2).alias("page_count")), raw)
    assert [(r.relative_path, r.failure_reason) for r in x.documents.filter("failure_reason IS NOT NULL").collect()] == [("b", "OSError: b is torn")]
    assert x.pages.select("relative_path").distinct().count() == 2


CHUNKS = [("c1", "red fish"), ("c2", "blue fish"), ("c3", "red fish"), ("c4", "tree")]


def counted(calls):
    class Counting(vectors.HashEmbedder):
        def encode(self, texts):
            with open(calls, "a") as f:
                f.writelines(f"{t}\n" for t in texts)
            return super().encode(texts)

    return lambda: Counting("hash-8")


def generate(spark, factory, cache=None, chunks=CHUNKS, **options):
    df = spark.createDataFrame(chunks, "chunk_id string, embedding_text string")
    return vectors.generate(df, factory, "hash", "hash-8", "deterministic", True, cache, **options)


def test_each_text_is_embedded_once(spark, tmp_path):
    calls = str(tmp_path / "calls")
    got = {r.chunk_id: r for r in generate(spark, counted(calls)).collect()}
    assert sorted(open(calls).read().split("\n")[:-1]) == ["blue fish", "red fish", "tree"]
    assert got["c1"].embedding == got["c3"].embedding != got["c2"].embedding and got["c1"].cache_key != got["c3"].cache_key


def test_a_cached_record_must_fit_in_everything(spark, tmp_path):
    made = generate(spark, lambda: vectors.HashEmbedder("hash-8"))
    twice = made.withColumn("at", F.lit(1)).union(made.withColumn("at", F.lit(2)))
    x = generate(spark, lambda: vectors.HashEmbedder("hash-8"), twice, order="at")
    assert x.count() == 4 and tuple(vectors.cache_counts(x).first()) == (4, 0, 8)
    assert generate(spark, lambda: vectors.HashEmbedder("hash-8"), made.union(made)).count() == 4
    other = {
        "cache_key": F.lit("k"), "embedding_input_sha256": F.lit("h"), "embedding_provider": F.lit("p"), "embedding_model": F.lit("m"), "model_revision": F.lit(None).cast("string"), "normalized": F.lit(False),
        "embedding_dimension": F.lit(7), "embedding": F.slice("embedding", 1, 7), "indexing_version": F.lit("0"),
    }
    for name, value in other.items():
        cache = made.withColumn(name, F.when(F.col("chunk_id") == "c2", value).otherwise(F.col(name)))
        y = generate(spark, lambda: vectors.HashEmbedder("hash-8"), cache)
        assert {r.chunk_id for r in y.collect() if not r.cached} == {"c2"} and y.count() == 4, name
    # the last record wins, and is then looked at: one that no longer fits is not replaced by an earlier one
    late = made.withColumn("at", F.lit(1)).union(made.filter("chunk_id = 'c4'").withColumn("embedding_model", F.lit("m")).select(*made.columns).withColumn("at", F.lit(2)))
    assert {r.chunk_id for r in generate(spark, lambda: vectors.HashEmbedder("hash-8"), late, order="at").collect() if not r.cached} == {"c4"}
    assert generate(spark, lambda: vectors.HashEmbedder("hash-8"), made, chunks=[]).count() == 0


def test_sync_writes_buckets_that_changed(spark):
    store = new_store(spark, "point_id", 16)
    point = lambda i, v: (f"p{i}", f"h{i}{v}", [float(i)])
    table = lambda r: spark.createDataFrame(r, "point_id string, content_hash string, embedding array<double>")
    old = [point(i, "a") for i in range(60)]
    assert {r.action for r in vectors.sync(table(old), store).collect()} == {"insert"}
    before = {r.bucket: r.path for r in store.listed()}
    new = [point(i, "b" if i == 7 else "a") for i in range(60) if i != 9] + [point(99, "a")]
    did = {r.point_id: r.action for r in vectors.sync(table(new), store).collect()}
    assert {k: v for k, v in did.items() if v != "keep"} == {"p7": "update", "p9": "delete", "p99": "insert"} and len(did) == 61
    assert rows(store.current()["points"]) == rows(table(new))
    after = {r.bucket: r.path for r in store.listed()}
    moved = {b for b in after if b >= 0 and after[b] != before.get(b)}
    assert 1 <= len(moved) <= 3 and len(after) > 10
    chunks = spark.createDataFrame([("c1", "t")], "chunk_id string, text string")
    a = vectors.points_of(chunks, spark.createDataFrame([("c1", [1.0])], "chunk_id string, embedding array<double>")).first()
    b = vectors.points_of(chunks, spark.createDataFrame([("c1", [2.0])], "chunk_id string, embedding array<double>")).first()
    assert a.content_hash != b.content_hash and a.point_id == b.point_id == str(uuid.uuid5(uuid.NAMESPACE_URL, "chunks:c1"))


def test_projection_of_hits_without_a_chunk(spark):
    files, raw = corpus(spark, ["a"])
    chunks = pipelines.ingest(files, raw.drop("error"), size=30, overlap=5).chunks
    one = chunks.orderBy("chunk_index").first()
    hits = spark.createDataFrame([(1, 1, one.chunk_id, 0.5), (1, 2, "gone", 0.25)], "query_id long, rank int, id string, score double")
    a, b = fusion.projected(hits, chunks, method="dense").orderBy("rank").collect()
    assert (a.chunk_id, a.text, a.source_path, a.section, a.pdf_page_start, a.retrieval_method) == (one.chunk_id, one.text, "D/a.pdf", one.provenance.section, 1, "dense")
    assert b.chunk_id == "gone" and b.text is None and b.content_collision is False and b.score == 0.25
