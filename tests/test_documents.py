"""Structure, chunks and findings."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from codexlake.operators import chunking, joins, quality, structure
from codexlake.plans import pipelines

PAGES = "document_id string, page_index int, printed_page_number int, text string"


def context_of(spark, lines):
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(lines)], "document_id string, line_no int, text string")
    return [r.structure.asDict() for r in structure.with_context(df, ["line_no"]).orderBy("line_no").collect()]


def test_context_of_a_statute(spark):
    s = context_of(spark, ["CHAPTER I", "2. Definitions.", "(1) In this Act", "(a) first"])[-1]
    assert (s["chapter"], s["section"], s["subsection"], s["clause"]) == ("CHAPTER I", "Section 2", "(1)", "(a)")
    s = context_of(spark, ["3. x", "(2) y", "(b) z", "Provided that q", "4. next"])
    assert s[3]["proviso"] == "Provided that" and s[4]["subsection"] is None and s[4]["proviso"] is None and s[4]["section"] == "Section 4"
    assert context_of(spark, ["THE FIRST SCHEDULE"])[0]["schedule"] == "THE"
    s = context_of(spark, ["Ram v. State", "Court of Appeal said", "A vs. B", "JUDGMENT"])[-1]
    assert s["case_name"] == "Ram v. State" and s["court"] == "Court of Appeal said" and s["judgment"] == "JUDGMENT"


def test_context_equals_a_line_by_line_reading(spark):
    rng = random.Random(1)
    pool = ["CHAPTER I", "PART II", "3. a", "7. b", "(1) c", "(2) d", "(a) e", "(bc) f", "(xviii) g", "Provided that h", "Explanation 1", "Article 5", "Rule 2", "plain text", "Regulation 4", "SCHEDULE I", ""]
    lines = [rng.choice(pool) for _ in range(150)]
    state = dict.fromkeys(structure.KEYS)
    for line, got in zip(lines, context_of(spark, lines), strict=True):
        for key, pattern, _ in structure.PATTERNS:
            flags = re.I if "i" in pattern.split(")")[0] else 0
            m = re.search(re.sub(r"^\(\?\w+\)", "", pattern), line, flags)
            if m:
                value = " ".join(next(g for g in m.groups() if g).split())
                state[key] = f"Section {value}" if key == "section" else value
                for k, by in structure.CLEARED_BY.items():
                    if key in by:
                        state[k] = None
                break
        assert got == state


def test_blocks(spark):
    df = spark.createDataFrame([("d", 0, 9, "CHAPTER I\n\nintro words\n\n2. Title. text"), ("d", 1, 10, "more on it\n\nProvided that this holds"), ("e", 0, None, "one\ntwo"), ("f", 0, None, " ")], PAGES)
    b = [r for r in structure.structural_blocks(df).orderBy("document_id", "block_no").collect()]
    assert [(r.document_id, r.n_paras, r.page_start, r.page_end, r.structure.section) for r in b] == [("d", 2, 1, 1, None), ("d", 3, 1, 2, "Section 2"), ("e", 2, 1, 1, None)]
    assert b[1].structure.proviso == "Provided that" and b[1].printed_page_end == 10 and b[0].text == "CHAPTER I\n\nintro words"
    assert structure.structural_blocks(df.limit(0)).count() == 0
    assert structure.page_structure(df).filter("document_id = 'd' AND page_index = 1").first().structure.section == "Section 2"


def blocks_of(spark, texts):
    rows = [("d", i + 1, t, i + 2, i + 3, None, 10) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "document_id string, block_no long, text string, page_start int, page_end int, printed_page_start int, printed_page_end int")


def test_packing(spark):
    rng = random.Random(0)
    sentence = lambda: " ".join(f"w{rng.randrange(99)}" for _ in range(9)).capitalize() + "."
    got = chunking.pack(blocks_of(spark, [" ".join(sentence() for _ in range(15)) for _ in range(8)]), 120, 20).orderBy("chunk_index").collect()
    assert len(got) > 1 and all(len(c.text.split()) <= 220 for c in got)
    assert all(set(a.text.split()) & set(b.text.split()) for a, b in zip(got, got[1:], strict=False))
    assert [c.chunk_index for c in got] == list(range(len(got)))
    one = chunking.pack(blocks_of(spark, ["3. Title text"])).collect()
    assert [(c.page_start, c.page_end, c.printed_page_start, c.printed_page_end) for c in one] == [(2, 3, None, 10)]
    assert chunking.pack(blocks_of(spark, [" "])).count() == 0
    huge = chunking.pack(blocks_of(spark, ["word " * 2000]), 600, 80).collect()
    assert max(len(c.text.split()) for c in huge) <= 680 and len(huge) == 4


def test_overlap_tail():
    assert chunking.overlap_tail("One two. Three four. Five six.", 4) == "Three four. Five six."
    assert chunking.overlap_tail("a b c d e", 2) == "d e" and chunking.overlap_tail("a", 0) == ""
    assert list(chunking.split_large("A b. C d e f g.", 3)) == ["A b.", "C d e", "f g."]


def pages_of(spark, rows):
    x = spark.createDataFrame(rows, "document_id string, page_index int, text string")
    return x.withColumn("page_text_sha256", F.sha2("text", 256))


def test_collisions_and_flags(spark):
    rows = [(d, i, f"page {i}") for d in ("a", "b") for i in range(5)] + [("c", i, f"page {i}") for i in range(4)] + [("c", 9, "own"), ("d", 0, "page 0"), ("d", 1, "x"), ("d", 2, "x"), ("e", 0, " ")]
    p = pages_of(spark, rows)
    got = {(r.left_id, r.right_id): r.overlap for r in quality.document_collisions(p).unionByName(quality.copies(p)).collect()}
    assert got == {("a", "b"): 1.0, ("a", "c"): 0.8}
    f = {(r.document_id, r.page_index): (r.duplicate_within_document, r.duplicate_across_documents) for r in quality.with_duplicate_flags(p).collect()}
    assert f["d", 1] == (True, False) and f["d", 0] == (False, True) and f["e", 0] == (False, False) and f["c", 9] == (False, False)


def test_collisions_with_a_page_in_half_of_all_documents(spark, monkeypatch):
    """A form that is in half of all documents, and fills some: no task gets all of its rows."""
    monkeypatch.setattr(joins, "SPLIT_ROWS", 50)
    rows = [(f"d{d:04}", i, t) for d in range(600) for i, t in enumerate([f"own {d}", *(["form", "second form"] if d % 2 else [f"more {d}"])])]
    rows += [(f"e{d}", i, t) for d in range(30) for i, t in enumerate(["form", "second form", f"e {d % 9}", f"f {d // 9}", f"g {d % 2}"])]
    rows += [("only", 0, "form"), ("only", 1, "second form")]
    sets = {}
    for d, _, t in rows:
        sets.setdefault(d, set()).add(t)
    least = {}
    for d in sorted(sets):
        least.setdefault(frozenset(sets[d]), d)
    names = sorted(least.values())
    want = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if 100 * len(sets[a] & sets[b]) >= 80 * min(len(sets[a]), len(sets[b]))}
    assert {(r.left_id, r.right_id) for r in quality.document_collisions(pages_of(spark, rows)).collect()} == want and len(want) > 300
    many = spark.range(20_000).select((F.col("id") % 2).alias("h"), F.col("id").alias("b"))
    few = spark.createDataFrame([(0, 7), (0, 8), (3, 9)], "h long, a int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = joins.split_join(many, few, "h", "b", 500).withColumn("p", F.spark_partition_id())
        assert sorted((r.h, r.a, r["count"]) for r in out.groupBy("h", "a").count().collect()) == [(0, 7, 10_000), (0, 8, 10_000)]
        assert max(r["count"] for r in out.groupBy("p").count().collect()) < 12_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_collisions_equal_all_pairs(spark):
    rng = random.Random(7)
    rows = [(f"d{d:02}", i, f"p{rng.randrange(12)}" if d % 3 else f"p{i}") for d in range(40) for i in range(rng.randint(1, 7))] + [(f"h{i}", 0, "hot") for i in range(60)]
    sets = {}
    for d, _, t in rows:
        sets.setdefault(d, set()).add(t)
    least = {}
    for d in sorted(sets):
        least.setdefault(frozenset(sets[d]), d)
    want = {(a, b) for a in least.values() for b in least.values() if a < b and 100 * len(sets[a] & sets[b]) >= 80 * min(len(sets[a]), len(sets[b]))}
    assert {(r.left_id, r.right_id) for r in quality.document_collisions(pages_of(spark, rows)).collect()} == want


def test_repeated_lines(spark):
    p = pages_of(spark, [("a", i, f"Head\nbody {i}\nmore {i}\nand {i}\nSection foot\nfoot {i}") for i in range(6)] + [("b", i, "Head") for i in range(3)])
    assert [(r.document_id, r.line, r.n) for r in quality.repeated_lines(p).collect()] == [("a", "Head", 6)]


def test_ingest_and_its_findings(spark):
    raw = spark.createDataFrame(
        [("Dataset_1/a.pdf", i, f"Head\n{i}. Title here. " + "some words of law " * 6, False, None) for i in range(1, 5)] + [("Dataset_1/a.pdf", 0, "", True, "broken"), ("x/b.pdf", 0, "short", False, None)],
        "relative_path string, page_index int, raw_text string, extraction_failed boolean, failure_reason string",
    )
    files = spark.createDataFrame([("Dataset_1/a.pdf", "h", 5), ("x/b.pdf", "h", 2), ("x/c.pdf", "z", 0)], "relative_path string, source_sha256 string, page_count int")
    x = pipelines.ingest(files, raw, size=30, overlap=5)
    codes = {r.code for r in x.findings.collect()}
    assert {"PAGE_EXTRACTION_FAILED", "FAILED_PAGES", "EMPTY_PAGES", "EMPTY_PAGE_TEXT", "OCR_NEEDED_BUT_DISABLED", "DUPLICATE_PDF_FILE", "PAGE_COUNT_MISMATCH"} <= codes
    assert x.chunks.count() >= 4 and x.chunks.filter("provenance.section IS NOT NULL").count() >= 3
    s = {r.status for r in quality.document_status(x.documents, x.findings).collect()}
    assert s == {"FAILED", "PASS"}
    only = pipelines.ingest(files, raw, with_chunks=False)
    assert only.chunks.count() == 0 and only.findings.filter("code = 'NO_CHUNKS'").count() == 0
    assert [r.line[:10] for r in quality.report_lines(x.findings).collect()][0] == "[CRITICAL]"
    m = quality.manifest(x.documents, x.pages, x.chunks, x.findings).first()
    assert m.documents_total == 3 and m.pages_total == 6 and m.validation_status == "FAILED"


def test_scratch_tables_go_and_lasting_ones_stay(spark):
    from codexlake.sources import stage

    def there(df):
        return [f for f in df.inputFiles() if os.path.exists(f.removeprefix("file://"))]

    with pytest.raises(RuntimeError), stage.scratch(spark):
        a = stage.stored(spark.range(5), "a")
        with stage.scratch(spark):
            inner = stage.stored(a.withColumn("x", F.lit(1)), "inner")
            b = stage.stored(inner, "b", lasting=True)
            assert there(inner)
        assert there(a) and not there(inner)
        raise RuntimeError
    assert not there(a) and b.count() == 5


def plain_contexts(lines):
    """The context after each (key, value) line, by a walk."""
    now, out = {}, []
    for key, value, text in lines:
        for k, pattern in structure.STICKY.items():
            m = re.search(pattern.replace("(?iU)", "(?i)"), text)
            if m and k not in now:
                now[k] = " ".join(m[1].split())
        if key:
            for k, by in structure.CLEARED_BY.items():
                if key in by:
                    now.pop(k, None)
            now[key] = value
        out.append(dict(now))
    return out


def statute_lines(n, seed=4):
    rng = random.Random(seed)
    kinds = ["CHAPTER {r}", "{i}. Of things", "({i}) a subsection", "({c}) a clause", "Provided that it is so", "Explanation {i}", "Article {i}", "plain words", "", "Asha v. State", "PART {r}", "Supreme Court of India", "THE FIRST SCHEDULE", "JUDGMENT"]
    return [rng.choices(kinds, [1, 2, 5, 6, 2, 1, 1, 12, 4, 1, 1, 1, 1, 1])[0].format(r="IVX"[rng.randrange(3)], i=rng.randrange(1, 9), c="abc"[rng.randrange(3)]) for _ in range(n)]


@pytest.mark.parametrize("span", [1, 7, 10**9])
def test_contexts_and_blocks_of_any_span_equal_a_walk(spark, span):
    texts = {d: statute_lines(n, n) for d, n in (("long", 400), ("short", 5), ("one", 1))}
    df = spark.createDataFrame([(d, i, t) for d, x in texts.items() for i, t in enumerate(x)], "document_id string, line_no int, text string")
    for d, x in texts.items():
        rows = structure.with_context(df.filter(F.col("document_id") == d), ["line_no"], span=span).orderBy("line_no").collect()
        want = plain_contexts([(r.key, r.value, r.text) for r in rows])
        assert [r.text for r in rows] == x
        assert [{k: v for k, v in r.structure.asDict().items() if v is not None} for r in rows] == want
    pages = df.select("document_id", F.floor(F.col("line_no") / 3).cast("int").alias("page_index"), "line_no", "text").groupBy("document_id", "page_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda r: r["text"]), "\n\n").alias("text"))
    got = structure.structural_blocks(pages.withColumn("printed_page_number", F.lit(None).cast("int")), span=span)
    blocks = {(r.document_id, r.block_no): r for r in got.collect()}
    for d, x in texts.items():
        filled = [t for t in x if t]
        at = {i: c for i, c in zip([i for i, t in enumerate(x) if t], plain_contexts([(r.key, r.value, r.text) for r in structure.classified(spark.createDataFrame(list(enumerate(filled)), "i int, text string")).orderBy("i").collect()]), strict=True)}
        want, before = [], None
        for (i, now), t in zip(at.items(), filled, strict=True):
            if before is None or any(k in now and now[k] != before.get(k) for k in structure.BOUNDARIES):
                want.append([])
            want[-1].append(t)
            before = now
            assert i >= 0
        assert ["\n\n".join(b) for b in want] == [blocks[d, n].text for n in range(1, len(want) + 1)]
    assert len(blocks) == len({(d, n) for d, n in blocks})


def test_no_task_sorts_a_whole_document(spark):
    """One document of many lines: what is sorted together is a span, not the document."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lines_ = spark.range(40_000).select(F.lit("d").alias("document_id"), F.col("id").alias("line_no"), F.when(F.col("id") % 1000 == 0, F.concat(F.lit("Article "), F.col("id").cast("string"))).otherwise("words").alias("text"))
        x = structure.with_context(lines_, ["line_no"]).select("line_no", "structure.article", F.spark_partition_id().alias("p"))
        assert x.filter("article != concat('Article ', line_no - line_no % 1000)").count() == 0 and x.filter("article IS NULL").count() == 0
        assert max(r["count"] for r in x.groupBy("p").count().collect()) < 20_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_findings_of_documents_join_the_counts_once(spark):
    docs = spark.createDataFrame([("d", "d.pdf", 3), ("e", "e.pdf", 1)], "document_id string, relative_path string, page_count int")
    pages = spark.createDataFrame([("d", 0, "", False), ("d", 2, "x", True), ("e", 0, "x", False)], "document_id string, page_index int, text string, extraction_failed boolean")
    chunks = spark.createDataFrame([("e", 0, 901)], "document_id string, chunk_index int, token_count int")
    found = quality.document_findings(docs, pages, chunks)
    want = {("d", c) for c in ("PAGE_COUNT_MISMATCH", "PAGE_SEQUENCE_GAP", "EMPTY_PAGES", "FAILED_PAGES", "NO_CHUNKS")} | {("e", "OVERSIZE_CHUNK")}
    assert sorted((r.document_id, r.code) for r in found.collect()) == sorted(want)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 3  # pages, chunks, and the paths of long chunks
