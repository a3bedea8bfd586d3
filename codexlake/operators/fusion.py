"""Joining result lists, filtering, boosting and reranking them. Hits are rows of (query_id, id, ...)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql import types as T

RRF_K, TOP_K, RERANK_TOP_K = 60, 40, 8

#: References that the boost looks for, and the label it looks for them under.
BOOST_REFERENCES = (
    (r"(?iU)\b(?:section|sec\.?)\s+(\d+[a-z]?(?:\(\w+\))*)", "section"),
    (r"(?iU)\b(?:article|art\.?)\s+(\d+[a-z]?(?:\(\w+\))*)", "article"),
    (r"(?iU)\b(?:rule|regulation|reg\.?)\s+(\d+[a-z]?(?:\(\w+\))*)", "rule"),
)
#: Acts that a query names, and what their documents' names contain.
ACTS = (
    (r"(?iU)\bbiological\s+diversity\b|\bbiodiversity\b", ("biological_diversity", "biodiversity")),
    (r"(?iU)\bpatents?\s+act\b", ("patents_act",)),
    (r"(?iU)\btrade\s*marks?\s+act\b", ("trade_marks", "trademark")),
    (r"(?iU)\bdrugs?\s*(?:and|&)\s*cosmetics?\b", ("drugsandcosmetics", "drugs_and_cosmetics")),
    (r"(?iU)\bmagic\s+remedies\b", ("magic_remedies",)),
    (r"(?iU)\bnagoya\s+protocol\b", ("nagoya_protocol", "nagoya")),
    (r"(?iU)\bwipo\b", ("wipo",)),
    (r"(?iU)\btk\s+examination\s+guidelines\b|\bguidelines\s+for\s+examination\b", ("tk_examination_guidelines",)),
)
#: The whole reference, its number alone, the section field, the named act, a guideline instead of it.
FULL, NUMBER, FIELD, ACT, GUIDELINE = 0.020, 0.012, 0.010, 0.015, -0.005


def ranked(hits: DataFrame, score: str, ties: list, top_k: int | None = None, out: str = "rank") -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last(score), *ties)
    hits = hits.withColumn(out, F.row_number().over(w))
    return hits if top_k is None else hits.filter(F.col(out) <= top_k)


def reciprocal_rank_fusion(lists: dict[str, DataFrame], k: int = RRF_K, top_k: int = TOP_K, digits: int = 12) -> DataFrame:
    """Fuse any number of lists (query_id, id, rank, score), named by method: the sum of 1 / (k + rank).
    Ties go by first appearance: by list, then by rank. Each method's rank and score is kept. No lists
    give no rows."""
    if not lists:
        return SparkSession.active().createDataFrame([], "query_id long, id string, hybrid_score double, rank int")
    parts = None
    for i, (name, x) in enumerate(lists.items()):
        x = x.select("query_id", "id", "rank", "score", F.lit(i).alias("list_no"), F.lit(name).alias("method"))
        parts = x if parts is None else parts.unionByName(x)
    of = lambda name, c: F.max(F.when(F.col("method") == name, F.col(c)))
    kept = [of(n, c).alias(f"{n}_{c}") for n in lists for c in ("rank", "score")]
    fused = parts.groupBy("query_id", "id").agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), digits).alias("hybrid_score"), F.min(F.struct("list_no", "rank")).alias("_first"), *kept
    )
    return ranked(fused, "hybrid_score", ["_first"], top_k).drop("_first")


def single_source(hits: DataFrame, method: str, other: str, top_k: int = TOP_K) -> DataFrame:
    """One source alone: its own score as hybrid score, nothing fused."""
    out = hits.select("query_id", "id", "rank", F.col("score").alias("hybrid_score"), F.col("rank").alias(f"{method}_rank"), F.col("score").alias(f"{method}_score"))
    return out.withColumns({f"{other}_rank": F.lit(None).cast("int"), f"{other}_score": F.lit(None).cast("double")}).filter(F.col("rank") <= top_k)


def hybrid(bm25: DataFrame | None, dense: DataFrame | None, mode: str = "both", top_k: int = TOP_K, k: int = RRF_K) -> DataFrame:
    if mode == "both":
        return reciprocal_rank_fusion({"bm25": bm25, "dense": dense}, k, top_k)
    return single_source(bm25, "bm25", "dense", top_k) if mode == "bm25_only" else single_source(dense, "dense", "bm25", top_k)


def may_match(df: DataFrame, filters: dict) -> Column:
    """All filters hold, where what is missing never excludes and an unknown column filters nothing."""
    kinds, out = dict(df.dtypes), F.lit(True)
    for name, wanted in filters.items():
        if name not in kinds or wanted is None:
            continue
        values = list(wanted) if isinstance(wanted, (list, tuple, set)) else [wanted]
        c = F.col(name)
        fits = F.arrays_overlap(c, F.array(*map(F.lit, values))) if kinds[name].startswith("array") else c.isin(*values)
        out = out & F.coalesce(fits, F.lit(True))
    return out


def filtered(df: DataFrame, filters: dict) -> DataFrame:
    return df.filter(may_match(df, filters))


def boost_terms(query: Column) -> dict[str, Column]:
    """What the boost needs of a query: references (full, number, label) and document tokens."""
    found = []
    for pattern, label in BOOST_REFERENCES:
        whole, number = (F.transform(F.regexp_extract_all(query, F.lit(pattern), F.lit(g)), F.lower) for g in (0, 1))
        found.append(F.zip_with(whole, number, _pair(label)))
    acts = F.array_compact(F.array(*[F.when(query.rlike(p), F.lit(t)) for p, names in ACTS for t in names]))
    return {"boost_references": F.concat(*found), "boost_documents": acts}


def _pair(label: str) -> Callable[[Column, Column], Column]:
    return lambda w, n: F.struct(w.alias("full"), F.regexp_extract(n, r"^(\d+[a-z]?)", 1).alias("number"), F.lit(label).alias("label"))


def boost(references: Column, documents: Column, text: Column, name: Column, section: Column) -> Column:
    """What a hit gains by the query's references and acts."""
    text, name = F.lower(F.coalesce(text, F.lit(""))), F.lower(F.coalesce(name, F.lit("")))
    section = F.lower(F.coalesce(section, F.lit("")))

    def gain(r: Column) -> Column:
        at = lambda mark: F.contains(text, F.concat(r["label"], F.lit(mark), r["number"]))
        said = F.when(F.contains(text, r["full"]), FULL).when(at(" ") | at(". "), NUMBER).otherwise(0.0)
        return said + F.when((section != "") & F.contains(section, r["number"]), FIELD).otherwise(0.0)

    by_reference = F.aggregate(references, F.lit(0.0), lambda a, r: a + gain(r))
    wanted = F.exists(documents, lambda d: F.contains(name, d))
    other = F.contains(name, F.lit("guidelines")) & ~F.exists(documents, lambda d: F.contains(d, F.lit("guidelines")))
    by_act = F.when(F.size(documents) == 0, 0.0).when(wanted, ACT).when(other, GUIDELINE).otherwise(0.0)
    return by_reference + by_act


def reference_boost(hits: DataFrame, queries: DataFrame, times: int = 1, score: str = "hybrid_score", digits: int = 12) -> DataFrame:
    """The hits (query_id, id, rank, text, document_name, section, score) with ``boosted_score`` and
    a new rank: by boosted score where the query names a reference or act, else as before. The score
    before stays beside it."""
    q = queries.select("query_id", *[c.alias(n) for n, c in boost_terms(F.col("query")).items()])
    x = hits.join(q, "query_id")
    gain = boost(F.col("boost_references"), F.col("boost_documents"), F.col("text"), F.col("document_name"), F.col("section"))
    active = (F.size("boost_references") > 0) | (F.size("boost_documents") > 0)
    x = x.withColumn("boosted_score", F.round(F.col(score) + times * gain, digits)).withColumn("_sort", F.when(active, F.col("boosted_score")))
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("_sort"), F.col("rank"))
    return x.withColumn("rank", F.row_number().over(w)).drop("_sort", "boost_references", "boost_documents")


def passthrough(hits: DataFrame, top_k: int = RERANK_TOP_K) -> DataFrame:
    return hits.filter(F.col("rank") <= top_k).withColumn("rerank_score", F.lit(None).cast("double"))


def overlap_score(query: Column, text: Column) -> Column:
    """The share of a query's distinct tokens that a text has: a scorer for tests."""
    from codexlake.functions.text import tokens

    q = F.array_distinct(tokens(query))
    return F.round(F.size(F.array_intersect(q, tokens(text))) / F.greatest(F.size(q), F.lit(1)), 9)


def rerank(hits: DataFrame, score: Column, top_k: int = RERANK_TOP_K) -> DataFrame:
    """Order the shortlist by a score, missing ones as 0; ties go by the rank before."""
    x = hits.withColumn("rerank_score", score)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("rerank_score", F.lit(0.0))), "rank")
    return x.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k)


def scored(hits: DataFrame, factory: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], batch: int = 32) -> DataFrame:
    """Hits (query_id, id, query, text) with ``model_score`` from a user's pair scorer, made once per task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for x in batches:
            pairs = list(zip(x["query"], x["text"], strict=True))
            yield x.assign(model_score=[float(s) for a in range(0, len(pairs), batch) for s in model(pairs[a : a + batch])])

    return hits.mapInPandas(run, T.StructType([*hits.schema.fields, T.StructField("model_score", T.DoubleType())]))


def projected(hits: DataFrame, chunks: DataFrame, score: str = "score", method: str = "bm25") -> DataFrame:
    """The hits (query_id, rank, id, score) as retrieved chunks, flat: text, names, and where each comes from. Section, article and
    chapter are the provenance's, or where that has none the metadata's; a hit that ``chunks`` lacks stays, with nulls."""
    p, m = (lambda n: F.nullif(F.col(f"provenance.{n}"), F.lit(""))), (lambda n: F.col(f"metadata.{n}"))
    collision = "content_collision" in chunks.columns
    x = hits.select("query_id", "rank", "id", F.col(score).alias("score")).join(chunks.withColumnRenamed("chunk_id", "id"), "id", "left")
    return x.select(
        "query_id", "rank", F.col("id").alias("chunk_id"), "document_id", "document_name", "dataset_id", "text", "score", F.lit(method).alias("retrieval_method"),
        F.col("provenance.relative_path").alias("source_path"), *[F.col(f"provenance.{n}").alias(n) for n in ("pdf_page_start", "pdf_page_end", "printed_page_start", "printed_page_end")],
        *[F.coalesce(p(n), m(n)).alias(n) for n in ("section", "article", "chapter")], *[F.col(f"provenance.{n}").alias(n) for n in ("subsection", "rule", "regulation")],
        m("document_type").alias("document_type"), m("jurisdiction").alias("jurisdiction"), m("legal_domains").alias("legal_domains"),
        (F.coalesce("content_collision", F.lit(False)) if collision else F.lit(False)).alias("content_collision"),
        (F.col("collision_group_id") if collision else F.lit(None).cast("string")).alias("collision_group_id"),
    )
