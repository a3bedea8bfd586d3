"""From ranked hits to cited evidence, and to an answer or an abstention."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_SCORE, HIGH_SCORE = 0.15, 0.5
#: Texts of answers and prompts.
ABSTENTION = "I could not find sufficient evidence in the indexed corpus to answer this question reliably."
CLOSING = "\nProvide a grounded answer citing the evidence using the citation IDs. If the evidence is insufficient, say so explicitly."
UNREACHABLE = (
    "I couldn't reach the language model to generate an answer right now. The evidence below was still retrieved from the indexed corpus "
    "— please try again in a moment."
)


def evidence_pack(hits: DataFrame) -> DataFrame:
    """The hits with citation_id, by final rank."""
    return hits.withColumn("citation_id", F.format_string("[%d]", F.col("rank")))


def grounding(queries: DataFrame, pack: DataFrame, min_score: float = MIN_SCORE, extractive: bool = False) -> DataFrame:
    """(query_id, top_score, confidence, grounded) of every query: abstain without evidence, or where
    the best rerank score is too low; without any such score there is no gate."""
    best = pack.groupBy("query_id").agg(F.max("rerank_score").alias("top_score"), F.count("*").alias("_n"))
    x = queries.select("query_id").join(best, "query_id", "left")
    top = F.col("top_score")
    sure = F.lit("dummy") if extractive else F.when(top > HIGH_SCORE, "high").otherwise("medium")
    x = x.withColumn("confidence", F.when(F.col("_n").isNull(), "none").when(top < min_score, "low").otherwise(sure))
    return x.withColumn("grounded", ~F.col("confidence").isin("none", "low")).select("query_id", "top_score", "confidence", "grounded")


def _joined(pack: DataFrame, line: Column, out: str) -> DataFrame:
    """Per query, its few cited lines in order."""
    rows = pack.select("query_id", F.struct("rank", line.alias("line")).alias("x"))
    lines = F.transform(F.array_sort(F.collect_list("x")), lambda r: r["line"])
    return rows.groupBy("query_id").agg(F.array_join(lines, "\n").alias(out))


def extractive_answer(queries: DataFrame, pack: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """(query_id, answer, confidence, grounded): a line per cited text, or the abstention."""
    line = F.concat(F.lit("Based on "), "document_name", F.lit(" "), "citation_id", F.lit(": "), F.substring("text", 1, 200), F.lit("..."))
    said = _joined(pack, line, "answer")
    x = grounding(queries, pack, min_score, extractive=True).join(said, "query_id", "left")
    return x.select("query_id", F.when(F.col("grounded"), F.col("answer")).otherwise(ABSTENTION).alias("answer"), "confidence", "grounded")


def prompt(queries: DataFrame, pack: DataFrame) -> DataFrame:
    """(query_id, prompt): the question, the evidence under its headers, the closing instruction."""
    start, end = F.col("page_start"), F.col("page_end")
    pages = F.when(start.isNotNull(), F.concat(F.lit(" (p."), start.cast("string"), F.when((end != 0) & (end != start), F.concat(F.lit("-"), end.cast("string"))).otherwise(""), F.lit(")"))).otherwise("")
    section = F.when(F.coalesce(F.col("section"), F.lit("")) != "", F.concat(F.lit(" — "), "section")).otherwise("")
    line = F.concat(F.lit("--- "), "citation_id", F.lit(" "), "document_name", section, pages, F.lit(" ---\n"), "text", F.lit("\n"))
    x = queries.select("query_id", "query").join(_joined(pack, line, "evidence"), "query_id", "left")
    head = F.concat(F.lit("QUESTION: "), "query", F.lit("\n\nEVIDENCE DOCUMENTS:\n"))
    return x.select("query_id", F.concat_ws("\n", head, "evidence", F.lit(CLOSING)).alias("prompt"))


def generated(prompts: DataFrame, factory: Callable[[], Callable[[str], str]]) -> DataFrame:
    """(query_id, answer, error) from a user's generator, made once per task; one that fails on a prompt
    fails on that alone. Pass grounded prompts only: nothing moves a filter before a Python stage."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for x in batches:
            out = []
            for q, p in zip(x["query_id"], x["prompt"], strict=True):
                try:
                    out.append((q, model(p), None))
                except Exception as e:  # noqa: BLE001  the user's function may raise anything
                    out.append((q, None, str(e)))
            yield pd.DataFrame(out, columns=["query_id", "answer", "error"])

    kind = dict(prompts.dtypes)["query_id"]
    return prompts.select("query_id", "prompt").mapInPandas(run, f"query_id {kind}, answer string, error string")


def answered(queries: DataFrame, pack: DataFrame, factory: Callable[[], Callable[[str], str]], min_score: float = MIN_SCORE) -> DataFrame:
    """(query_id, answer, confidence, grounded) with a user's generator on what is grounded."""
    gate = grounding(queries, pack, min_score)
    made = generated(prompt(queries, pack).join(gate.filter("grounded"), "query_id", "left_semi"), factory)
    x = gate.join(made, "query_id", "left")
    failed = F.col("error").isNotNull()
    answer = F.when(~F.col("grounded"), ABSTENTION).when(failed, F.concat(F.lit("LLM generation failed: "), "error")).otherwise(F.col("answer"))
    return x.select("query_id", answer.alias("answer"), F.when(failed, "error").otherwise(F.col("confidence")).alias("confidence"), (F.col("grounded") & ~failed).alias("grounded"))


def page_label(start: Column, end: Column) -> Column:
    return F.when(start.isNull(), "").when(end.isNotNull() & (end != start), F.concat(F.lit("pp. "), start.cast("string"), F.lit("–"), end.cast("string"))).otherwise(F.concat(F.lit("p. "), start.cast("string")))


def citation_cards(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Cards to show: citations (query_id, citation_id, id, document_name, page_start, page_end,
    section, article, chapter, rule, regulation) with the matching evidence's snippet."""
    x = citations.join(evidence.select("query_id", "id", F.col("text").alias("_text")), ["query_id", "id"], "left")
    text = F.coalesce("_text", F.lit(""))
    snippet = F.when(F.length(text) > 280, F.concat(F.trim(F.substring(text, 1, 277)), F.lit("…"))).otherwise(F.trim(text))
    or_else = lambda c, other: F.when(c != "", c).otherwise(other)
    filled = lambda n: F.nullif(F.col(n), F.lit(""))
    label = F.concat_ws(" · ", *map(filled, ("section", "article", "chapter", "rule", "regulation")))
    return x.select(
        "query_id", "citation_id", F.coalesce(filled("document_name"), F.lit("Indexed source")).alias("title"),
        or_else(page_label(F.col("page_start"), F.col("page_end")), "Corpus provenance").alias("page_label"),
        or_else(label, "—").alias("section_label"), or_else(snippet, "See indexed chunk in corpus.").alias("snippet"),
    )


def tier(confidence: Column, grounded: Column) -> Column:
    names = {"high": "High", "medium": "Medium", "low": "Low", "none": "Insufficient", "error": "Error"}
    known = F.coalesce(*[F.when(confidence == k, F.lit(v)) for k, v in names.items()], F.lit("Medium"))
    return F.when(grounded, known).otherwise("Insufficient")


def score_label(confidence: Column, grounded: Column) -> Column:
    names = {"high": "High", "medium": "Medium", "low": "Low", "dummy": "Dev", "error": "—"}
    known = F.coalesce(*[F.when(confidence == k, F.lit(v)) for k, v in names.items()], F.nullif(confidence, F.lit("")), F.lit("—"))
    return F.when(grounded, known).otherwise("—")


def state(responses: DataFrame, pack: DataFrame) -> DataFrame:
    """(query_id, tier, score_label, documents): the first three document names cited."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("rank", "document_name"))), lambda r: r["document_name"])
    docs = pack.groupBy("query_id").agg(F.slice(F.array_distinct(names), 1, 3).alias("documents"))
    x = responses.join(docs, "query_id", "left")
    c, g = F.col("confidence"), F.col("grounded")
    return x.select("query_id", tier(c, g).alias("tier"), score_label(c, g).alias("score_label"), F.coalesce("documents", F.array(F.lit("Query processed against indexed corpus"))).alias("documents"))


def sanitized(answer: Column) -> Column:
    """Raw failure texts as one short notice."""
    failed = answer.rlike("(?i)LLM generation failed") | answer.rlike("(?i)urlopen error|Errno|Name or service not known|ECONNREFUSED|timed out")
    return F.when(failed, UNREACHABLE).otherwise(answer)
