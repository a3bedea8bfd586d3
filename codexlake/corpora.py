"""The given tables seen as a corpus: pages, structured lines, queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from codexlake.functions.text import hash_parts, lines

PAGE_LINES = 4
#: Queries with references and acts, beside those from the tables.
LITERAL = (
    (9001, "What does  Section 3(1)(a) of the Biological Diversity Act say?"),
    (9002, "Article 5 and rule 12 on patents under chapter IV"),
    (9003, "guidelines for trade mark registration, sec. 4"),
    (9004, "who may file a petition"),
    (9005, "Nagoya protocol and WIPO treaty, Article 7"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of four lines: document_id, relative_path, page_index, text, hash."""
    x = table(spark, sf_dir, "documents").select("doc_id", "source", lines(F.col("text")).alias("l"))
    at = F.sequence(F.lit(0), F.ceil(F.size("l") / PAGE_LINES).cast("int") - 1)
    pages = F.transform(at, lambda i: F.array_join(F.slice("l", i * PAGE_LINES + 1, PAGE_LINES), "\n"))
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    x = x.select(hash_parts(F.lit("corpus"), F.col("source"), F.col("doc_id")).alias("document_id"), path.alias("relative_path"), F.posexplode(pages).alias("page_index", "text"))
    return x.withColumn("page_text_sha256", hash_parts(F.col("text")))


#: One line of a part, the same text in both engines but for the name of the string type.
STATUTE_LINE = """CASE p_partkey % 7
  WHEN 0 THEN concat('CHAPTER ', CAST(p_partkey % 5 + 1 AS {string}))
  WHEN 1 THEN concat(CAST(p_size AS {string}), '. ', p_name)
  WHEN 2 THEN concat('(', CAST(p_partkey % 4 + 1 AS {string}), ') ', p_name)
  WHEN 3 THEN concat('(a) ', p_name)
  WHEN 4 THEN concat('Provided that ', p_name)
  WHEN 5 THEN concat('Article ', CAST(p_size AS {string}), ' ', p_type)
  ELSE p_name END"""


#: Parts that make one document, and lines of a page.
DOCUMENT_PARTS, STATUTE_PAGE = 200, 25


def statute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as lines of structured documents, so many parts each: document_id, line_no, line_id, text."""
    doc = F.expr(f"concat('statute ', CAST(p_partkey DIV {DOCUMENT_PARTS} AS STRING))")
    n = F.row_number().over(Window.partitionBy("document_id").orderBy("p_partkey"))
    x = table(spark, sf_dir, "part").withColumn("document_id", doc)
    return x.select("document_id", n.alias("line_no"), F.col("p_partkey").alias("line_id"), F.expr(STATUTE_LINE.format(string="STRING")).alias("text"))


def statute_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The same as files and raw pages, for ingestion."""
    x = statute(spark, sf_dir).withColumn("page_index", F.floor((F.col("line_no") - 1) / STATUTE_PAGE).cast("int"))
    path = F.concat(F.lit("Dataset_1/"), F.translate("document_id", " ", "_"), F.lit("_act_.pdf"))
    rows = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    pages = x.groupBy(path.alias("relative_path"), "page_index").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("raw_text"))
    pages = pages.withColumns({"extraction_failed": F.lit(False), "failure_reason": F.lit(None).cast("string")})
    files = pages.groupBy("relative_path").agg(F.count("*").alias("page_count"))
    return files.withColumn("source_sha256", F.sha2("relative_path", 256)), pages


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query): the whole text of every benchmark item."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def literal_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LITERAL, "query_id long, query string")


#: Every so many lines of the statutes are asked as queries too, under ids that begin here.
ASKED_LINES, ASKED_FROM = 50, 100_000


def statute_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The literal queries, and statute lines as queries, so that their number grows with the table."""
    lines_ = table(spark, sf_dir, "part").filter(F.col("p_partkey") % ASKED_LINES == 0)
    asked = lines_.select((F.col("p_partkey") + ASKED_FROM).cast("long").alias("query_id"), F.expr(STATUTE_LINE.format(string="STRING")).alias("query"))
    return literal_queries(spark).unionByName(asked)
