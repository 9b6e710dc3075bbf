"""Retrieval cases with expected sources, from JSON arrays, as questions and candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CANDIDATE = "struct<source_file:string,title:string,heading:string,breadcrumbs:array<string>,score:double,text:string,chunk_index:int,chunk_type:string,retrieval_type:string>"
CASE = f"id string, question string, expected_top_source string, expected_top_source_contains string, forbidden_top_source_contains array<string>, forbidden_answer_terms array<string>, candidates array<{CANDIDATE}>"


def read_cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cases with query_id and question, candidates as ranking takes them) of the JSON arrays under ``path``."""
    cases = spark.read.schema(CASE).option("multiLine", True).json(path).withColumn("query_id", F.xxhash64("id"))
    c = cases.select("query_id", F.posexplode("candidates").alias("seq", "c"))
    metadata = F.struct("c.title", "c.heading", "c.breadcrumbs", F.coalesce("c.chunk_type", F.lit("content")).alias("chunk_type"), F.lit(None).cast("string").alias("section_group"))
    hits = c.select("query_id", "seq", "c.text", F.coalesce("c.title", "c.source_file").alias("document"), "c.source_file", "c.heading", F.coalesce("c.chunk_index", "seq").alias("chunk_index"), "c.score", F.col("c.score").alias("raw_score"), F.coalesce("c.retrieval_type", F.lit("vector")).alias("retrieval_type"), metadata.alias("metadata"))
    return cases.drop("candidates"), hits


def checked(cases: DataFrame, final: DataFrame, answers: DataFrame) -> DataFrame:
    """(id, passed, top_source): whether the first source and the answer are as each case expects."""
    top = final.where("final_rank = 1").select("query_id", F.col("source_file").alias("top_source"))
    c = cases.join(top, "query_id", "left").join(answers, "query_id", "left")
    none = lambda column, text: ~F.exists(F.coalesce(column, F.array().cast("array<string>")), lambda x: F.contains(F.lower(text), F.lower(x)))
    good = (F.col("expected_top_source").isNull() | (F.col("top_source") == F.col("expected_top_source"))) & (F.col("expected_top_source_contains").isNull() | F.contains("top_source", F.col("expected_top_source_contains")))
    good = good & none(F.col("forbidden_top_source_contains"), F.col("top_source")) & none(F.col("forbidden_answer_terms"), F.col("answer"))
    return c.select("id", F.coalesce(good, F.lit(False)).alias("passed"), "top_source")
