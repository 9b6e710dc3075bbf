"""What became of every candidate on the way to the final ones, as one table, and how long the stages took."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators import dedupe, ranking
from docloom.params import Params
from docloom.storage import written

#: The fields of a diagnostic row, and the reasons that a candidate is filtered for.
FIELDS = [
    "document", "source_file", "heading", "chunk_index", "document_id", "raw_score", "score", "retrieval_type", "filtered_reason", "ranking_reason", "retrieval_stage_score", "keyword_score",
    "metadata_boosts", "reranker_score", "final_score",
]
BELOW, DUPLICATE, NEAR = "below_min_score", "duplicate_content", "near_duplicate_content"
STAGES = ["merge_ms", "ranking_ms", "reranker_ms", "dedupe_ms", "total_ms"]
OTHER = "struct<source_file:string,heading:string,chunk_index:int>"


def _rows(df: DataFrame, stage: str, reason: str | None, score: Column | None = None, duplicate_of: Column | None = None, similarity: Column | None = None, params: Params = Params()) -> DataFrame:
    """Diagnostic rows of candidates; columns that a stage hasn't computed yet are null."""
    have = set(df.columns)
    boosts = F.col("boosts") if "boosts" in have else F.lit(None).cast("struct<" + ",".join(f"{b}:double" for b in ranking.BOOSTS) + ">")
    value = F.col("score") if score is None else score
    keyword = F.when(F.col("retrieval_type") == "keyword", F.lit(params.keyword_score))
    rerank = F.col("reranker_score") if "reranker_score" in have else F.lit(None).cast("double")
    columns = {**{c: F.col(c) for c in FIELDS if c in have}, "score": value, "filtered_reason": F.lit(reason).cast("string"), "ranking_reason": F.coalesce("ranking_reason", F.array().cast("array<string>")), "keyword_score": keyword, "metadata_boosts": boosts, "reranker_score": rerank, "final_score": F.col("score")}
    none = F.lit(None)
    return df.select("query_id", "seq", F.lit(stage).alias("stage"), *[columns[c].alias(c) for c in FIELDS], (none if duplicate_of is None else duplicate_of).cast(OTHER).alias("duplicate_of"), (none if similarity is None else similarity).cast("double").alias("similarity"))


def _named(df: DataFrame) -> Column:
    return F.struct("source_file", "heading", "chunk_index")


def diagnosed(candidates: DataFrame, questions: DataFrame, params: Params = Params(), filters: dict | None = None, top_k: int = 0, model_score: Column | None = None, below: DataFrame | None = None) -> tuple[DataFrame, DataFrame, dict[str, float]]:
    """(final, diagnostics, timings): the candidates that ``search.retrieve`` returns, a row for every hit of both searches, for
    every one below the least score (``below``), every duplicate and near-duplicate and every final one, and milliseconds.

    ``stage`` is searched, merged, near or final. A near-duplicate has no score; it names the candidate kept in its place
    and their similarity. Every stage is a written table, so the timings are those of whole stages over all questions.
    """
    times, begin = {}, time.perf_counter()

    def done(df: DataFrame, name: str, stage: str) -> DataFrame:
        start = time.perf_counter()
        out = written(df, name)
        times[stage] = times.get(stage, 0.0) + (time.perf_counter() - start) * 1000
        return out

    merged = done(dedupe.merged(candidates), "merged", "merge_ms")
    displaced = done(dedupe.merge_diagnostics(candidates), "displaced", "merge_ms")
    ranked = done(ranking.ranked(dedupe.filtered(merged, filters), questions), "ranked", "ranking_ms")
    ordered = ranking.reranked(ranked, model_score, params.rerank_top_n, params.rerank_weight)
    if model_score is not None:
        ordered = done(ordered, "reranked", "reranker_ms")
    parts = [_rows(candidates, "searched", None, params=params)]
    if below is not None:
        parts.append(_rows(below, "searched", BELOW, params=params))
    own = candidates.join(displaced.select("query_id", "seq", "duplicate_of"), ["query_id", "seq"])
    parts.append(_rows(own, "merged", DUPLICATE, duplicate_of=F.col("duplicate_of"), params=params))
    kept = ordered
    if params.near_duplicates:
        near = done(dedupe.near_duplicates(ordered, ranking.query_features(questions), params.near_duplicate_threshold, params.near_duplicates_per_group), "near", "dedupe_ms")
        kept = ordered.join(near.where("kept").select("query_id", "seq"), ["query_id", "seq"])
        gone = ordered.join(near.where("NOT kept").select("query_id", "seq", "duplicate_of_seq", "similarity"), ["query_id", "seq"])
        other = ordered.select("query_id", F.col("seq").alias("duplicate_of_seq"), _named(ordered).alias("duplicate_of"))
        parts.append(_rows(gone.join(other, ["query_id", "duplicate_of_seq"]), "near", NEAR, F.lit(None).cast("double"), F.col("duplicate_of"), F.col("similarity"), params))
    order = Window.partitionBy("query_id").orderBy("rank")
    final = done(kept.withColumn("final_rank", F.row_number().over(order)).where(F.col("final_rank") <= (top_k or params.final_k)), "final", "dedupe_ms")
    parts.append(_rows(final, "final", None, params=params))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    times["total_ms"] = (time.perf_counter() - begin) * 1000
    return final, out, {s: round(times.get(s, 0.0), 3) for s in STAGES}
