"""Keyword and vector search over chunks, and the hybrid pipeline for a table of questions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import dedupe, ranking
from docloom.params import Params
from docloom.storage import spread, written

#: Query vectors that one block holds.
BLOCK = 4096


def corpus(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with file name, path and title of their document; rows sent twice count once.

    Of rows that share their id but differ, one whole row stays, chosen by a hash of it, so no row is put together from two.
    """
    one = lambda df, key, columns: df.groupBy(key).agg(F.max_by(F.struct(*columns), F.xxhash64(*columns)).alias("r")).select(key, "r.*")
    d = documents.select("document_id", "filename", "source_path", F.get_json_object("doc_metadata", "$.title").alias("title"))
    d = one(d, "document_id", ["filename", "source_path", "title"])
    return one(chunks, "vector_id", ["document_id", "chunk_index", "heading", "content", "chunk_type"]).join(d, "document_id")


def keyword_ranks(questions: DataFrame, chunks: DataFrame, k: int = 80) -> DataFrame:
    """(query_id, vector_id, rank): the first ``k`` chunks of ``corpus``, by document and place, in which a term of the question stands.

    A term stands in a chunk if it is part of any word of any field; terms have no blanks, so each lies within one
    blank-separated word. Every word keeps its first ``k`` chunks, taken in each task before the shuffle: the first ``k``
    chunks of a question are among those of the words that hold one of its terms. Words meet the terms in their first three
    characters. Nothing is compared with every chunk, and no list grows with the chunks that a word stands in. Questions
    without terms have no rows.
    """
    place = ["document_id", "chunk_index", "vector_id"]
    terms = questions.select("query_id", F.explode(T.query_terms(F.col("question"))).alias("term"))
    fields = F.concat_ws(" ", "content", "heading", "filename", "source_path", "title")
    posted = chunks.select(*place, F.explode(F.array_distinct(F.split(F.lower(fields), T.SPACE + "+"))).alias("word")).where("length(word) >= 3")
    first = posted.withColumn("_n", F.row_number().over(Window.partitionBy("word").orderBy(*place))).where(F.col("_n") <= k).drop("_n")
    first = written(first, "postings")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - 2), lambda i: F.substring(F.col("word"), i, F.lit(3))))
    vocabulary = first.select("word").distinct().select("word", F.explode(grams).alias("gram"))
    hit = vocabulary.join(terms.select("query_id", "term", F.substring("term", 1, 3).alias("gram")), "gram").where(F.contains(F.col("word"), F.col("term")))
    found = first.join(hit.select("query_id", "word").distinct(), "word").select("query_id", *place).distinct()
    order = Window.partitionBy("query_id").orderBy(*place)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "vector_id", "rank")


def keyword_search(questions: DataFrame, chunks: DataFrame, k: int = 80, score: float = 0.45) -> DataFrame:
    """``keyword_ranks`` with the chunks' columns, all with the same score."""
    return keyword_ranks(questions, chunks, k).join(chunks, "vector_id").withColumn("score", F.lit(score)).withColumn("retrieval_type", F.lit("keyword"))


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int = 80, query_col: str = "query_id", id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query_id, id_col, cosine, rank): the ``k`` nearest vectors of each query, ties by id; every vector is compared.

    Queries go to the tasks in blocks of ``block``; a task multiplies matrices and passes on its ``k`` best a query, so the
    shuffle carries at most ``k`` rows a query and task. Vectors that are null, empty, zero, of another length than the
    query's or not finite have no cosine. Rows sent twice count once.
    """
    q = queries.where(f"{query_col} IS NOT NULL AND size({vector_col}) > 0").select(F.col(query_col).alias("query_id"), F.col(vector_col).cast("array<double>").alias("v")).dropDuplicates(["query_id"])
    q = written(q, "query-vectors")  # read once for each block
    blocks = -(-q.count() // block) or 1
    q = q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    id_type = vectors.schema[id_col].dataType.simpleString()
    rows = spread(vectors.where(f"{id_col} IS NOT NULL AND size({vector_col}) > 0").select(id_col, F.col(vector_col).cast("array<double>").alias("v")))
    schema = f"query_id {q.schema['query_id'].dataType.simpleString()}, {id_col} {id_type}, cosine double"
    spark, out = vectors.sparkSession, None
    for b in range(blocks):
        part = q.where(F.col("block") == b).select("query_id", "v").toPandas()
        by_size = {}
        for size, g in part.groupby(part["v"].map(len)):
            matrix = np.array(g["v"].tolist(), dtype=float)
            norm = np.linalg.norm(matrix, axis=1)
            ok = np.isfinite(norm) & (norm > 0)
            by_size[size] = (g["query_id"].to_numpy()[ok], matrix[ok] / norm[ok, None])
        sent = spark.sparkContext.broadcast(by_size)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column(1)
                sizes = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                starts = np.concatenate([[0], np.cumsum(sizes)])
                ids = batch.column(0)
                for size, (names, matrix) in sent.value.items():
                    at = np.flatnonzero(sizes == size)
                    if not len(at) or not len(names):
                        continue
                    m = flat[starts[at][:, None] + np.arange(size)[None, :]]
                    norm = np.linalg.norm(m, axis=1)
                    good = np.isfinite(norm) & (norm > 0)
                    at, m = at[good], m[good] / norm[good, None]
                    cosine = m @ matrix.T
                    # all that may tie with the k-th best go on
                    if len(at) > k:
                        edge = np.partition(cosine, len(at) - k, axis=0)[len(at) - k]
                        r, c = np.nonzero(cosine >= edge[None, :] - 1e-12)
                    else:
                        r, c = np.nonzero(np.ones_like(cosine, dtype=bool))
                    yield pa.RecordBatch.from_arrays([pa.array(names[c]), ids.take(pa.array(at[r])), pa.array(cosine[r, c])], ["query_id", id_col, "cosine"])

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 9)), id_col)
    return out.dropDuplicates(["query_id", id_col]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def min_score(hits: DataFrame, least: float, score_col: str = "cosine") -> tuple[DataFrame, DataFrame]:
    """Hits from ``least`` on, and the others with the reason ``below_min_score``; it follows the limit, so fewer than k may stay."""
    ok = F.coalesce(F.col(score_col) >= least, F.lit(False))
    return hits.where(ok), hits.where(~ok).withColumn("filtered_reason", F.lit("below_min_score"))


def retrieve(candidates: DataFrame, questions: DataFrame, params: Params = Params(), filters: dict | None = None, top_k: int = 0, model_score=None) -> DataFrame:
    """The final candidates of each question: merge, filter, rank, rerank, near-duplicates, first k by ``final_rank``.

    ``candidates`` are the hits of all searches in order of arrival (``seq``); ``questions`` has (query_id, question).
    """
    hits = dedupe.filtered(dedupe.merged(candidates), filters)
    ordered = ranking.reranked(ranking.ranked(hits, questions), model_score, params.rerank_top_n, params.rerank_weight)
    if params.near_duplicates:
        near = dedupe.near_duplicates(ordered, ranking.query_features(questions), params.near_duplicate_threshold, params.near_duplicates_per_group)
        ordered = ordered.join(near.where("kept").select("query_id", "seq"), ["query_id", "seq"])
    final = Window.partitionBy("query_id").orderBy("rank")
    return ordered.withColumn("final_rank", F.row_number().over(final)).where(F.col("final_rank") <= (top_k or params.final_k))


def hybrid_candidates(vector_hits: DataFrame, keyword_hits: DataFrame) -> DataFrame:
    """Both searches in one table; ``seq`` counts the vector hits by rank, then the keyword hits."""
    both = vector_hits.withColumn("_arm", F.lit(0)).unionByName(keyword_hits.withColumn("_arm", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("seq", F.row_number().over(Window.partitionBy("query_id").orderBy("_arm", "rank")) - 1).drop("_arm")
