"""All registered queries of the core; their SQL is in ``docloom.plans.sql``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import answers, chunking, dedupe, diagnostics, ingestion, jobs, ranking, search, vector_index
from docloom.plans import sql
from docloom.sources import files, markdown
from docloom.storage import spread, table, written
from docloom.streaming import ingest as streams


def _hits(spark, sf_dir) -> DataFrame:
    """The different rows of the candidates, as a table: what follows reads it several times."""
    hits = table(spark, sf_dir, "retrieved_chunks").where("query_id IS NOT NULL")
    return written(hits.withColumn("_row", F.xxhash64(*hits.columns)).dropDuplicates(["query_id", "hit_id", "_row"]).drop("_row"), "hits")


def _questions(hits: DataFrame) -> DataFrame:
    """What each query asks: the document that its first hit comes from."""
    return hits.where("document IS NOT NULL").groupBy("query_id").agg(F.min_by("document", "seq").alias("question"))


def _titles(spark, sf_dir) -> DataFrame:
    """The query set of searches: the titles of the documents whose id is divisible by 100."""
    return table(spark, sf_dir, "documents").where("doc_id % 100 = 0 AND title IS NOT NULL").select(F.col("doc_id").alias("query_id"), F.col("title").alias("question")).distinct()


def _corpus(spark, sf_dir) -> DataFrame:
    return written(search.corpus(table(spark, sf_dir, "document_chunks"), table(spark, sf_dir, "source_documents")), "corpus")


def sanitize_text(spark, sf_dir):
    return spread(table(spark, sf_dir, "document_chunks").select("vector_id", "content")).select("vector_id", T.sanitize(F.col("content")).alias("sanitized")).distinct()


def normalize_text(spark, sf_dir):
    return spread(table(spark, sf_dir, "document_chunks").select("vector_id", "content", "heading")).select("vector_id", T.normalize(F.col("content")).alias("normalized"), T.normalize(F.col("heading")).alias("heading")).distinct()


def query_terms(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "title").distinct().select("doc_id", F.explode(T.query_terms(F.col("title"))).alias("term"))


def query_phrases(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "title").distinct().select("doc_id", F.explode(T.query_phrases(T.query_terms(F.col("title")))).alias("phrase"))


def context_terms(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text").distinct().select("doc_id", F.explode(T.context_terms(F.col("text"))).alias("term"))


def classify_chunk_type(spark, sf_dir):
    return spread(table(spark, sf_dir, "document_chunks").select("vector_id", "content", "chunk_metadata")).select("vector_id", T.chunk_type(F.col("content"), F.col("chunk_metadata")["html_tag"]).alias("chunk_type")).distinct()


def fallback_language(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.fallback_language(F.col("text")).alias("language")).distinct()


def line_kinds(spark, sf_dir):
    lines = table(spark, sf_dir, "document_chunks").where("content IS NOT NULL").select("vector_id", "content").distinct().select("vector_id", F.explode(F.split(T.sanitize(F.col("content")), "\n")).alias("x"))
    x = F.col("x")
    return lines.groupBy("vector_id").agg(F.count("*").alias("lines"), F.count_if(T.is_image_line(x)).alias("images"), F.count_if(T.is_navigation_line(x)).alias("navigation"), F.count_if(T.is_breadcrumb_line(x)).alias("breadcrumbs"))


def keyword_search(spark, sf_dir):
    return search.keyword_ranks(_titles(spark, sf_dir), _corpus(spark, sf_dir))


def merge_hits(spark, sf_dir):
    return dedupe.merged(_hits(spark, sf_dir)).select("query_id", "seq", "hit_id", "score", "retrieval_type")


def merge_diagnostics(spark, sf_dir):
    d = dedupe.merge_diagnostics(_hits(spark, sf_dir))
    return d.select("query_id", "seq", F.col("duplicate_of.source_file").alias("duplicate_of_file"), F.col("duplicate_of.chunk_index").alias("duplicate_of_chunk"))


def metadata_filter(spark, sf_dir):
    return dedupe.filtered(dedupe.merged(_hits(spark, sf_dir)), {"section_group": "setup", "chunk_type": "procedure"}).select("query_id", "seq", "hit_id")


def min_score(spark, sf_dir):
    kept, gone = search.min_score(_hits(spark, sf_dir).where("retrieval_type = 'vector'"), 0.55, "raw_score")
    return kept.withColumn("filtered_reason", F.lit(None).cast("string")).unionByName(gone).select("query_id", "hit_id", "raw_score", "filtered_reason")


def rank_boosts(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    return ranking.scored(dedupe.merged(hits), _questions(hits)).select("query_id", "seq", "hit_id", "score", "boosts.*")


def rank_topk(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    return ranking.top_k(ranking.ranked(dedupe.merged(hits), _questions(hits)), 8).select("query_id", "hit_id", "score", "rank")


def rerank_topn(spark, sf_dir):
    """With a stand-in for a model: the last digit of the text's length."""
    hits = _hits(spark, sf_dir)
    model = (F.length(T.sanitize(F.col("text"))) % 10).cast("double") / 10
    out = ranking.reranked(ranking.ranked(dedupe.merged(hits), _questions(hits)), model, top_n=4)
    return out.select("query_id", "hit_id", F.round("score", 6).alias("score"), "rank")


def shingle_counts(spark, sf_dir):
    return _hits(spark, sf_dir).select("query_id", "seq", F.size(T.shingles(T.body_for_near_duplicates(F.col("text")))).alias("shingles"))


def shingle_pairs(spark, sf_dir):
    return dedupe.pair_similarity(_hits(spark, sf_dir)).withColumn("similarity", F.round("similarity", 6))


def near_duplicate_groups(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    questions = _questions(hits)
    return dedupe.near_duplicates(ranking.ranked(dedupe.merged(hits), questions), ranking.query_features(questions))


def _final(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    questions = written(_questions(hits), "questions")
    return written(search.retrieve(hits, questions), "final"), questions


def retrieve_final(spark, sf_dir):
    return _final(spark, sf_dir)[0].select("query_id", "final_rank", "hit_id", "score", "ranking_reason")


def retrieval_diagnostics(spark, sf_dir):
    """A row for each candidate and stage of retrieval; of the boosts their sum."""
    hits = _hits(spark, sf_dir)
    _, rows, _ = diagnostics.diagnosed(hits, written(_questions(hits), "questions"))
    boosts = sum((F.col(f"metadata_boosts.{b}") for b in ranking.BOOSTS[1:]), F.col(f"metadata_boosts.{ranking.BOOSTS[0]}"))
    plain = [c for c in diagnostics.FIELDS if c != "metadata_boosts"]
    return rows.select("query_id", "seq", "stage", *plain, F.round(boosts, 6).alias("boost"), F.col("duplicate_of.source_file").alias("duplicate_of_file"), F.col("duplicate_of.chunk_index").alias("duplicate_of_chunk"), F.round("similarity", 6).alias("similarity"))


def answer_contexts(spark, sf_dir):
    return answers.contexts(_final(spark, sf_dir)[0])


def answer_prompts(spark, sf_dir):
    """The two messages of each question's prompt."""
    m = answers.prompts(*_final(spark, sf_dir))
    return m.select("query_id", F.col("messages")[0]["content"].alias("system"), F.col("messages")[1]["content"].alias("user"))


def answer_facts(spark, sf_dir):
    return answers.facts(*_final(spark, sf_dir))


def retrieval_answers(spark, sf_dir):
    return answers.answers(*_final(spark, sf_dir))


def vector_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return search.vector_top_k(v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), v).select("query_id", "vec_id", F.round("cosine", 4).alias("cosine"), "rank")


def vector_status(spark, sf_dir):
    return ingestion.index_status(table(spark, sf_dir, "embeddings"), id_col="vec_id")


def vector_index_recall(spark, sf_dir):
    """(queries, reached): whether the index finds at least 0.9 of the exact neighbours of the query set."""
    v = table(spark, sf_dir, "embeddings")
    queries = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    centers = vector_index.centers_of(v, cells=16)
    found = vector_index.search(queries, written(vector_index.with_cells(v, centers), "cells"), centers, k=10, probes=10)
    return vector_index.recall(found, search.vector_top_k(queries, v, k=10)).select("queries", (F.col("recall") >= 0.9).alias("reached"))


def deleted_documents(spark, sf_dir):
    """The links that are left when the documents in processing are deleted."""
    d, c, links = (table(spark, sf_dir, n) for n in ("source_documents", "document_chunks", "document_links"))
    left = ingestion.deleted(d, c, links.distinct(), d.where("status = 'processing'"))[2]
    return left.select("link_id", "source_document_id", "target_document_id")


def sanitize_metadata(spark, sf_dir):
    """Sanitized metadata of chunks, entry by entry."""
    return table(spark, sf_dir, "document_chunks").select("vector_id", F.explode(T.sanitize_map(F.col("chunk_metadata"))).alias("key", "value")).distinct()


def hybrid_search(spark, sf_dir):
    """Both searches over embedded chunks for the query set, merged, ranked and deduplicated."""
    questions, corpus = _titles(spark, sf_dir), _corpus(spark, sf_dir)
    embed = ingestion.hashing_embedder(128)
    vectors = ingestion.embedded(corpus.select("vector_id", "content"), embed).select("vector_id", "embedding")
    queries = ingestion.embedded(questions.select("query_id", F.col("question").alias("content")), embed)
    near, _ = search.min_score(search.vector_top_k(queries, vectors, id_col="vector_id"), 0.25)
    near = near.join(corpus, "vector_id").withColumn("score", F.col("cosine")).withColumn("retrieval_type", F.lit("vector"))
    columns = ["query_id", "rank", "vector_id", "score", "retrieval_type", "document_id", "chunk_index", "heading", "content", "chunk_type", "filename", "source_path", "title"]
    both = search.hybrid_candidates(near.select(*columns), search.keyword_search(questions, corpus).select(*columns))
    none = F.lit(None).cast("string")
    both = both.select("query_id", "seq", "vector_id", "score", F.col("score").alias("raw_score"), "retrieval_type", "document_id", "chunk_index", "heading", F.col("content").alias("text"), F.col("filename").alias("document"), F.coalesce("source_path", "filename").alias("source_file"), F.struct("title", "heading", F.array().cast("array<string>").alias("breadcrumbs"), "chunk_type", none.alias("section_group")).alias("metadata"))
    return search.retrieve(written(both, "candidates"), questions).select("query_id", "final_rank", "vector_id", "retrieval_type", F.round("score", 4).alias("score"))


def upsert_points(spark, sf_dir):
    """Chunks as points, and a batch that rewrites every second one."""
    c = table(spark, sf_dir, "document_chunks").where("vector_id IS NOT NULL").select("vector_id", "document_id", "chunk_index", "char_count", "created_at").distinct()
    batch = c.where("chunk_index % 2 = 0").withColumn("char_count", F.col("char_count") + 1)
    return ingestion.upserted(c, batch).select("vector_id", "document_id", "chunk_index", "char_count")


def route_files(spark, sf_dir):
    return table(spark, sf_dir, "source_documents").select("document_id", files.route(F.col("filename")).alias("route")).distinct()


def route_counts(spark, sf_dir):
    d = table(spark, sf_dir, "source_documents").select("document_id", "filename", "content_type").distinct()
    return files.route_counts(d.withColumn("route", files.route(F.col("filename"), F.col("content_type"))))


def route_samples(spark, sf_dir):
    d = table(spark, sf_dir, "source_documents").select(F.col("filename").alias("path"), "content_type").withColumn("route", files.route(F.col("path"), F.col("content_type"))).select("path", "route").distinct()
    return files.route_samples(d)


def new_files(spark, sf_dir):
    d = table(spark, sf_dir, "source_documents").where("file_hash IS NOT NULL").select("file_hash", F.col("filename").alias("path")).distinct()
    return ingestion.new_files(d, table(spark, sf_dir, "image_assets")).select("file_hash", F.col("path").alias("filename"))


def resolve_links(spark, sf_dir):
    out = ingestion.resolved_links(table(spark, sf_dir, "document_links").distinct(), table(spark, sf_dir, "source_documents"))
    return out.select("link_id", "source_document_id", "target_document_id", "newly_resolved")


def link_targets(spark, sf_dir):
    d = table(spark, sf_dir, "source_documents").groupBy("document_id").agg(F.min("source_path").alias("source_path"))
    links = table(spark, sf_dir, "document_links").join(d, F.col("source_document_id") == F.col("document_id"), "left")
    return links.select("link_id", ingestion.target_path(F.col("source_path"), F.col("href")).alias("target")).distinct()


def image_filter(spark, sf_dir):
    return table(spark, sf_dir, "image_assets").select("image_id", files.is_small_image(F.col("filename"), F.col("width"), F.col("height")).alias("small")).distinct()


def new_images(spark, sf_dir):
    i = table(spark, sf_dir, "image_assets")
    return ingestion.new_images(i.where("status <> 'stored'"), i.where("status = 'stored'")).select("image_id").distinct()


def point_ids(spark, sf_dir):
    c = table(spark, sf_dir, "document_chunks").select("document_id", "vector_id", "chunk_index")
    d = table(spark, sf_dir, "source_documents").select("document_id", "filename").distinct()
    return c.join(d, "document_id").select("vector_id", ingestion.point_id(F.col("document_id"), F.col("filename"), F.col("chunk_index")).alias("point_id")).distinct()


def document_stats(spark, sf_dir):
    c = table(spark, sf_dir, "document_chunks").where("chunk_type NOT IN ('empty', 'navigation')").select("vector_id", "document_id", "content").distinct()
    return chunking.document_stats(c, "document_id")


def import_stats(spark, sf_dir):
    return ingestion.import_stats(table(spark, sf_dir, "source_documents"))


def import_counters(spark, sf_dir):
    return ingestion.import_counters(*(table(spark, sf_dir, n) for n in ("source_documents", "document_chunks", "document_links", "image_assets")))


def asset_paths(spark, sf_dir):
    """The local paths that links lead to, with dots resolved, for those that stay within the folder."""
    d = table(spark, sf_dir, "source_documents").groupBy("document_id").agg(F.min("source_path").alias("source_path"))
    links = table(spark, sf_dir, "document_links").join(d, F.col("source_document_id") == F.col("document_id"), "left")
    return links.select("link_id", ingestion.local_asset_path(F.col("source_path"), F.col("href"), F.lit("")).alias("path")).where("path IS NOT NULL").distinct()


def chunk_documents(spark, sf_dir):
    return chunking.chunk_documents(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def markdown_blocks(spark, sf_dir):
    return markdown.blocks(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "title")))


def markdown_chunks(spark, sf_dir):
    lists = markdown.block_lists(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "title")))
    return chunking.chunked(markdown.as_chunk_blocks(lists), searched_only=True)


def front_matter(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", markdown.front_matter_fields(F.col("text")).alias("fields"))
    return d.where("size(fields) > 0").select("doc_id", F.explode("fields").alias("key", "values"))


def sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text").distinct().select("doc_id", F.explode(answers.sentences(F.col("text"))).alias("sentence"))


def jobs_latest(spark, sf_dir):
    return jobs.latest(table(spark, sf_dir, "ingestion_jobs")).select("id", "status", "processed_files", "failed_files", "updated_at")


def jobs_listed(spark, sf_dir):
    return jobs.listed(table(spark, sf_dir, "ingestion_jobs")).select("id", "status", "created_at")


def jobs_progress(spark, sf_dir):
    return jobs.progress(table(spark, sf_dir, "ingestion_jobs"))


def event_windows(spark, sf_dir):
    return streams.windowed(table(spark, sf_dir, "events"))


def event_sessions(spark, sf_dir):
    return streams.sessions(table(spark, sf_dir, "events"))


def entry(spark, sf_dir) -> DataFrame:
    """The flagship: the final, ranked and deduplicated candidates of every query."""
    return retrieve_final(spark, sf_dir)


def queries():
    all_ = (
        sanitize_text, normalize_text, query_terms, query_phrases, context_terms, classify_chunk_type, fallback_language, line_kinds, keyword_search, merge_hits, merge_diagnostics,
        metadata_filter, min_score, rank_boosts, rank_topk, rerank_topn, shingle_counts, shingle_pairs, near_duplicate_groups, retrieve_final, retrieval_diagnostics, answer_contexts, answer_prompts, answer_facts,
        retrieval_answers, vector_topk, vector_status, vector_index_recall, deleted_documents, sanitize_metadata, hybrid_search, upsert_points, route_files, route_counts, route_samples, new_files, resolve_links, link_targets, image_filter, new_images,
        point_ids, document_stats, import_stats, import_counters, asset_paths, chunk_documents, markdown_blocks, markdown_chunks, front_matter, sentences, jobs_latest, jobs_listed, jobs_progress, event_windows, event_sessions,
    )
    return {f.__name__: f for f in all_}


def oracle_sql():
    return sql.oracle_sql()
