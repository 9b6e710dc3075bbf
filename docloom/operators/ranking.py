"""Ranking of candidates by additive boosts, and reranking by a model's scores.

Candidates have: query_id, seq (order of arrival), text, document, source_file, heading, score, raw_score,
retrieval_type, metadata (struct with title, breadcrumbs, chunk_type). Features of a question are computed once a query and
joined by ``query_id``; everything else is one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T

#: Fixed values.
GENERIC_TERMS = "about add adding configuration configure configuring edit editing introduction manage managing overview setup settings".split()
UNREQUESTED_MARKERS = "accounting connector external export exports import imports integration integrations interface interfaces mapping sync vendor".split()
PREFERRED_TYPES = ["procedure", "content", "table"]
LOW_VALUE_TYPES = ["navigation", "reference", "empty"]
BOOSTS = [
    "exact_phrase_metadata", "exact_phrase_body", "query_phrase_metadata", "query_phrase_body", "all_terms_metadata", "all_terms_body", "term_metadata",
    "term_body", "context_metadata", "topic_focus", "unrequested_context", "chunk_type", "length", "hybrid",
]


def query_features(questions: DataFrame) -> DataFrame:
    """(query_id, phrase, terms, phrases, context, topical) of (query_id, question)."""
    q = questions.select("query_id", T.normalize(F.col("question")).alias("phrase"), T.query_terms(F.col("question")).alias("terms"), T.context_terms(F.col("question")).alias("context"))
    return q.withColumn("phrases", T.query_phrases(F.col("terms"))).withColumn("topical", F.array_except("terms", "context"))


def _within(terms: Column, text: Column) -> Column:
    return F.size(F.filter(terms, lambda t: F.contains(text, t)))


def _literals(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def scored(candidates: DataFrame, questions: DataFrame) -> DataFrame:
    """Candidates with ``boosts`` (a struct of BOOSTS), ``ranking_reason`` and the final ``score``.

    Terms and phrases count wherever they stand as a part of the text; focus and unrequested context count whole words. A
    null text, heading or metadata field is empty. Candidates of queries without a question are left out.
    """
    c = candidates.join(query_features(questions), "query_id")
    meta = F.concat_ws(" ", T.normalize(F.col("metadata.title")), T.normalize(F.col("heading")), T.normalize(F.array_join(F.coalesce(F.col("metadata.breadcrumbs"), F.array().cast("array<string>")), " ")))
    c = c.withColumn("_meta", meta).withColumn("_body", T.normalize(F.col("text"))).withColumn("_type", F.lower(T.sanitize(F.col("metadata.chunk_type")))).withColumn("_length", F.length(T.sanitize(F.col("text"))))
    m, body, topical = F.col("_meta"), F.col("_body"), F.col("topical")
    c = c.withColumn("_meta_words", T.tokens(m)).withColumn("_matched", F.filter(topical, lambda t: F.array_contains(F.col("_meta_words"), t)))
    unwanted = _literals(T.STOPWORDS + GENERIC_TERMS)
    extra = F.filter("_meta_words", lambda t: ~F.array_contains(F.col("_matched"), t) & ~F.array_contains(unwanted, t))
    c = c.withColumn("_extra", extra).withColumn("_specific", F.filter("_extra", lambda t: F.length(t) >= 4))
    c = c.withColumns({"_pm": _within(F.col("phrases"), m), "_pb": _within(F.col("phrases"), body), "_tm": _within(topical, m), "_tb": _within(topical, body), "_cm": _within(F.col("context"), m)})
    n, matched = F.size(topical), F.size("_matched")
    exact_m, exact_b = (F.col("phrase") != "") & F.contains(m, F.col("phrase")), (F.col("phrase") != "") & F.contains(body, F.col("phrase"))
    all_m, all_b = (n > 0) & (F.col("_tm") == n), (n > 0) & (F.col("_tb") == n)
    focused = (n > 0) & (F.size("_meta_words") > 0) & (matched >= F.least(F.lit(2), n))
    ratio = F.size("_extra") / F.greatest(matched, F.lit(1))
    markers = F.filter(F.slice(T.tokens(body), 1, 120), lambda t: F.array_contains(_literals(UNREQUESTED_MARKERS), t) & ~F.array_contains(topical, t))
    excess = F.size(F.array_distinct("_specific")) / F.greatest(matched, F.lit(1))
    unrequested = (
        F.when((F.size("context") > 0) | (n < 2) | ~focused, 0.0)
        .when(F.size("_specific") < 3, F.when(F.size(markers) > 0, -0.28).otherwise(0.0))
        .when(excess >= 3.0, -0.28)
        .when(excess >= 2.0, -0.16)
        .otherwise(0.0)
    )
    zero = lambda x: x.otherwise(0.0)
    values = {
        "exact_phrase_metadata": zero(F.when(exact_m, 0.75)),
        "exact_phrase_body": zero(F.when(~exact_m & exact_b, 0.08)),
        "query_phrase_metadata": zero(F.when(F.col("_pm") > 0, F.least(F.lit(0.95), 0.35 * F.col("_pm")))),
        "query_phrase_body": zero(F.when((F.col("_pm") == 0) & (F.col("_pb") > 0), F.least(F.lit(0.07), 0.025 * F.col("_pb")))),
        "all_terms_metadata": zero(F.when(all_m, 0.45)),
        "all_terms_body": zero(F.when(~all_m & all_b, 0.04)),
        "term_metadata": zero(F.when(~all_m & ~all_b & (F.col("_tm") > 0), F.least(F.lit(0.36), 0.09 * F.col("_tm")))),
        "term_body": zero(F.when(~all_m & ~all_b & (F.col("_tb") > 0), F.least(F.lit(0.06), 0.012 * F.col("_tb")))),
        "context_metadata": zero(F.when(F.col("_cm") > 0, F.least(F.lit(0.24), 0.12 * F.col("_cm")))),
        "topic_focus": zero(F.when(focused & (ratio <= 1.0), 0.14).when(focused & (ratio <= 2.0), 0.08)),
        "unrequested_context": unrequested,
        "chunk_type": zero(F.when(F.col("_type").isin(PREFERRED_TYPES), 0.08).when(F.col("_type").isin(LOW_VALUE_TYPES), -0.20)),
        "length": zero(F.when(F.col("_length").between(120, 1800), 0.06).when(F.col("_length") > 3500, -0.10).when(F.col("_length") < 60, -0.08)),
        "hybrid": zero(F.when(F.col("retrieval_type") == "hybrid", 0.08)),
    }
    c = c.withColumn("boosts", F.struct(*[values[b].cast("double").alias(b) for b in BOOSTS]))
    why = {
        "exact_phrase_in_metadata": F.col("boosts.exact_phrase_metadata") > 0,
        "exact_phrase_in_content": F.col("boosts.exact_phrase_body") > 0,
        "query_phrase_in_metadata": F.col("boosts.query_phrase_metadata") > 0,
        "query_phrase_in_content": F.col("boosts.query_phrase_body") > 0,
        "all_strong_terms_in_metadata": F.col("boosts.all_terms_metadata") > 0,
        "all_strong_terms_in_content": F.col("boosts.all_terms_body") > 0,
        "strong_terms_in_metadata": F.col("boosts.term_metadata") > 0,
        "strong_terms_in_content": F.col("boosts.term_body") > 0,
        "query_context_in_metadata": F.col("boosts.context_metadata") > 0,
        "focused_topic_metadata": F.col("boosts.topic_focus") > 0,
        "unrequested_specific_context": F.col("boosts.unrequested_context") < 0,
    }
    reasons = [F.when(test, name) for name, test in why.items()]
    reasons += [
        F.when(F.col("boosts.chunk_type") > 0, F.concat(F.lit("preferred_chunk_type:"), "_type")).when(F.col("boosts.chunk_type") < 0, F.concat(F.lit("low_value_chunk_type:"), "_type")),
        F.when(F.col("boosts.length") > 0, "focused_chunk_length").when(F.col("_length") > 3500, "long_noisy_chunk").when(F.col("_length") < 60, "very_short_chunk"),
        F.when(F.col("boosts.hybrid") > 0, "matched_vector_and_keyword"),
    ]
    base = F.coalesce(F.nullif("raw_score", F.lit(0.0)), F.col("score"), F.lit(0.0))
    base = F.when(F.col("retrieval_type") == "keyword", F.greatest(base, F.lit(0.45))).otherwise(base)
    total = sum((F.col(f"boosts.{b}") for b in BOOSTS[1:]), F.col(f"boosts.{BOOSTS[0]}"))
    c = c.withColumn("score", F.round(base + total, 6)).withColumn("ranking_reason", F.array_compact(F.array(*reasons)))
    return c.select(*candidates.columns, *[x for x in ("ranking_reason", "boosts") if x not in candidates.columns])


def ranked(candidates: DataFrame, questions: DataFrame) -> DataFrame:
    """Scored candidates with their ``rank`` within the query: score, then order of arrival."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "seq")
    return scored(candidates, questions).withColumn("rank", F.row_number().over(order))


def top_k(ranked_: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each query; 0 stands for the default of 8."""
    return ranked_.where(F.col("rank") <= (k or 8))


def reranked(ranked_: DataFrame, model_score: Column | None, top_n: int = 24, weight: float = 0.15) -> DataFrame:
    """The first ``top_n`` in the order of ``score + weight * model_score``, then the rest as it was, even where it scores higher.

    Without a model (None) nothing changes. ``model_score`` may be any column, such as a pandas UDF over (question, text).
    """
    if model_score is None:
        return ranked_.withColumn("reranker_score", F.lit(None).cast("double"))
    top = F.col("rank") <= top_n
    out = ranked_.withColumn("reranker_score", F.when(top, model_score.cast("double"))).withColumn("score", F.when(top, F.col("score") + F.lit(weight) * F.coalesce("reranker_score", F.lit(0.0))).otherwise(F.col("score")))
    order = Window.partitionBy("query_id").orderBy(F.when(top, 0).otherwise(1), F.when(top, -F.col("score")), "rank")
    return out.withColumn("_new", F.row_number().over(order)).drop("rank").withColumnRenamed("_new", "rank")
