"""Contexts, prompts and extractive answers from the final candidates of each question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.storage import written

#: The sentences and section heads of an answer, and of the user's message.
NOTHING_FOUND = "I could not find relevant documentation chunks for that question."
NO_EXCERPT = "The retrieved sources contain relevant information, but no compact excerpt could be extracted."
SECTIONS = ["Retrieval-only answer (no LLM provider is configured).", "Short answer:", "Relevant facts:", "Top sources:"]
#: The messages of a prompt, in words of this library.
USER_PROMPT = "Context from the documentation:\n{context}\n\nQuestion: {question}\n\nAnswer in the language of the question. {terms}"
SYSTEM_PROMPT = "You are a documentation assistant. Answer only from the given context and say so when it doesn't hold the answer."


def contexts(final: DataFrame, max_chars: int = 12_000) -> DataFrame:
    """(query_id, context): the candidates in order, each with its source, as far as ``max_chars`` go; the last is cut at a word.

    Separators count as two characters, so a context may be slightly longer. Queries without candidates have no row.
    """
    head = F.concat(F.lit("Source: "), F.coalesce("source_file", F.lit("None")), F.lit("\nHeading: "), F.coalesce(F.nullif("heading", F.lit("")), F.lit("N/A")), F.lit("\nChunk: "), F.coalesce(F.col("chunk_index").cast("string"), F.lit("None")), F.lit("\n"))
    block = T.strip(F.concat(head, T.sanitize(F.col("text"))))
    blocks = final.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("final_rank", block.alias("block")))).alias("b"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("parts"), F.lit(False).alias("full"))

    def step(s, x):
        left = F.lit(max_chars) - s["used"]
        full = s["full"] | (left <= 0)
        cut = F.when(F.length(x["block"]) > left, T.strip(F.regexp_replace(F.substring(x["block"], F.lit(1), F.greatest(left, F.lit(0))), r" [^ ]*\z", ""))).otherwise(x["block"])
        take = ~full & (cut != "")
        return F.struct(F.when(take, s["used"] + F.length(cut) + 2).otherwise(s["used"]).alias("used"), F.when(take, F.concat(s["parts"], F.array(cut))).otherwise(s["parts"]).alias("parts"), full.alias("full"))

    return blocks.select("query_id", F.aggregate("b", start, step, lambda s: F.array_join(s["parts"], "\n\n---\n\n")).alias("context"))


def prompts(final: DataFrame, questions: DataFrame, max_chars: int = 12_000, system_prompt: str = SYSTEM_PROMPT, terms_instruction: str = "Keep the terms of the source.") -> DataFrame:
    """(query_id, messages): a system and a user message for each question that has candidates."""
    before, middle, after = USER_PROMPT.replace("{terms}", terms_instruction).replace("{question}", "{context}").split("{context}")
    user = F.concat(F.lit(before), F.col("context"), F.lit(middle), T.sanitize(F.col("question")), F.lit(after))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return contexts(final, max_chars).join(questions, "query_id").select("query_id", F.array(message("system", F.lit(system_prompt)), message("user", user)).alias("messages"))


def without_noise(text: Column) -> Column:
    """Readable text in one line: no front matter, images or breadcrumbs, links as their text."""
    lines = F.transform(F.split(F.regexp_replace(T.without_front_matter(text), r"\r\n?", "\n"), "\n"), lambda x: F.trim(x))
    kept = F.filter(lines, lambda x: (x != "") & ~T.is_image_line(x) & ~T.is_breadcrumb_line(x, 50, separator=False))
    return T.squeeze(T.unlink(F.array_join(kept, "\n")))


def sentences(text: Column, least: int = 35) -> Column:
    """Sentences of ``least`` characters or more of a text without noise."""
    parts = F.transform(F.split(without_noise(T.sanitize(text)), r"(?<=[.!?])\s+"), T.squeeze)
    return F.filter(parts, lambda s: F.length(s) >= least)


def answer_fingerprint(text: Column) -> Column:
    return F.substring(T.normalize(without_noise(T.sanitize(text))), 1, 700)


def unique(final: DataFrame, limit: int = 3) -> DataFrame:
    """The first ``limit`` candidates of each query that don't nearly repeat an earlier one, by ``final_rank``.

    Two repeat each other if their words contain each other to 0.88 or overlap to 0.82. Candidates without words stay.
    """
    c = final.withColumn("_fp", answer_fingerprint(F.col("text"))).withColumn("_w", F.array_distinct(T.tokens(F.col("_fp"))))
    lists = c.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("final_rank", "_fp", "_w"))).alias("l"))
    item = "struct<r:int,f:string,w:array<string>>"

    def like(a, b):
        common = F.size(F.array_intersect(a["w"], b["w"]))  # both sides are values, not expressions
        near = (common / F.least(F.size(a["w"]), F.size(b["w"])) >= 0.88) | (common / F.size(F.array_union(a["w"], b["w"])) >= 0.82)
        return (a["f"] == b["f"]) | ((F.size(a["w"]) > 0) & (F.size(b["w"]) > 0) & F.coalesce(near, F.lit(False)))

    def step(kept, x):
        own = F.struct(x["final_rank"].cast("int").alias("r"), x["_fp"].alias("f"), x["_w"].alias("w")).cast(item)
        seen = F.exists(kept, lambda k: (k["f"] != "") & (own["f"] != "") & like(own, k))
        return F.when((F.size(kept) >= limit) | seen, kept).otherwise(F.concat(kept, F.array(own)))

    ranks = lists.select("query_id", F.explode(F.aggregate("l", F.array().cast(f"array<{item}>"), step, lambda k: F.transform(k, lambda x: x["r"]))).alias("final_rank"))
    return final.join(ranks, ["query_id", "final_rank"], "left_semi")


def primary(final: DataFrame, limit: int = 3) -> DataFrame:
    """Unique candidates from the source or document of each query's first candidate."""
    order = Window.partitionBy("query_id").orderBy("final_rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = final.withColumn("_s", F.first("source_file").over(order)).withColumn("_d", F.first("document").over(order))
    return unique(c.where(F.col("source_file").eqNullSafe(F.col("_s")) | F.col("document").eqNullSafe(F.col("_d"))).drop("_s", "_d"), limit)


def facts(final: DataFrame, questions: DataFrame, limit: int = 5) -> DataFrame:
    """(query_id, fact_no, fact): sentences that name the question's terms, those with most terms first, each once.

    Sentences are cut at 240 characters. Where the question has terms, a sentence needs one.
    """
    q = questions.select("query_id", T.query_terms(F.col("question"), stopwords=False).alias("terms"))
    s = primary(final).select("query_id", "final_rank", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence")).join(q, "query_id")
    n = T.normalize(F.col("sentence"))
    s = s.withColumn("matches", F.size(F.filter("terms", lambda t: F.contains(n, t)))).where((n != "") & ((F.size("terms") == 0) | (F.col("matches") > 0)))
    s = s.withColumn("fact", T.truncate_at_word(F.col("sentence"), 240)).withColumn("_fp", answer_fingerprint(F.col("fact"))).where("_fp <> ''")
    best = Window.partitionBy("query_id", "_fp").orderBy(F.desc("matches"), "final_rank", "pos")
    order = Window.partitionBy("query_id").orderBy(F.desc("matches"), "final_rank", "pos")
    s = s.withColumn("_n", F.row_number().over(best)).where("_n = 1")
    return s.withColumn("fact_no", F.row_number().over(order)).where(F.col("fact_no") <= limit).select("query_id", "fact_no", "fact")


def answers(final: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, answer): a short answer, the facts and the top sources; every question has a row."""
    if "_docloom_path" not in final.__dict__:
        final = written(final, "final-candidates")  # read three times below
    found = facts(final, questions).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("fact_no", "fact"))), lambda x: x["fact"]).alias("facts"))
    first = final.where("final_rank = 1").select("query_id", T.truncate_at_word(F.coalesce(F.get(sentences(F.col("text")), F.lit(0)), without_noise(T.sanitize(F.col("text")))), 240).alias("excerpt"))
    line = F.struct("final_rank", F.concat(F.coalesce("source_file", F.lit("None")), F.lit(" — "), F.coalesce(F.nullif("heading", F.lit("")), "document", F.lit("None"))).alias("s"))
    sources = unique(final).groupBy("query_id").agg(F.array_sort(F.collect_list(line)).alias("l")).select("query_id", F.transform("l", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["s"])).alias("sources"))
    a = questions.select("query_id").join(first, "query_id", "left").join(found, "query_id", "left").join(sources, "query_id", "left").withColumn("facts", F.coalesce("facts", F.array("excerpt")))
    short = F.trim(F.array_join(F.slice("facts", 1, 2), " "))
    short = F.when(F.length(short) > 420, T.truncate_at_word(short, 420)).otherwise(short)
    none = F.lit(NO_EXCERPT)
    items = F.transform(F.filter("facts", lambda f: f != ""), lambda f: F.concat(F.lit("- "), f))
    empty = F.array(F.lit(""))
    body = F.concat(F.array(F.lit(SECTIONS[0]), F.lit(""), F.lit(SECTIONS[1]), F.coalesce(F.nullif(short, F.lit("")), none), F.lit(""), F.lit(SECTIONS[2])), items, empty, F.array(F.lit(SECTIONS[3])), F.col("sources"))
    return a.select("query_id", F.when(F.col("sources").isNull(), NOTHING_FOUND).otherwise(F.trim(F.array_join(body, "\n"))).alias("answer"))
