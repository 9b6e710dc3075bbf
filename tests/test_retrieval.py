import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import answers, dedupe, ranking, search
from docloom.params import Params

META = "struct<title:string,heading:string,breadcrumbs:array<string>,chunk_type:string,section_group:string,text:string>"
HIT = f"query_id bigint, seq int, text string, document string, source_file string, heading string, chunk_index int, score double, raw_score double, retrieval_type string, metadata {META}"
BODY = "Open the account screen and choose the posting that you want to move. Select the target window, confirm the amount and save the change before you leave the screen. The balance of both windows is updated at once and the journal shows who moved the posting."


def hit(seq, text, score=0.4, heading="H", title=None, chunk_type="content", kind="vector", query=1, file=None, crumbs=None):
    return (query, seq, text, f"doc{seq}", file or f"f{seq}.md", heading, seq, score, score, kind, (title, heading, crumbs, chunk_type, None, None))


def hits(spark, *rows):
    return spark.createDataFrame(list(rows), HIT)


def questions(spark, *texts):
    return spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "query_id bigint, question string")


def test_exact_duplicates_keep_the_higher_score(spark):
    h = hits(spark, hit(0, "See [Guide](a.md): do it!", 0.4), hit(1, "see guide do it", 0.8), hit(2, "another text", 0.5), hit(3, None, 0.1), hit(4, "", 0.1))
    kept = {r.chunk_index: r.seq for r in dedupe.merged(h).collect()}
    assert kept == {1: 0, 2: 2, 3: 3}
    d = {(r.seq, r.duplicate_of.chunk_index) for r in dedupe.merge_diagnostics(h).collect()}
    assert d == {(0, 1), (4, 3)}
    assert dedupe.merged(h.limit(0)).count() == 0


def test_ranking_prefers_focused_titles_and_procedures(spark):
    long = "See related reference material. " * 250
    h = hits(
        spark,
        hit(0, "Home", 0.5, heading="Menu", chunk_type="navigation"),
        hit(1, long, 0.45, heading="Links", chunk_type="reference"),
        hit(2, "To move a posting, open the account and select the target window. " * 3, 0.4, heading="Move posting", title="Move posting", chunk_type="procedure"),
    )
    r = ranking.ranked(h, questions(spark, "move posting")).orderBy("rank").collect()
    assert r[0].seq == 2 and "preferred_chunk_type:procedure" in r[0].ranking_reason and "exact_phrase_in_metadata" in r[0].ranking_reason and "focused_topic_metadata" in r[0].ranking_reason
    assert r[-1].boosts.chunk_type == -0.2 and "long_noisy_chunk" in {x for y in r for x in y.ranking_reason}


def test_unrequested_context_is_penalized(spark):
    h = hits(spark, hit(0, "Configure the interface. " * 9, 0.5, heading="Rate setup vendor connector mapping external gateway", title="Rate setup"), hit(1, "Set the rate. " * 12, 0.5, heading="Rate setup", title="Rate setup"))
    r = {x.seq: x for x in ranking.scored(h, questions(spark, "rate setup")).collect()}
    assert r[0].boosts.unrequested_context < 0 and r[1].boosts.unrequested_context == 0 and r[1].score > r[0].score


def test_reranked_remainder_stays_below(spark):
    h = hits(spark, hit(0, "First", 0.8), hit(1, "Second", 0.7), hit(2, "Third", 0.6))
    r = h.withColumn("rank", F.col("seq") + 1)
    model = F.when(F.col("text") == "First", 0.2).otherwise(0.9)
    out = ranking.reranked(r, model, top_n=2).orderBy("rank").collect()
    assert [x.text for x in out] == ["Second", "First", "Third"]
    assert out[0].score == pytest.approx(0.835) and out[2].reranker_score is None
    assert [x.text for x in ranking.reranked(r, None).orderBy("rank").collect()] == ["First", "Second", "Third"]


def test_near_duplicates_keep_the_one_in_context(spark):
    fm = "---\ntitle: {}\n---\n"
    h = hits(spark, hit(0, fm.format("Postings general") + BODY, 0.9, heading="A"), hit(1, fm.format("Postings PMS alpha") + BODY + " Extra note.", 0.5, heading="B"), hit(2, "Something else altogether that shares nothing with it at all", 0.3))
    q = questions(spark, "move posting in PMS")
    ranked = h.withColumn("rank", F.col("seq") + 1)
    n = {r.seq: r for r in dedupe.near_duplicates(ranked, ranking.query_features(q)).collect()}
    assert n[1].kept and not n[0].kept and n[0].duplicate_of_seq == 1 and n[0].similarity >= 0.92 and n[2].kept
    assert all(r.kept for r in dedupe.near_duplicates(ranked, ranking.query_features(q), per_group=2).collect())


def test_grouping_is_greedy_in_rank_order():
    rng = random.Random(1)
    rows = []
    for i in range(40):
        rows.append({"query_id": 1, "seq": i, "rank": i + 1, "score": rng.random(), "shingles": [f"s{rng.randrange(12)}" for _ in range(rng.randint(0, 10))], "contexts": rng.randint(0, 2), "phrase_hits": 0})
    out = dedupe.grouped(rows, 0.6, 1)
    assert sorted(r[0] for r in out) == list(range(40))
    for g in {r[2] for r in out}:
        assert sum(r[1] for r in out if r[2] == g) == 1


def test_pair_similarity_is_symmetric_and_bounded(spark):
    h = hits(spark, hit(0, BODY), hit(1, BODY + " Extra note."), hit(2, None), hit(3, "short one"), hit(4, BODY, query=2))
    got = {(r.query_id, r.seq, r.other_seq): r.similarity for r in dedupe.pair_similarity(h).collect()}
    assert set(got) == {(1, 0, 1)} and 0.9 < got[1, 0, 1] <= 1


def like(rows):
    """The similarities of all pairs of rows, by brute force."""
    words = [r.text.lower().replace(".", "").replace(",", "").split() for r in rows]
    sets = [{" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else set(w) for w in words]
    out = []
    for x, a in zip(rows, sets):
        for y, b in zip(rows, sets):
            if x.query_id == y.query_id and x.seq < y.seq and a & b:
                c = len(a & b)
                jaccard = c / len(a | b)
                out.append((x.query_id, x.seq, y.seq, round(jaccard if min(len(a), len(b)) / max(len(a), len(b)) < 0.75 else max(c / min(len(a), len(b)), jaccard), 9)))
    return sorted(out)


def cut(seed, n, queries):
    """Candidates that share beginnings or ends of BODY; every third place in a query is taken twice."""
    rng = random.Random(seed)
    words = BODY.split()
    return [hit(i // 4 * 3 + min(i % 4, 2), " ".join(words[(k := rng.randrange(30)) : k + rng.randint(2, 20)]), query=1 + rng.randrange(queries)) for i in range(n)]


@pytest.mark.parametrize("hot", [4096, 3])
def test_pairs_of_all_rows_of_a_query(spark, monkeypatch, hot):
    monkeypatch.setattr(dedupe, "HOT", hot)
    h = hits(spark, *cut(3, 60, 3), hit(900, BODY), hit(900, BODY), hit(901, BODY))
    got = sorted((r.query_id, r.seq, r.other_seq, round(r.similarity, 9)) for r in dedupe.pair_similarity(h).collect())
    assert got == like(h.collect()) and got.count((1, 900, 901, 1.0)) == 2


def test_shingles_are_never_broadcast(spark):
    """They were few enough by the bytes of the rows they come from."""
    plan = dedupe.pair_similarity(hits(spark, *cut(5, 20, 2)))._jdf.queryExecution().optimizedPlan().toString()
    joins = [at for at, x in enumerate(plan.split("\n")) if "Join " in x]
    shingles = [at for at, x in enumerate(plan.split("\n")) if "Generate explode(" in x and "token" in x]
    assert not any(j < g for j in joins for g in shingles)


@pytest.mark.parametrize("line", ["Print", "pre[v]ious", "see the index", "\x00", "pr\x00int", "a plain line of text", "[x](y)", "*** ---", "", "Índex", "PREVIOUS next", "the contents of a b c d e f g h i", "–", "printer", "日本"])
def test_navigation_lines_are_told_without_normalizing_most(spark, line):
    from docloom.functions import text as T

    words = spark.range(1).select(T.tokens(T.normalize(F.lit(line))).alias("w")).first().w
    want = not words or (bool(set(words) & set(T.NAVIGATION_WORDS)) and len(set(words)) <= 8)
    assert spark.createDataFrame([(line,)], "x string").select(T.is_navigation_line(F.col("x"))).first()[0] == want


def test_filters(spark):
    h = hits(spark, hit(0, "a", chunk_type="table"), hit(1, "b"), hit(2, "c", chunk_type=None))
    assert [r.seq for r in dedupe.filtered(h, {"chunk_type": "table"}).collect()] == [0]
    assert [r.seq for r in dedupe.filtered(h, {"source_file": "f1.md", "chunk_type": "content"}).collect()] == [1]
    assert dedupe.filtered(h, None).count() == 3 and dedupe.filtered(h, {"title": "x"}).count() == 0


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_vector_top_k_agrees_with_brute_force(spark, block):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    v[7] = v[3]
    rows = [(i, [float(x) for x in v[i]]) for i in range(60)] + [(60, None), (61, []), (62, [0.0] * 8), (63, [1.0] * 5), (3, [float(x) for x in v[3]]), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = search.vector_top_k(df.where("vec_id in (0, 3, 9, 60, 62)").withColumnRenamed("vec_id", "query_id"), df, k=5, block=block).collect()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in (0, 3, 9):
        want = sorted(range(60), key=lambda i: (-round(float(u[i] @ u[q]), 9), i))[:5]
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want
    assert {r.query_id for r in got} == {0, 3, 9}
    kept, gone = search.min_score(spark.createDataFrame([(1, 0.6), (2, 0.5), (3, None)], "i int, cosine double"), 0.55)
    assert kept.count() == 1 and {r.filtered_reason for r in gone.collect()} == {"below_min_score"}


def test_keyword_search(spark):
    chunks = spark.createDataFrame([("v1", "d1", 0, "H", "The night-audit runs", "content", "a.md", "x/a.md", None), ("v2", "d1", 1, None, "Printer", "content", "a.md", "x/a.md", "Audits"), ("v3", "d2", 0, None, None, "content", "auditing.md", None, None), ("v4", "d3", 0, None, "Nothing", "content", "b.md", "b.md", "T")], "vector_id string, document_id string, chunk_index int, heading string, content string, chunk_type string, filename string, source_path string, title string")
    got = search.keyword_search(questions(spark, "the AUDIT", "of the", "night-audit zzz"), chunks, k=2).collect()
    assert {(r.query_id, r.vector_id, r.rank) for r in got} == {(1, "v1", 1), (1, "v2", 2), (3, "v1", 1)}
    assert {r.score for r in got} == {0.45}


def test_retrieve_and_answer(spark):
    h = hits(spark, hit(0, BODY, 0.6, title="Move posting", heading="Move posting", file="a.md"), hit(1, BODY, 0.9, title="Move posting", heading="Move posting", file="b.md"), hit(2, "The printer stands in the hall and needs new paper every other week.", 0.7, file="c.md"), hit(3, BODY + " Extra note.", 0.5, heading="Copy", file="d.md"))
    q = questions(spark, "how to move a posting", "nothing here")
    final = search.retrieve(h, q).cache()
    r = final.orderBy("final_rank").collect()
    assert r[0].source_file == "b.md" and len(r) == 2 and r[0].seq == 0
    assert search.retrieve(h, q, Params(near_duplicates=False)).count() == 3 and search.retrieve(h, q, top_k=1).count() == 1
    a = {x.query_id: x.answer for x in answers.answers(final, q).collect()}
    assert a[2] == answers.NOTHING_FOUND and "1. b.md — Move posting" in a[1] and "- Open the account screen" in a[1] and len(a[1]) < 1400
    c = answers.contexts(final, 200).first().context
    assert c.startswith("Source: b.md\nHeading: Move posting\nChunk: 1\n") and len(c) <= 207
    p = answers.prompts(final, q).collect()
    assert len(p) == 1 and [m.role for m in p[0].messages] == ["system", "user"] and "Question: how to move a posting" in p[0].messages[1].content
