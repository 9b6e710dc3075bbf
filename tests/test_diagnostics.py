from docloom.operators import diagnostics, search

HIT = "query_id bigint, seq int, text string, document string, source_file string, heading string, chunk_index int, score double, raw_score double, retrieval_stage_score double, retrieval_type string, document_id string, ranking_reason array<string>, metadata struct<title:string,heading:string,breadcrumbs:array<string>,chunk_type:string,section_group:string>"
BODY = "Open the account screen and choose the posting that you want to move to the other window of the guest, then confirm it with the key that is shown"


def hit(seq, text, score, name, kind="vector"):
    return (1, seq, text, name, name, "H" + name, seq, score, score, None, kind, "d" + name, None, ("T", "H" + name, None, "content", None))


def test_every_candidate_is_told_of(spark):
    rows = [hit(0, BODY, 0.8, "a"), hit(1, BODY, 0.4, "a"), hit(2, BODY + " today.", 0.7, "b"), hit(3, "Printers need paper and ink every other week.", 0.6, "c", "keyword")]
    hits = spark.createDataFrame(rows, HIT)
    low = spark.createDataFrame([hit(9, "far", 0.1, "z")], HIT)
    q = spark.createDataFrame([(1, "move posting")], "query_id bigint, question string")
    final, rows_, times = diagnostics.diagnosed(hits, q, below=low)
    got = {(r.stage, r.seq): r for r in rows_.collect()}
    assert set(got) == {("searched", i) for i in (0, 1, 2, 3, 9)} | {("merged", 1), ("near", 2), ("final", 0), ("final", 3)}
    assert got["searched", 9].filtered_reason == "below_min_score" and got["searched", 3].keyword_score == 0.45
    assert got["merged", 1].filtered_reason == "duplicate_content" and got["merged", 1].duplicate_of.source_file == "a"
    near = got["near", 2]
    assert near.filtered_reason == "near_duplicate_content" and near.score is None and near.duplicate_of.source_file == "a" and near.similarity >= 0.92
    assert sorted(r.seq for r in final.collect()) == sorted(r.seq for r in search.retrieve(hits, q).collect()) == [0, 3]
    assert got["final", 0].metadata_boosts is not None and set(diagnostics.FIELDS) <= set(rows_.columns)
    assert set(times) == set(diagnostics.STAGES) and sum(v for k, v in times.items() if k != "total_ms") <= times["total_ms"] + 1 and times["reranker_ms"] == 0


def test_nothing_gives_nothing(spark):
    final, rows, _ = diagnostics.diagnosed(spark.createDataFrame([], HIT), spark.createDataFrame([], "query_id bigint, question string"))
    assert final.count() == rows.count() == 0
