import tempfile

import pytest
from pyspark.sql import functions as F

from docloom.llm import ledger as L

CHUNK = "vector_id string, content string, chunk_type string, created_at timestamp, record string, bucket int, id string"
DOC = "document_id string, file_hash string, doc_metadata string, created_at timestamp, key string"


def chunks(spark, rows):
    return spark.createDataFrame([(v, c, t, None, "r", 1, "i") for v, c, t in rows], CHUNK)


def docs(spark, rows):
    return spark.createDataFrame([(d, h, m, None, "k") for d, h, m in rows], DOC)


def pairs(df):
    return sorted((r.record, r.first_id, r.copy_id) for r in df.collect())


def test_chunks_that_differ_in_form_only(spark):
    c = chunks(spark, [("b", "Hello, World 1", "content"), ("a", "hello world-1!", "content"), ("c", "hello world 2", "content"), ("d", "...", "content"), ("e", "!", "content"), ("f", None, "content"), (None, "hello world 1", "content"), ("b", "Hello, World 1", "content")])
    assert pairs(L.found(c, docs(spark, []))) == [("chunk", "a", "b")]


def test_lines_of_tables_may_stand_in_any_order(spark):
    c = chunks(spark, [("a", "x: 1\ny: 2", "table"), ("b", "- Y=2\n\n- X=1", "table"), ("c", "y2\nx1", "content"), ("d", "x1 y2", "content")])
    assert pairs(L.found(c, docs(spark, []))) == [("chunk", "a", "b")]


def test_hashes_in_other_notations_and_metadata_without_hash(spark):
    h = "ab" * 32
    d = docs(spark, [("a", h, None), ("b", "SHA256=" + h.upper(), None), ("c", ":".join(["ab"] * 32), None), ("d", "ab" * 16, '{"t": 1}'), ("e", "ab" * 16, '{"t": 1}'), ("m", None, '{"t": "A b", "l": ["x"]}'), ("n", None, '{"l": ["X"], "t": "a-B"}'), ("o", None, '{"t": "A b"}'), ("p", None, None), ("q", None, "no json"), ("r", None, "no json")])
    assert pairs(L.found(chunks(spark, []), d)) == [("document", "a", "b"), ("document", "a", "c"), ("document", "m", "n")]


def keyed(df):
    return L.keyed(df, "chunk", "vector_id", L.chunk_key(F.col("content"), F.col("chunk_type")))


def state(ledger):
    return sorted((bytes(r.key), r.copies, r.first_id) for r in ledger.counts().collect())


def numbered(spark):
    return spark.range(300).select(F.concat(F.lit("i"), F.col("id") % 120).alias("vector_id"), F.concat(F.lit("text "), F.col("id") % 120 % 7).alias("content"), F.lit("content").alias("chunk_type"), F.timestamp_seconds(F.col("id") * 1000).alias("created_at"))


def part(rows, low):
    return rows.where((F.col("created_at") >= F.timestamp_seconds(F.lit(low * 1000))) & (F.col("created_at") < F.timestamp_seconds(F.lit((low + 100) * 1000))))


def test_batches_give_the_same_ledger_as_one_batch(spark):
    rows = numbered(spark)
    want = sorted((bytes(r.key), r.copies, r.first_id) for r in L.aggregated(keyed(rows)).collect())
    assert [c for _, c, _ in want] and sum(c for _, c, _ in want) == 120
    for n in (1, 3):
        assert state(L.build(keyed(rows), n, buckets=4)) == want
    ledger = L.Ledger(spark, tempfile.mkdtemp(prefix="spark-"), 3)
    for low in (0, 100, 200):
        ledger.apply(keyed(part(rows, low)))
        ledger.apply(keyed(part(rows, low).limit(0)))
    assert state(ledger) == want
    ledger.compact()
    ledger.apply(keyed(part(rows, 0)))  # sent again
    assert state(ledger) == want and ledger.seen().count() == 120


def test_a_batch_that_breaks_off_changes_nothing(spark, monkeypatch):
    rows = numbered(spark)
    ledger = L.Ledger(spark, tempfile.mkdtemp(prefix="spark-"), 3)
    ledger.apply(keyed(part(rows, 0)))
    before = state(ledger)

    def broken(*_):
        raise RuntimeError("lost")

    for step in ("_commit", "_write"):
        with monkeypatch.context() as m:
            m.setattr(ledger, step, broken)
            with pytest.raises(RuntimeError):
                ledger.apply(keyed(part(rows, 100)))
        assert state(ledger) == before
    ledger.apply(keyed(part(rows, 100)))
    assert state(ledger) == sorted((bytes(r.key), r.copies, r.first_id) for r in L.aggregated(keyed(part(rows, 0).unionByName(part(rows, 100)))).collect())


def test_a_batch_writes_its_own_pairs_only(spark):
    rows = spark.range(4000).select(F.concat(F.lit("i"), "id").alias("vector_id"), F.concat(F.lit("text "), "id").alias("content"), F.lit("content").alias("chunk_type"), F.timestamp_seconds("id").alias("created_at"))
    folder = tempfile.mkdtemp(prefix="spark-")
    ledger = L.Ledger(spark, folder, 64)
    ledger.apply(keyed(rows.where("vector_id <> 'i7'")))
    ledger.apply(keyed(rows.where("vector_id IN ('i7', 'i8')")))
    second = [a for n, a, _, _ in ledger.manifest() if n == 2]
    assert len(second) == len({b for n, _, b, _ in ledger.manifest() if n == 2}) <= 2
    assert spark.read.parquet(f"{folder}/seen/attempt={second[0]}").count() == 1
    assert spark.read.parquet(f"{folder}/counts/attempt={second[0]}").count() < 4000 / 64 * 2 * 2
    assert ledger.counts().count() == ledger.seen().count() == 4000


def test_earliest_representative_stays(spark):
    rows = spark.createDataFrame([("z", "t", "content", 1), ("a", "T!", "content", 2), ("0", "t.", "content", None)], "vector_id string, content string, chunk_type string, s long").withColumn("created_at", F.timestamp_seconds("s"))
    for n in (1, 2):
        row = L.build(keyed(rows), n).counts().first()
        assert (row.copies, row.earliest.id, row.first_id) == (3, "z", "0")
    row = L.build(keyed(rows.where("s IS NULL"))).counts().first()
    assert (row.copies, row.earliest.id, row.earliest["at"]) == (1, "0", None)


def test_empty_tables(spark):
    assert L.found(chunks(spark, []), docs(spark, [])).count() == 0
    assert L.collapsed(chunks(spark, []), docs(spark, [])).count() == 0
