import pytest

from docloom import storage


def test_sides_are_broadcast_by_their_bytes(spark):
    df = spark.range(1000).selectExpr("id", "repeat('x', 100) AS t", "array(1L, 2L) AS a", "named_struct('s', 'ab') AS s")
    assert 130_000 < storage.bytes_of(df) < 200_000 and storage.bytes_of(df.limit(0)) == 0
    big = spark.range(1000).withColumnRenamed("id", "k")
    plan = lambda side: big.join(side, big["k"] == side["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(storage.small_side(df)) and "broadcast" not in plan(storage.small_side(df, 1000))


def test_written_tables_are_deleted(spark):
    out = storage.written(spark.range(3), "t")
    path = out.__dict__["_docloom_path"].removeprefix("file://")
    assert out.count() == 3
    import os

    assert os.path.isdir(path)
    storage.clear(spark)
    assert not os.path.isdir(path)


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        storage.shared_dir(Session())


def test_salted_join_is_a_join(spark):
    left = spark.range(500).selectExpr("id % 3 AS k", "id AS v")
    right = spark.createDataFrame([(0, "a"), (1, "b"), (9, "c")], "k bigint, t string")
    want = sorted(map(tuple, left.join(right, "k").collect()))
    assert sorted(map(tuple, storage.skewed_join(left, right, ["k"]).select("k", "v", "t").collect())) == want
    salted = storage.skewed_join(left, right, ["k"], max_bytes=-1).select("k", "v", "t")
    assert sorted(map(tuple, salted.collect())) == want and "_salt" in salted._jdf.queryExecution().optimizedPlan().toString()
