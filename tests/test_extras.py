import json
import struct

import numpy as np
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import answers, ingestion, search, vector_index
from docloom.sources import cases, images


def test_image_sizes(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 40, 30)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 20, 10) + b"\0" * 12
    late = b"\xff\xd8" + (b"\xff\xe1\xff\xff" + b"m" * 65533) * 20 + jpeg[8:]  # a frame behind 1.3 MB of metadata
    rows = [("a", bytearray(png)), ("b", bytearray(b"GIF89a" + struct.pack("<HH", 7, 9))), ("c", bytearray(jpeg)), ("d", bytearray(b"x")), ("e", None), ("f", bytearray(png[:18])), ("g", bytearray(late))]
    got = {r.path: (r.width, r.height) for r in images.with_dimensions(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got == {"a": (40, 30), "b": (7, 9), "c": (10, 20), "d": (None, None), "e": (None, None), "f": (None, None), "g": (10, 20)}


def test_index_recall(spark):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(12, 16))
    v = middle[rng.integers(0, 12, 600)] + 0.4 * rng.normal(size=(600, 16))
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(600, None), (601, [0.0] * 16), (None, [1.0] * 16)], "vec_id bigint, embedding array<double>")
    q = df.where("vec_id % 60 = 0").withColumnRenamed("vec_id", "query_id")
    centers = vector_index.centers_of(df, 12)
    index = vector_index.with_cells(df, centers)
    assert index.count() == 600
    exact = search.vector_top_k(q, df, k=10)
    assert vector_index.recall(vector_index.search(q, index, centers, k=10, probes=4), exact).first().recall >= 0.9
    assert vector_index.recall(vector_index.search(q, index, centers, k=10, probes=12), exact).first().recall == 1.0
    assert len(vector_index.centers_of(df.limit(0), 4)) == 0


def test_cases(spark, tmp_path):
    body = "Open the account screen and choose the posting that you want to move to the other window."
    one = {"id": "c1", "question": "move posting", "expected_top_source": "a.md", "forbidden_answer_terms": ["paper"], "candidates": [{"source_file": "p.md", "title": "Printer", "heading": "Printer", "score": 0.6, "text": "The printer needs paper every other week, as everyone in the house knows."}, {"source_file": "a.md", "title": "Move posting", "heading": "Move posting", "score": 0.5, "text": body}]}
    two = {**one, "id": "c2", "expected_top_source": "p.md"}
    (tmp_path / "cases.json").write_text(json.dumps([one, two]))
    c, hits = cases.read_cases(spark, str(tmp_path))
    q = c.select("query_id", "question")
    final = search.retrieve(hits, q)
    assert {r.id: r.passed for r in cases.checked(c, final, answers.answers(final, q)).collect()} == {"c1": True, "c2": False}


def test_deletion_and_maps(spark):
    docs = spark.createDataFrame([("a",), ("b",)], "document_id string")
    chunks = spark.createDataFrame([("a", "t"), ("b", "t")], "document_id string, content string")
    links = spark.createDataFrame([(1, "a", "b"), (2, "b", "a"), (3, "b", None)], "link_id int, source_document_id string, target_document_id string")
    d, c, left = ingestion.deleted(docs, chunks, links, docs.where("document_id = 'a'"))
    assert d.count() == 1 and c.count() == 1 and sorted(map(tuple, left.collect())) == [(2, "b", None), (3, "b", None)]
    assert ingestion.reindexed(chunks, docs, ingestion.hashing_embedder(4)).count() == 2
    m = spark.createDataFrame([({"a\x01": " x ", "a": "y", "n": None},), (None,), ({},)], "m map<string,string>").select(T.sanitize_map(F.col("m")).alias("m")).collect()
    assert m[0].m in ({"a": "y", "n": None}, {"a": "x", "n": None}) and m[1].m is None and m[2].m == {}
