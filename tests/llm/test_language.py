import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import language as L

SAMPLES = {
    "en": "the house stands near the old river and many people walk along the water every morning with their dogs while others wait for the bus to work".split(),
    "de": "das haus steht nahe dem alten fluss und viele menschen gehen jeden morgen mit ihren hunden am wasser entlang während andere auf den bus warten".split(),
    "fr": "la maison se trouve près de la vieille rivière et beaucoup de gens marchent chaque matin avec leurs chiens pendant que les autres attendent le bus".split(),
}
CHUNK = "vector_id string, document_id string, content string, chunk_metadata map<string,string>, language string, words int"
DOC = "document_id string, doc_metadata string, language string"


def sentence(lang, rng, n=14):
    return " ".join(rng.choice(SAMPLES[lang]) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(1)
    rows = []
    for i in range(240):
        lang = "en de fr".split()[i % 3]
        wrong = i % 12 == 0
        rows.append((f"c{i}", f"d{i // 3 * 3 + i % 3}", "\n".join(sentence(lang, rng) for _ in range(4)), {"language": "de-AT" if wrong and lang == "en" else {"en": "English", "de": "DE", "fr": "fra"}[lang]}, "x", 1))
    rows.append(("mix", "dm", sentence("en", rng) + " " + sentence("fr", rng) + "\n" + sentence("en", rng), {"language": "en"}, "x", 1))
    rows += [("none", "dm", None, None, "x", 1), ("blank", "dm", " \n", {}, "x", 1), ("digits", "dn", "12 34 56 78 90 12 34 56 78 90", {"language": None}, "x", 1), (None, None, None, None, None, None), ("long", "dl", " ".join(sentence("de", rng) for _ in range(2000)), {"language": "unknown"}, "x", 1)]
    rows.append(rows[0])
    docs = [(f"d{i}", '{"language": "fr"}', "x") for i in range(6)] + [("dm", None, "x"), ("dl", '{"language": ""}', "x"), ("empty", "{}", "x")]
    return spark.createDataFrame(rows, CHUNK), spark.createDataFrame(docs + docs[:1], DOC)


def test_labels_name_languages(spark):
    got = spark.createDataFrame([("en_GB",), ("ENG",), ("German",), ("ru-RU",), ("und",), ("unknown",), ("",), (None,), ("n/a",), ("pt",)], "x string").select(L.label_code(F.col("x"))).collect()
    assert [r[0] for r in got] == ["en", "en", "de", "ru", None, None, None, None, None, "pt"]


def test_held_out_sentences_get_their_language(spark, data):
    trees = L.train(data[0])
    assert trees.languages == ["de", "en", "fr"]
    rng = random.Random(2)
    for lang in SAMPLES:
        for _ in range(30):
            _, _, bits, _ = L.Scorer(trees).sentences([sentence(lang, rng, 10)])
            assert trees.languages[int(bits.argmin())] == lang


def test_texts_in_an_unknown_language_are_rejected(spark, data):
    strange = "alla mattina cinque persone vanno verso il mercato vecchio con quattro cesti pieni di mele rosse".split()
    rng = random.Random(3)
    rows = [(f"s{i}", "ds", " ".join(rng.choice(strange) for _ in range(14)), None, "x", 1) for i in range(5)]
    more = spark.createDataFrame(rows, CHUNK)
    got = L.segments(data[0].unionByName(more)).collect()
    assert {r.language for r in got if r.document_id == "ds"} == {"und"} and all(r.confidence < 0.05 for r in got if r.document_id == "ds")
    assert all(r.language != "und" and r.confidence > 0.5 for r in got if r.document_id not in ("ds", "dn"))
    assert not [r for r in L.found(data[0].unionByName(more), data[1]).collect() if r.record_id in ("ds", *[x[0] for x in rows])]


def test_code_lengths_are_exact_sums(data):
    trees = L.train(data[0])
    known = {}
    a, b = trees.bits("haus", known), trees.bits("maison", {})
    _, _, bits, _ = L.Scorer(trees).sentences(["Haus, maison!"])
    assert np.allclose(bits[0], a + b)
    assert not trees.bits("a1").any()


def test_found(spark, data):
    rows = {(r.record, r.record_id, r.language) for r in L.found(*data).collect()}
    chunks = {x for x in rows if x[0] == "chunk"}
    wrong = {("chunk", f"c{i}", "en") for i in range(240) if i % 12 == 0}
    assert chunks == wrong | {("chunk", "mix", "en"), ("chunk", "mix", "fr"), ("chunk", "long", "de")}
    assert {x for x in rows if x[0] == "document"} == {("document", "d0", "en"), ("document", "d3", "en"), ("document", "d1", "de"), ("document", "d4", "de"), ("document", "dm", "en"), ("document", "dl", "de")}


def test_empty_and_unlabelled(spark, data):
    chunks, docs = data
    assert L.found(chunks.limit(0), docs.limit(0)).count() == 0
    assert L.segments(chunks.withColumn("chunk_metadata", F.lit(None).cast("map<string,string>"))).count() == 0
