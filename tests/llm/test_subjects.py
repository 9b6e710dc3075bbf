import random

import pytest
from pyspark.sql import functions as F

from docloom.llm import subjects as U

NOUNS = {"software": "servers compilers databases browsers patches".split(), "law": "contracts verdicts courts plaintiffs clauses".split(), None: "chairs folders desks cards notes".split()}
DOC = "doc_id bigint, text string, lang string, subject string, share string"


def sentence(rng, subject):
    a, b = rng.sample(NOUNS[subject], 2)
    return rng.choice([f"We keep the {a} and the {b} in the same place every week.", f"Nobody should move the {a} before the {b} are ready.", f"Most of the {a} depend on the {b} of the other team."])


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(7)
    docs, labels, truth = [], [], {}
    for i in range(240):
        mix = [("software",), ("law",), (), ("software", "law")][i % 4]
        parts = [s for s in mix for _ in range(4)] + [None] * 4
        docs.append((i, " ".join(sentence(rng, p) for p in parts), rng.choice(["en", "EN", "eng", None]), "c", "c"))
        truth[i] = set(mix)
        if i % 3 == 0:
            labels += [(i, s.upper() + " ") for s in mix]
    docs += [(900, None, "en", "c", "c"), (901, "", "en", "c", "c"), (902, "one two", None, "c", "c"), (903, " ".join(sentence(rng, "law") for _ in range(3000)), "en", "c", "c"), (None, sentence(rng, "law"), "en", "c", "c"), docs[0]]
    truth[903] = {"law"}
    frames = spark.createDataFrame(docs, DOC), spark.createDataFrame(labels + [(0, "software"), (None, "law"), (5, "gardening"), (77777, "law")], "doc_id bigint, subject string"), spark.createDataFrame([("software", "n"), ("law", "n")], "subject string, scope_note string")
    return frames, truth


def test_found(spark, data):
    (docs, labels, subjects), truth = data
    got: dict = {}
    for r in U.found(docs, labels, subjects).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    right = sum(got.get(i, set()) == want for i, want in truth.items())
    assert right >= 0.97 * len(truth)
    assert got[903] == {"law"} and not {900, 901, 902, None} & set(got)


def test_shares(spark, data):
    (docs, labels, subjects), _ = data
    model = U.train(docs, labels, subjects)
    for r in U.subject_shares(docs, model).collect():
        assert 0 < r.share <= 1 and r.sentences >= 1 and r.weight > 0


def test_without_labels_stems_carry(spark, data):
    (docs, labels, subjects), truth = data
    got = {(r.doc_id, r.subject) for r in U.found(docs, labels.limit(0), subjects).collect()}
    assert len({x for x in got if x[1] in truth.get(x[0], ())}) >= 0.9 * sum(map(len, truth.values()))


def test_empty_tables(spark, data):
    (docs, labels, subjects), _ = data
    assert U.found(docs.limit(0), labels.limit(0), subjects).count() == 0
    assert U.found(docs, labels.limit(0), subjects.limit(0)).count() == 0


def test_statistics_cover_all_documents(spark, data):
    (docs, labels, subjects), _ = data
    rng = random.Random(8)
    rare = [(1000 + i, " ".join(sentence(rng, "law") for _ in range(5)) + " The usufruct ends.", lang, "c", "c") for i, lang in enumerate(["en", None] * 4)]
    filler = [(2000 + i, " ".join(sentence(rng, None) for _ in range(5)), lang, "c", "c") for i, lang in enumerate(["en", None] * 750)]
    model = U.train(docs.unionByName(spark.createDataFrame(rare + filler, DOC)), labels, subjects, size=100)
    assert model.terms["usufruct"][0] == model.subjects.index("law")


def test_second_counts_are_those_of_texts_that_change(spark, data):
    (docs, labels, subjects), _ = data
    names = ["law", "software"]
    corpus = U.marked(docs, labels, names, 5000)
    first = U.term_counts(corpus, names)
    model = U.fitted(first, names)
    both = first.unionByName(U.term_counts(corpus, names, model))
    got = {(r.language, r.term): (r.a, r.b, r.c) for r in both.groupBy("language", "term").agg(F.sum("n0").alias("a"), F.sum("n1").alias("b"), F.sum("n2").alias("c")).collect()}
    want: dict = {}
    for r in corpus.collect():
        sentences = U.sentences_of(r.text)
        n, by, _ = model.counts(sentences)
        for term in U.terms_of(sentences) | {""}:
            row = want.setdefault((r.language or "", term), [0, 0, 0])
            for k in [*(k for k, v in by.items() if v >= U.SHARE * n), 2]:
                row[k] += 1
    assert got == {k: tuple(v) for k, v in want.items()}
    assert U.term_counts(corpus, names, model).where("n2 <> 0").count() == 0  # no text is counted twice among all
