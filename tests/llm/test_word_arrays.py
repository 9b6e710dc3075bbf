import random
from collections import Counter

import pyarrow as pa
import pytest

from docloom.llm import subjects as U
from docloom.llm import word_arrays as A

ODD = [
    None,
    "",
    " ",
    "x y z.) a b c.\x1cd e f\x85g h i_j; k l m.\"\n",
    "q r s?\"'») ",
    "t u v.)w x y",
    "a b c…\n\n\n \n",
    "---\nkind: table\n---\nOne <b>two three</b> four. Five six",
    "İstanbul ΟΔΟΣ ΟΔΟΣ. ½ a²b c_d x—y \U0001d49c\U0001d4b7c z.  one\n\n\ntwo three four\nfive six seven",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    mixed = ["".join(rng.choice(["a", "b ", " ", ".", "!", "\n", '"', ")", "court ", "contracts ", "’", "the server ", "_", "\t", "7"]) for _ in range(rng.randint(0, 80))) for _ in range(600)]
    return ODD + mixed


@pytest.fixture(scope="module", params=[10**6, 300])
def read(request, texts):
    """(texts, their words), together or a few at a time."""
    return [(texts[at], A.Words([U.body_of(t) for t in texts[at]])) for at in A.pieces(texts, request.param)]


def test_sentences(read):
    for own, words in read:
        got: list = [[] for _ in own]
        sentences: dict = {}
        for word, sentence in zip(words.word.tolist(), words.sentence.tolist()):
            sentences.setdefault(sentence, []).append(words.unique[word])
        for i, s in sorted(sentences.items()):
            got[words.text[i]].append(s)
        assert got == [U.sentences_of(t) for t in own]
        assert words.n.tolist() == [len(s) for s in got] and words.size.tolist() == [len(s) for x in got for s in x]


def test_weights_of_sentences_are_those_of_the_terms_in_them(read, texts):
    terms = sorted(set().union(*(U.terms_of(U.sentences_of(t)) for t in texts)) | {"nowhere", "b b"})
    model = U.Model(["a", "b", "c"], {t: (i * i % 3, 0.3 + i % 7 / 10) for i, t in enumerate(terms)}, 0.5)
    sentences = 0
    for own, words in read:
        n, weight = model.tally(words)
        for t, got, sums in zip(own, n, weight):
            _, by, of = model.counts(U.sentences_of(t))
            assert got.tolist() == [by[k] for k in range(3)] and sums.tolist() == [of[k] for k in range(3)]
        sentences += n.sum()
    assert sentences > 100
    assert not U.Model(["a"], {}).tally(read[0][1])[0].any()


def test_stems(read):
    stems = [("court", "contract"), ("serv", "court"), ()]

    def seeds(sentences):
        n = [sum(any(w.startswith(s) for w in words for s in all_) for words in sentences) for all_ in stems]
        out = [v >= 2 and v >= U.SHARE * len(sentences) and 3 * v >= max(n) for v in n]
        return out if sum(out) <= 2 else [False] * 3

    finder, some = U.Stems(stems), 0
    for own, words in read:
        got = finder.seeded(words).tolist()
        assert got == [seeds(U.sentences_of(t)) for t in own]
        some += sum(map(any, got))
    assert some > 20


@pytest.mark.parametrize("merged", [False, True])
def test_terms_count_texts(read, merged):
    counts, want, i = A.TermCounts(), Counter(), 0
    for own, words in read:
        groups = [[("en", 1), ("de", -1), None][(i + j) % 3] for j in range(len(own))]
        counts.add(words, groups)
        for t, group in zip(own, groups):
            for term in (U.terms_of(U.sentences_of(t)) | {""}) if group else ():
                want[(group[0], term)] += group[1]
        i += len(own)
        if merged:
            counts.merge()
    batches = list(counts.batches({"n": lambda g: g[1]}, lambda g: g[0]))
    rows = [tuple(r.values()) for b in batches for r in b.to_pylist()]
    assert len(rows) == len(want) and {(language, term): n for language, term, n in rows} == want
    assert not list(A.TermCounts().batches({"n": lambda g: 1}, lambda g: "en"))


def test_blocks_keep_rows_and_put_a_term_into_one_part(texts):
    columns, language, part_of, rows = {"n0": lambda g: g[1]}, lambda g: g[0], {}, []
    schema = pa.schema([("language", pa.string()), ("term", pa.string()), ("n0", pa.int64())])
    for own in (texts[:300], texts[300:], texts[100:200]):  # tasks with other vocabularies
        counts = A.TermCounts()
        counts.add(A.Words([U.body_of(t) for t in own]), [("en", 1) if i % 2 else ("de", 2) for i in range(len(own))])
        for part, batch in counts.parted(columns, language, 5):
            for r in batch.to_pylist():
                assert part_of.setdefault(r["term"], part) == part
        want = [r for b in counts.batches(columns, language) for r in b.to_pylist()]
        got = [r for b in A.unpacked(A.packed(counts.parted(columns, language, 5)), schema) for r in b.to_pylist()]
        assert sorted(map(str, got)) == sorted(map(str, want))
        rows += got
    assert set(part_of.values()) == {-1, 0, 1, 2, 3, 4} and [t for t, p in part_of.items() if p == -1] == [""]
    assert not list(A.packed(A.TermCounts().parted(columns, language, 5)))


def test_blocks_and_rows_give_one_model(spark):
    noun = {0: "contracts verdicts courts", 1: "servers patches browsers", 2: "chairs desks cards"}
    rng = random.Random(5)
    docs = [(["en", None][i % 2], ". ".join(f"we saw the {rng.choice(noun[i % 3].split())} and the {rng.choice(noun[i % 3].split())} again" for _ in range(6)), [i % 3] if i % 3 < 2 else None) for i in range(120)]
    corpus = spark.createDataFrame(docs, "language string, text string, labels array<int>").repartition(3)
    names = ["law", "software"]
    blocks = U.term_blocks(corpus, names, U.parts_of(corpus))
    model, other = U.fitted(blocks, names), U.fitted(U.rows_of(blocks, names), names)
    assert model.terms.keys() == other.terms.keys() and all(other.terms[t][0] == k and abs(other.terms[t][1] - w) < 1e-9 for t, (k, w) in model.terms.items())
    assert model.terms["courts"][0] == 0 and model.terms["servers"][0] == 1 and "chairs" not in model.terms


def test_sums_are_the_same_in_steps():
    batches = [pa.RecordBatch.from_pydict({"language": ["en", "en", "de"], "term": ["x", "y", "x"], "n0": pa.array([1, i, -2], pa.int64())}) for i in range(5)]
    whole, steps = U.summed(None, batches, ["n0"]), None
    for b in batches:
        steps = U.summed(steps, [b], ["n0"])
    assert sorted(map(str, whole.to_pylist())) == sorted(map(str, steps.to_pylist()))
    assert {(r["language"], r["term"]): r["n0"] for r in whole.to_pylist()} == {("en", "x"): 5, ("en", "y"): 10, ("de", "x"): -10}
    assert len(U.summed(None, [], ["n0"])) == 0
