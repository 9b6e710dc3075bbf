import cProfile
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from docloom.llm import language as L

WORD, SENTENCE = re.compile(r"[^\W_]+"), re.compile(r"(?<=[.!?…;])[\"'»)”]*\s+|\n+")
SAID = {
    "de": "das haus steht nahe dem alten fluss und viele menschen gehen jeden morgen während andere warten".split(),
    "en": "the house stands near the old river and many people walk along the water every morning".split(),
    "ru": "дом стоит у старой реки и многие люди гуляют каждое утро".split(),
}
ODD = [None, "", " \n", "12 34. 56", "a1 b2 c3.\nThe old house.", "x", "a.\x1cb c\x85d_e—f½ g²h\U0001d49c", "one.) two.] three!?\"\n\n\nDas Haus", "İstanbul ΟΔΟΣ ΟΔΟΣ. straße", "the " * 40 + "]. 7 7.\n8 8 8\n" + "das " * 40]


class Plain:
    """The method as it is defined: byte by byte, word by word, text by text."""

    def __init__(self, counts):
        self.n = Counter({k: n for k, n in counts.items() if n > 1})
        self.languages = sorted({x for x, _ in self.n})
        self.kinds, self.total = Counter(), Counter()
        for (language, gram), n in self.n.items():
            self.kinds[language, gram[:-1]] += 1
            self.total[language, gram[:-1]] += n

    def byte(self, language, gram):
        if not gram:
            return 8.0
        context, shorter = (language, gram[:-1]), self.byte(language, gram[1:])
        if not self.kinds[context]:
            return shorter
        total, n = self.total[context] + self.kinds[context], self.n[language, gram]
        return math.log2(total / n) if n else math.log2(total / self.kinds[context]) + shorter

    def word(self, w):
        text = f" {w} ".encode()
        return [0.0 if re.search(r"\d", w) else sum(self.byte(x, text[max(0, i - 4) : i + 1]) for i in range(1, len(text))) for x in self.languages]

    def sentences(self, text):
        """(words, bits, language) of each sentence."""
        said = [w for s in SENTENCE.split(text or "") if (w := WORD.findall(s.lower()))]
        if not said:
            return []
        bits = np.array([np.sum([self.word(w) for w in words], axis=0) for words in said])
        cost, back = bits[0], []
        for row in bits[1:]:
            best = int(cost.argmin())
            back.append([k if cost[k] <= cost[best] + 14 else best for k in range(len(cost))])
            cost = np.minimum(cost, cost[best] + 14) + row
        path = [int(cost.argmin())]
        for b in reversed(back):
            path.append(b[path[-1]])
        return list(zip(said, bits, path[::-1]))

    def passages(self, text):
        """(number, language, confidence, words, sentences, bits a byte)"""
        said, out = self.sentences(text), []
        for words, bits, k in said if any(b.any() for _, b, _ in said) else []:
            if not out or out[-1][0] != k:
                out.append([k, 0, 0, 0, 0])
            out[-1][1:] = out[-1][1] + bits, out[-1][2] + len(words), out[-1][3] + 1, out[-1][4] + sum(len(w.encode()) + 1 for w in words if not re.search(r"\d", w))
        return [(i, self.languages[k], 1 / sum(2 ** min(b[k] - x, 60) for x in b), words, n, b[k] / max(1, size)) for i, (k, b, words, n, size) in enumerate(out)]


def grams(said):
    """Counts of (language, words)."""
    out = Counter()
    for language, words in said:
        for text in [f" {w} ".encode() for w in words if not re.search(r"\d", w)]:
            out.update((language, text[i - k : i + 1]) for i in range(1, len(text)) for k in range(min(4, i) + 1))
    return out


@pytest.fixture(scope="module")
def sample():
    rng = random.Random(5)
    out = []
    for _ in range(90):
        language = label = rng.choice(list(SAID))
        text = ""
        for _ in range(rng.randint(1, 12)):
            language = rng.choice(list(SAID)) if rng.random() < 0.15 else language
            text += " ".join(rng.choice(SAID[language]) for _ in range(rng.randint(1, 12))) + rng.choice([". ", ".» ", "\n", "; 7 8\n", ", "])
        out.append((label, text))
    return out + [("en", x) for x in ODD]


def as_dict(counts):
    return {(x, int(g & (1 << 40) - 1).to_bytes(int(g >> 40))): n for x, g, n in zip(*counts)}


@pytest.fixture(scope="module")
def plain(sample):
    return Plain(grams((x, WORD.findall((t or "").lower())) for x, t in sample))


@pytest.fixture(scope="module")
def trees(spark, sample, plain):
    counts = L.counted(spark.createDataFrame(sample, "language string, text string").repartition(3))
    assert as_dict(counts) == dict(plain.n)
    return L.Trees(*counts)


def test_passages_are_those_of_the_definition(sample, plain, trees):
    texts, mixed = [t for _, t in sample], 0
    for step in (1, 7, len(texts)):
        got = [[] for _ in texts]
        for at in range(0, len(texts), step):
            text, *columns = L.passages(L.Scorer(trees), texts[at : at + step])
            for t, *row in zip(text.tolist(), *(c.to_pylist() for c in columns)):
                got[at + t].append(tuple(row))
        for text, rows in zip(texts, got):
            want = plain.passages(text)
            assert [(*r[:2], *r[3:5]) for r in rows] == [(*r[:2], *r[3:5]) for r in want]
            assert np.allclose([r[2::3] for r in rows], [r[2::3] for r in want], rtol=1e-4)
            mixed += len(rows) > 1
    assert mixed > 30


def test_relabelled_counts_are_those_of_the_definition(spark, sample, plain, trees):
    got = L.counted(spark.createDataFrame(sample, "language string, text string").repartition(3), spark.sparkContext.broadcast(trees))
    said = [(plain.languages[k], words) for _, t in sample for words, _, k in plain.sentences(t) if len(words) >= 4]
    assert as_dict(got) == dict(Plain(grams(said)).n)


def test_words_and_their_bytes_are_not_scored_one_by_one(trees):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(4000)]
    scorer, watch = L.Scorer(trees), cProfile.Profile()
    watch.enable()
    scorer.sentences([" ".join(words[i : i + 40]) for i in range(0, len(words), 40)])
    watch.disable()
    assert sum(x.callcount for x in watch.getstats()) < 3 * len(words)


def test_nothing_to_score(trees):
    for texts in ([], [None], ["1 2 3"]):
        text, *columns = L.passages(L.Scorer(trees), texts)
        assert not len(text) and not any(map(len, columns))
