"""Problem 8: the subjects that each document deals with.

Weighted terms (words and pairs of words) are matched in one pass by an Aho-Corasick automaton over the normalized text.
A sentence deals with a subject if the weights of its terms, normalized by the length of the sentence, exceed a threshold
calibrated on labelled documents; a document, if at least one in five of its sentences does.

The terms are curated: they begin with word stems kept below and with the labelled documents, and a term is kept only
where it is far more frequent in documents of its subject than documents of the same language let expect. Its weight is
the logarithm of that ratio, so common words weigh nothing. How often a term stands in documents, and in those of each
subject, is counted over all documents; bounded (``SAMPLE``) is only the number of labelled documents whose labels are used.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.language import label_code
from docloom.llm.word_arrays import Matcher, TermCounts, Words, found_in, packed, pieces, starts_of, unpacked
from docloom.storage import spread, written

#: Labelled documents that the first model and the threshold are fitted to (by a hash of their ids).
SAMPLE = 5000
#: Share of the sentences that must deal with a subject.
SHARE = 0.2
#: Counted rows that a task holds before it passes them on, or adds them up.
ROWS = 1_000_000
#: Thresholds tried in calibration.
GRID = (0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 4.0)
#: Stems of words that stand for a subject, in the languages of the corpus.
STEMS = {
    "software": "software server database browser datenbank programm quelltext logiciel serveur programme navigateur servidor programa navegador repositori интерфейс программ сервер браузер",
    "law": "contract court verdict plaintiff vertrag verträge gericht gesetz klage contrat tribunal jugement juridique contrato sentencia leyes demanda contratt sentenz legg avvocat договор суд закон юридическ",
    "finance": "invoice budget dividend bank rechnung bilanz steuer konto zinsen facture bancaire taxe acompte factura impuesto bancari presupuesto fattur bilanc impost налог баланс банк бюджет",
    "medicine": "patient vaccine symptom diagnos impfstoff medikament kranken vaccin médicament ordonnance paciente vacuna síntoma medicamento pazient sintom farmac пациент вакцин симптом диагноз лекарств",
    "sport": "match tournament goalkeeper referee stadium turnier torhüter schiedsrichter stadion tournoi arbitre stade partido torneo estadio árbitro partit torne stadi arbitr матч турнир вратар стадион",
    "science": "molecule experiment microscope telescope molekül mikroskop teleskop hypothes molécule expérience télescope molécula experimento telescopio molecol esperiment microscop молекул эксперимент микроскоп телескоп",
    "hospitality": "hotel guest room breakfast reservation gäste zimmer frühstück reservierung chambre réservation déjeuner huésped habitación desayuno reserva ospit camer colazion prenotazion отел гост завтрак бронирован",
}
_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"<[^<>]{1,200}>")
_MATTER = re.compile(r"\A\s*---\s*\n.*?\n---\s*(?:\n|\Z)", re.S)
_SENTENCE = re.compile(r"[.!?…;\n](?:(?<!\n)[\"'»)”\]]*\s+|(?<=\n)\n*)")


def body_of(text: str | None) -> str:
    """A text in lower case; front matter and tags don't count."""
    return _TAG.sub("\n", _MATTER.sub("", text or "")).lower()


def sentences_of(text: str | None) -> list[list[str]]:
    """The words of each sentence of three words or more."""
    return [w for s in _SENTENCE.split(body_of(text)) if len(w := _WORD.findall(s)) >= 3]


def terms_of(sentences: list[list[str]]) -> set[str]:
    """Words of four letters or more and pairs of words, without digits."""
    out: set[str] = set()
    for words in sentences:
        if "".join(words).isalpha():
            out.update(map(" ".join, zip(words, words[1:])))
            out.update([w for w in words if len(w) >= 4])
        else:
            plain = [w if w.isalpha() else None for w in words]
            out.update([w for w in plain if w and len(w) >= 4], [f"{a} {b}" for a, b in zip(plain, plain[1:]) if a and b])
    return out


class Model:
    """Terms with their subject and weight, and the threshold of a sentence."""

    def __init__(self, subjects: list[str], terms: dict[str, tuple[int, float]], threshold: float = 1.0):
        self.subjects, self.terms, self.threshold = subjects, terms, threshold
        self._find = self._matcher = None

    def __getstate__(self):
        return {"subjects": self.subjects, "terms": self.terms, "threshold": self.threshold, "_find": None, "_matcher": None}

    @property
    def find(self):
        if self._find is None:
            self._find = ahocorasick.Automaton()
            for term, what in self.terms.items():
                self._find.add_word(f" {term} ", what)
            self._find.make_automaton()
        return self._find

    def scores(self, words: list[str]) -> list[float]:
        """The normalized weight of each subject in a sentence."""
        out = [0.0] * len(self.subjects)
        if not self.terms:
            return out
        for _, (k, weight) in self.find.iter(f" {' '.join(words)} "):
            out[k] += weight
        scale = math.sqrt(max(len(words), 4) / 12)
        return [x / scale for x in out]

    def best(self, words: list[str]) -> tuple[int, float] | None:
        """The subject of a sentence, whatever the threshold: the one with more than twice the weight of any other."""
        scores = self.scores(words)
        if not any(scores):
            return None
        top = max(scores)
        second = sorted(scores)[-2] if len(scores) > 1 else 0.0
        return (scores.index(top), top) if top > 2 * second and top > 0 else None

    def counts(self, sentences: list[list[str]], threshold: float | None = None) -> tuple[int, Counter, Counter]:
        """The number of sentences, and sentences and weight of each subject."""
        least = self.threshold if threshold is None else threshold
        n, weight = Counter(), Counter()
        for words in sentences:
            top = self.best(words)
            if top and top[1] >= least:
                n[top[0]] += 1
                weight[top[0]] += top[1]
        return len(sentences), n, weight

    def tally(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The same sentences and weights of ``counts`` for many texts: a row a text, a column a subject."""
        text, k, weight = self.tops(words)
        return self.summed(words, text, k, weight, self.threshold)

    def summed(self, words: Words, text: np.ndarray, k: np.ndarray, weight: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Number and weight of the sentences of ``tops`` with at least this weight."""
        width, texts, deals = len(self.subjects), len(words.n), weight >= least
        at = text[deals] * width + k[deals]
        return np.bincount(at, minlength=texts * width).reshape(texts, width), np.bincount(at, weight[deals], texts * width).astype(float).reshape(texts, width)

    def tops(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``best`` of the sentences that have one, in order: text, subject and weight."""
        if self._matcher is None:
            self._matcher = Matcher(list(self.terms)), np.array([k for k, _ in self.terms.values()], np.int64), np.array([w for _, w in self.terms.values()], float)
        matcher, subject, weight = self._matcher
        width = len(self.subjects)
        sentence, term = matcher.matches(words)
        scores = np.bincount(sentence * width + subject[term], weight[term], len(words.size) * width).reshape(len(words.size), width)
        scores = scores / np.sqrt(np.maximum(words.size, 4) / 12)[:, None]
        if not scores.size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        top = scores.max(1)
        second = np.sort(scores, 1)[:, -2] if width > 1 else 0.0
        has = (top > 2 * second) & (top > 0)
        return words.text[has], scores[has].argmax(1), top[has]


def marked(texts: DataFrame, labels: DataFrame, subjects: list[str], size: int) -> DataFrame:
    """Every text (language, text, labels); ``labels`` are the subjects of a bounded sample of labelled documents, else null."""
    place = F.create_map(*[F.lit(x) for i, s in enumerate(subjects) for x in (s, i)])
    known = labels.select("doc_id", F.try_element_at(place, F.lower(F.trim("subject"))).alias("k")).where("doc_id IS NOT NULL AND k IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.array_sort(F.collect_set("k")).alias("labels"))  # at most one a subject
    hand = F.broadcast(written(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size), "labelled-sample"))  # at most size ids
    return spread(texts.where("text IS NOT NULL").select("doc_id", label_code(F.col("lang")).alias("language"), "text")).join(hand, "doc_id", "left").drop("doc_id")


class Stems:
    """Finds beginnings of words, with the subjects that they stand for."""

    def __init__(self, stems: list[tuple[str, ...]]):
        self.width = len(stems)
        self.of = [(stem, k) for k, all_ in enumerate(stems) for stem in dict.fromkeys(all_)]
        self.ids = {stem: i for i, stem in enumerate(dict.fromkeys(stem for stem, _ in self.of))}
        self.stands = np.zeros((len(self.ids), self.width), bool)
        for stem, k in self.of:
            self.stands[self.ids[stem], k] = True
        self.find = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for stem, i in self.ids.items():
            self.find.add_word(f" {stem}", i)
        self.find.make_automaton()

    def seeded(self, words: Words) -> np.ndarray:
        """For each text and subject whether its stems stand in two sentences and in at least a fifth of all."""
        n = np.zeros((len(words.n), self.width), np.int64)
        if len(self.find) and len(words.word):
            end, stem = found_in(self.find, " " + " ".join(words.unique))
            begins = np.cumsum([0, *[len(w) + 1 for w in words.unique]])
            of_word = np.zeros((len(words.unique), self.width), bool)
            np.logical_or.at(of_word, np.searchsorted(begins, end, "right") - 1, self.stands[stem])
            for k in range(self.width):
                sentence = words.sentence[of_word[words.word, k]]
                n[:, k] = np.bincount(words.text[sentence[starts_of(sentence)]], minlength=len(n))
        found = (n >= 2) & (n >= SHARE * words.n[:, None]) & (3 * n >= n.max(1, initial=0)[:, None])
        return found & (found.sum(1) <= 2)[:, None]


def counts_schema(subjects: list[str]) -> pa.Schema:
    """Of the rows of ``term_counts``."""
    return pa.schema([("language", pa.string()), ("term", pa.string()), *[(f"n{i}", pa.int64()) for i in range(len(subjects) + 1)]])


def term_counts(corpus: DataFrame, subjects: list[str], model: Model | None = None) -> DataFrame:
    """(language, term, n0, n1, ...), to be summed: in how many texts of each subject a term stands, and last in how many of all.

    Without a model the subjects are those labelled by hand or stems. With one, they are those that ``model`` assigns, and the
    rows are what that changes: only texts whose subjects are others now are counted, up and down. Texts of no known
    language are one group; the term ``''`` stands in every text.
    """
    return rows_of(term_blocks(corpus, subjects, parts_of(corpus), model), subjects)


def rows_of(blocks: DataFrame, subjects: list[str]) -> DataFrame:
    """The rows of ``term_counts`` that ``blocks`` hold."""
    schema = counts_schema(subjects)
    return blocks.mapInArrow(lambda batches: unpacked(batches, schema), ", ".join(["language string", "term string", *[f"{n} bigint" for n in schema.names[2:]]]))


def parts_of(corpus: DataFrame) -> int:
    """Into how many parts terms are divided: as many as a shuffle has."""
    return int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def term_blocks(corpus: DataFrame, subjects: list[str], parts: int, model: Model | None = None) -> DataFrame:
    """(part, size, block): the rows of ``term_counts``, packed by tasks. All rows of a term are in blocks of one part."""
    stems = [tuple(STEMS.get(s, "").split()) for s in subjects]
    width = len(subjects)
    sent = corpus.sparkSession.sparkContext.broadcast(model)

    columns = {f"n{i}": (lambda g, i=i: (i in g[1]) - (i in g[2])) for i in range(width + 1)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, model, counts = Stems(stems), sent.value, TermCounts()
        for batch in batches:
            languages, texts, labels = (c.to_pylist() for c in batch.columns)
            for at in pieces(texts):
                words = Words([body_of(t) for t in texts[at]])
                before = finder.seeded(words)
                for i, ks in enumerate(labels[at]):
                    if ks:
                        before[i] = False
                        before[i, ks] = True
                if model is None:
                    gained, lost = np.c_[before, np.ones(len(before), bool)], np.zeros_like(before)
                else:
                    n = model.tally(words)[0]
                    now = (n > 0) & (n >= SHARE * words.n[:, None])
                    gained, lost = now & ~before, before & ~now
                sides = [(language or "", tuple(np.flatnonzero(a).tolist()), tuple(np.flatnonzero(b).tolist())) for language, a, b in zip(languages[at], gained, lost)]
                counts.add(words, [g if g[1] or g[2] else None for g in sides])
                if counts.rows > 2 * ROWS and counts.merge() > ROWS:
                    yield from packed(counts.parted(columns, itemgetter(0), parts))
                    counts = TermCounts()
        yield from packed(counts.parted(columns, itemgetter(0), parts))

    return written(corpus.select("language", "text", "labels").mapInArrow(run, "part int, size bigint, block binary"), "term-counts")


def fitted(counts: DataFrame, subjects: list[str]) -> Model:
    """The model of the terms that ``counts`` (of ``term_blocks`` or ``term_counts``, one or several together) lets through.

    The tasks have added up their texts, so the rows are sent once, by their terms, and all sums of a term are made where
    its rows are.
    """
    width = len(subjects)
    schema = counts_schema(subjects)
    names = schema.names[2:]
    blocks = "block" in counts.columns
    # a row a language
    texts = rows_of(counts.where("part = -1"), subjects) if blocks else counts.where("term = ''")
    totals = {r[0]: r[1:] for r in texts.groupBy("language").agg(*[F.sum(n).alias(n) for n in names]).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, new = None, []
        for batch in unpacked(batches, schema) if blocks else batches:
            new.append(batch)
            if sum(map(len, new)) >= ROWS:
                rows, new = summed(rows, new, names), []
        rows = summed(rows, new, names)
        if not len(rows):
            return
        languages, terms = (rows.column(c).combine_chunks().dictionary_encode() for c in ("language", "term"))
        n = np.stack([rows.column(c).to_numpy() for c in names], 1)
        total = np.array([totals[x] for x in languages.dictionary.to_pylist()], float)[languages.indices.to_numpy()]
        of, size = terms.indices.to_numpy(), len(terms.dictionary)
        # what documents of the term's languages let expect, subject by subject
        share = (n[:, width] + 0.3) / (total[:, width] + 1)
        v = np.stack([np.bincount(of, n[:, i], size) for i in range(width)], 1)
        e = np.stack([np.bincount(of, share * total[:, i], size) for i in range(width)], 1) + 0.05
        lifts = v / e
        k = width - 1 - lifts[:, ::-1].argmax(1)
        at = np.arange(size), k
        lift, v, e = lifts[at], v[at], e[at]
        second = np.sort(lifts, 1)[:, -2] if width > 1 else 0.0
        kept = np.flatnonzero((v >= 2) & (lift >= 2) & (lift >= 1.7 * second) & ((v - e) / np.sqrt(e) >= 3.5))
        weight = np.log(lift[kept]) * np.minimum(1.0, v[kept] / 4)
        yield pa.RecordBatch.from_arrays([terms.dictionary.take(pa.array(kept)), pa.array(k[kept], pa.int32()), pa.array(weight)], ["term", "k", "weight"])

    sent = counts.where("part >= 0").repartitionById(parts_of(counts), "part") if blocks else counts.where("term <> ''").select(schema.names).repartition("term")
    kept = sent.mapInArrow(run, "term string, k int, weight double").collect()  # those that pass
    return Model(subjects, {r.term: (r.k, r.weight) for r in sorted(kept)})


def summed(rows: pa.Table | None, more: list[pa.RecordBatch], names: list[str]) -> pa.Table:
    """The sums of each language and term."""
    schema = pa.schema([("language", pa.string()), ("term", pa.string()), *[(n, pa.int64()) for n in names]])
    parts = [pa.Table.from_batches(more).cast(schema)] if more else []
    every = pa.concat_tables([*([] if rows is None else [rows]), *parts]) if parts or rows is not None else schema.empty_table()
    out = every.group_by(["language", "term"], use_threads=False).aggregate([(n, "sum") for n in names])
    return out.select(["language", "term", *[f"{n}_sum" for n in names]]).rename_columns(schema.names)


def calibrated(model: Model, sample: DataFrame) -> Model:
    """The model with the threshold that agrees best (F1) with the labelled documents; 1 where there are none."""
    sent = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, tally = sent.value, {t: np.zeros(3, np.int64) for t in GRID}
        for batch in batches:
            texts, labels = (c.to_pylist() for c in batch.columns)
            for at in pieces(texts):
                words = Words([body_of(t) for t in texts[at]])
                wanted = np.zeros((len(words.n), len(model.subjects)), bool)
                for i, ks in enumerate(labels[at]):
                    wanted[i, ks] = True
                tops = model.tops(words)
                for t in GRID:
                    n = model.summed(words, *tops, t)[0]
                    said = (n > 0) & (n >= SHARE * words.n[:, None])
                    tally[t] += [(said & wanted).sum(), (said & ~wanted).sum(), (wanted & ~said).sum()]
        yield pa.RecordBatch.from_arrays([pa.array(list(tally), pa.float64()), *[pa.array([v[i] for v in tally.values()], pa.int64()) for i in range(3)]], ["t", "tp", "fp", "fn"])

    rows = sample.select("text", "labels").mapInArrow(run, "t double, tp bigint, fp bigint, fn bigint").groupBy("t").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).collect()
    scored = [(2 * r.tp / max(1, 2 * r.tp + r.fp + r.fn), r.t) for r in rows]
    return Model(model.subjects, model.terms, max(scored)[1] if scored and max(scored)[0] > 0 else 1.0)


def train(texts: DataFrame, labels: DataFrame, subjects: DataFrame, size: int = SAMPLE) -> Model:
    """A model from all texts: a first one from a sample of the labels and stems, a second from what the first assigns."""
    names = sorted({r[0].strip().lower() for r in subjects.where("subject IS NOT NULL").select("subject").distinct().collect()})  # a small table
    if not names:
        return Model([], {})
    corpus = marked(texts, labels, names, size)
    sample = written(corpus.where("labels IS NOT NULL"), "subject-sample")  # at most size documents
    parts = parts_of(corpus)
    first = term_blocks(corpus, names, parts)
    return calibrated(fitted(first.unionByName(term_blocks(corpus, names, parts, fitted(first, names))), names), sample)


def subject_shares(texts: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, subject, sentences, share, weight): the part of a document's sentences that deal with each subject.

    Only subjects of at least one sentence come out. Null and empty texts, and texts without a sentence of three words,
    give no rows. Null ids stay null; repeated rows give repeated rows; other columns are ignored.
    """
    sent = texts.sparkSession.sparkContext.broadcast(model)  # terms and weights
    schema = T.StructType([T.StructField(id_col, texts.schema[id_col].dataType), *[T.StructField(n, t) for n, t in (("subject", T.StringType()), ("sentences", T.IntegerType()), ("share", T.DoubleType()), ("weight", T.DoubleType()))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names = np.array(m.subjects, object)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at in pieces(texts):
                words = Words([body_of(t) for t in texts[at]])
                n, weight = m.tally(words)
                i, k = np.nonzero(n)
                if len(i):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i + at.start)), pa.array(names[k], pa.string()), pa.array(n[i, k], pa.int32()), pa.array(n[i, k] / words.n[i]), pa.array(weight[i, k])], schema.names)

    return spread(texts.select(id_col, text_col).where(F.length(text_col) > 0)).mapInArrow(run, schema)


def found(texts: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """p8_found: (doc_id, subject)."""
    shares = subject_shares(texts, train(texts, labels, subjects)).where((F.col("share") >= SHARE - 1e-9) & F.col("doc_id").isNotNull())
    names = F.broadcast(subjects.where("subject IS NOT NULL").groupBy(F.lower(F.trim("subject")).alias("name")).agg(F.min("subject").alias("spelled")))
    return shares.join(names, F.col("subject") == F.col("name")).select("doc_id", F.col("spelled").alias("subject")).distinct()
