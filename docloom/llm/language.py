"""Problem 4: the language of documents, chunks and the passages in them.

Prediction by partial matching: for each language a tree of byte contexts of variable order (up to ``ORDER`` bytes before a
byte) with its counts. The code length of a byte is that of its longest known context; where the context has not seen it,
the cost of an escape (method C) is added and the next shorter context decides, down to a flat choice of 256. Statistics
are frozen, so the code length of a word from its leading to its closing space is exact and the same wherever it stands.
A text belongs to the language that codes it shortest. The words of many texts are read, looked up and added up at once,
as arrays (``word_arrays``): each of them once, and each of their different contexts once.

Trees are trained on a bounded sample of the chunks whose metadata name a language (``SAMPLE`` a language). As labels are
wrong in part and chunks mix languages, a first model, of whole chunks, relabels the sentences of the sample and the final
model is trained on those.

A text in a language that no tree was trained on is coded badly by all of them. What is usual is measured on the corpus
itself: the median bits a byte of each language's passages. A passage that needs ``REJECT`` times as many is of no known
language (``UNKNOWN``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.word_arrays import Words, pieces, starts_of
from docloom.storage import spread, written

#: Bytes of context; a context and its byte are packed into 40 bits.
ORDER = 4
#: Labelled chunks a language in the training sample.
SAMPLE = 1500
#: Bits that a change of language between two sentences costs.
SWITCH = 14.0
#: Words a passage has at least.
PASSAGE = 8
#: Labelled chunks that a language needs to have trees of its own; texts of rarer ones are left to ``REJECT``.
LEAST = 20
#: Times the usual bits a byte of its best language from which a passage of ``PASSAGE`` words is in no known language, and
#: up to which it is as usual as any. Plain prose on other subjects than the corpus deals with needs three to four times as many.
REJECT = 4.5
USUAL = 2.5
UNKNOWN = "und"
#: Names of languages that metadata use, beside codes of two letters.
NAMES = {
    "en": "eng english", "de": "deu ger german", "fr": "fra fre french", "es": "spa spanish", "it": "ita italian", "ru": "rus russian",
    "pt": "por portuguese", "nl": "nld dut dutch", "pl": "pol polish", "sv": "swe swedish", "da": "dan danish", "fi": "fin finnish",
    "cs": "ces cze czech", "tr": "tur turkish", "uk": "ukr ukrainian", "el": "ell gre greek", "ro": "ron rum romanian", "hu": "hun hungarian",
    "ja": "jpn japanese", "zh": "zho chi chinese", "ko": "kor korean", "ar": "ara arabic", "he": "heb hebrew", "hi": "hin hindi",
}
_DIGIT = re.compile(r"\d")
#: Signs that may come between the end of a sentence and white space.
_CLOSING = "\"'»)”"
#: The bits of a gram's bytes; those above hold their number.
_BITS = 8 * (ORDER + 1)


def label_code(label: Column) -> Column:
    """The code of two letters that a label names, in any case, with or without a region; else null."""
    bare = F.regexp_extract(F.lower(F.trim(label)), r"^([a-z]+)(?:[-_][a-z0-9]+)*$", 1)
    names = F.create_map(*[F.lit(x) for code, all_ in NAMES.items() for name in all_.split() for x in (name, code)])
    return F.when(F.length(bare) == 2, bare).otherwise(F.try_element_at(names, bare))


def words_of(texts: list[str | None]) -> Words:
    """The words of all sentences of some texts."""
    return Words([(t or "").lower() for t in texts], 1, _CLOSING)


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The longest gram that ends at each byte of some words and of their closing spaces, and where each word's begin."""
    coded = np.frombuffer(f" {' '.join(words)} ".encode(), np.uint8)
    spaces = np.flatnonzero(coded == 32)
    first = spaces[:-1]
    size = np.minimum(np.arange(1, len(coded)) - np.repeat(first, np.diff(spaces)), ORDER) + 1
    gram = size << _BITS
    for k in range(ORDER + 1):
        at = np.flatnonzero(size > k)
        gram[at] |= coded[at + 1 - k].astype(np.int64) << 8 * k
    return gram, first


def last_bytes(gram: np.ndarray, k: int) -> np.ndarray:
    """The last ``k`` bytes of grams."""
    return gram & ((1 << 8 * k) - 1) | k << _BITS


def plain(words: list[str]) -> np.ndarray:
    """Which words have no digits; the others belong to no language."""
    return np.array([w.isalpha() or not _DIGIT.search(w) for w in words], bool)


class Trees:
    """The frozen context trees of all languages, as matrices with a row for each context and each context with its byte.

    A gram, a context with its byte or a context alone, is a whole number: its bytes, and their number above ``_BITS``.
    """

    def __init__(self, languages: np.ndarray, grams: np.ndarray, counts: np.ndarray):
        """Occurrences of each language's context + byte, in columns."""
        names, place = np.unique(np.asarray(languages, object), return_inverse=True)
        self.languages = names.tolist()
        self.grams, at = np.unique(np.asarray(grams, np.int64), return_inverse=True)
        size = self.grams >> _BITS
        self.contexts, parent = np.unique((self.grams & ((1 << _BITS) - 1)) >> 8 | (size - 1) << _BITS, return_inverse=True)
        n = np.zeros((len(self.grams), len(self.languages)), dtype=np.float32)
        n[at, place] = counts
        total, kinds = (np.zeros((len(self.contexts), n.shape[1]), dtype=np.float32) for _ in range(2))
        np.add.at(total, parent, n)
        np.add.at(kinds, parent, n > 0)
        # bits of an escape; a context that a language lacks costs nothing
        self.escape = np.where(kinds > 0, np.log2(np.maximum(total + kinds, 1)) - np.log2(np.maximum(kinds, 1)), 0.0)
        # bits of a byte that its context has seen, infinite elsewhere
        self.code = np.where(n > 0, np.log2(np.maximum(total + kinds, 1))[parent] - np.log2(np.maximum(n, 1)), np.inf)

    def byte_bits(self, gram: np.ndarray) -> np.ndarray:
        """Code length in each language of the last byte of grams after the bytes before it, from the shortest context on."""
        bits = np.full((len(gram), len(self.languages)), 8.0)
        for k in range(1, ORDER + 2):
            at = np.flatnonzero(gram >> _BITS >= k)
            own = last_bytes(gram[at], k)
            row, known = _rows(self.contexts, (own & ((1 << _BITS) - 1)) >> 8 | (k - 1) << _BITS)
            at, own = at[known], own[known]
            bits[at] += self.escape[row]
            row, known = _rows(self.grams, own)
            code = self.code[row]
            bits[at[known]] = np.where(np.isinf(code), bits[at[known]], code)
        return bits

    def word_bits(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code length of words in each language, and the bytes coded; none for words with digits, which belong to no language."""
        bits, size = np.zeros((len(words), len(self.languages))), np.zeros(len(words), np.int64)
        some = np.flatnonzero(plain(words))
        if len(some):
            gram, first = grams_of([words[i] for i in some.tolist()])
            gram, at = np.unique(gram, return_inverse=True)
            bits[some] = np.add.reduceat(self.byte_bits(gram)[at], first, axis=0)
            size[some] = np.diff(first, append=len(at))
        return bits, size

    def bits(self, word: str, known: dict[str, np.ndarray] | None = None) -> np.ndarray:
        """Code length of a word in each language; words are looked up in ``known``."""
        known = {} if known is None else known
        if word not in known:
            known[word] = self.word_bits([word])[0][0]
        return known[word]


def _rows(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in sorted ``keys`` of those wanted that are among them, and which these are."""
    row = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    known = np.flatnonzero(keys[row] == wanted)
    return row[known], known


class Scorer:
    """Code lengths of the sentences of many texts."""

    def __init__(self, trees: Trees):
        self.trees = trees

    def of(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Bits in each language and bytes coded of each sentence."""
        bits, size = self.trees.word_bits(words.unique)
        first = starts_of(words.sentence)
        return np.add.reduceat(bits[words.word], first, axis=0), np.add.reduceat(size[words.word], first)

    def sentences(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of the text, words, bits in each language and bytes coded of each sentence with words."""
        words = words_of(texts)
        return words.text, words.size, *self.of(words)


def best_paths(text: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The language of each sentence of some texts: least bits in all of a text, with ``SWITCH`` for each change in it."""
    path = bits.argmin(axis=1)
    if not len(path):
        return path
    begin = starts_of(text)
    size = np.diff(begin, append=len(text))
    # texts whose sentences differ, the longest first, so that those with another sentence are the first at each step
    mixed = np.flatnonzero(np.minimum.reduceat(path, begin) != np.maximum.reduceat(path, begin))
    mixed = mixed[np.argsort(-size[mixed], kind="stable")]
    begin, size = begin[mixed], size[mixed]
    left = np.searchsorted(-size, -np.arange(1, size.max(initial=0)))  # texts of more sentences than 1, 2 ...
    all_, cost, back = np.arange(bits.shape[1]), bits[begin], []
    for step, n in enumerate(left.tolist(), 1):
        best = cost[:n].argmin(axis=1)[:, None]
        move = np.take_along_axis(cost[:n], best, 1) + SWITCH
        back.append(np.where(cost[:n] <= move, all_, best).astype(np.int16))
        cost[:n] = np.minimum(cost[:n], move) + bits[begin[:n] + step]
    state = cost.argmin(axis=1)
    for step in range(len(back), 0, -1):
        n = left[step - 1]
        path[begin[:n] + step] = state[:n]
        state[:n] = back[step - 1][np.arange(n), state[:n]]
    path[begin] = state
    return path


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, sorted, and the sum of ``n`` of each."""
    order = np.argsort(key)
    key = key[order]
    at = starts_of(key)
    return key[at], np.add.reduceat(n[order], at)


def gram_counts(words: Words, language: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences of each language's context + byte in sentences: the gram with the language above it; -1 is no language."""
    of, n = language[words.sentence].astype(np.int64), len(words.unique)
    counted = np.flatnonzero((of >= 0) & plain(words.unique)[words.word])
    if not len(counted):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, times = summed(of[counted] * n + words.word[counted], np.ones(len(counted), np.int64))
    gram, first = grams_of([words.unique[i] for i in (key % n).tolist()])
    size = np.diff(first, append=len(gram))
    of, times = np.repeat(key // n, size), np.repeat(times, size)
    at = [np.flatnonzero(gram >> _BITS >= k) for k in range(1, ORDER + 2)]
    return summed(np.concatenate([of[x] << _BITS + 3 | last_bytes(gram[x], k) for k, x in enumerate(at, 1)]), np.concatenate([times[x] for x in at]))


def counted(texts: DataFrame, relabel=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context counts, in columns, of a bounded sample (language, text); with ``relabel`` (sent trees), of its sentences by best language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {} if relabel is None else {x: i for i, x in enumerate(relabel.value.languages)}
        found = []
        for batch in batches:
            labels, bodies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in pieces(bodies):
                words = words_of(bodies[at])
                if relabel is None:
                    language = np.array([names.setdefault(x, len(names)) for x in labels[at]], np.int64)[words.text]
                else:
                    language = np.where(words.size >= 4, best_paths(words.text, Scorer(relabel.value).of(words)[0]), -1)
                found.append(gram_counts(words, language))
        key, n = summed(*(np.concatenate(c) for c in zip(*found))) if found else ((), ())
        if len(key):
            language = pa.array(list(names), pa.string()).take(pa.array(key >> _BITS + 3))
            yield pa.RecordBatch.from_arrays([language, pa.array(key & ((1 << _BITS + 3) - 1)), pa.array(n)], ["language", "gram", "n"])

    rows = texts.mapInArrow(run, "language string, gram bigint, n bigint").groupBy("language", "gram").agg(F.sum("n").alias("n")).where("n > 1")
    table = rows.toArrow()  # grams of a bounded sample; those that occur once are left out
    return tuple(c.to_numpy() for c in table.columns)


def train(chunks: DataFrame, sample: int = SAMPLE, least: int = LEAST) -> Trees:
    """Trees from at most ``sample`` labelled chunks of 100 characters a language (by a hash of their id), ``least`` at least."""
    labelled = chunks.select(F.col("vector_id"), label_code(F.col("chunk_metadata")["language"]).alias("language"), F.col("content").alias("text"))
    labelled = labelled.where("language IS NOT NULL AND length(text) >= 100").select("language", "text", F.xxhash64("vector_id").alias("h"))
    # a share of each language's chunks that holds the sample twice over is cut out where they are read
    sizes = labelled.groupBy("language").agg(F.count("*").alias("size"))  # a row a language
    labelled = labelled.join(F.broadcast(sizes), "language").where(F.pmod("h", F.lit(1_000_003)) < F.lit(2.0 * sample * 1_000_003) / F.col("size"))
    ranked = labelled.withColumn("rank", F.row_number().over(Window.partitionBy("language").orderBy("h"))).where(F.col("rank") <= sample)
    kept = written(ranked.select("language", "text"), "language-sample")
    enough = [r.language for r in kept.groupBy("language").count().where(F.col("count") >= least).collect()]
    kept = spread(kept.where(F.col("language").isin(enough)) if enough else kept)
    trees = Trees(*counted(kept))
    return Trees(*counted(kept, kept.sparkSession.sparkContext.broadcast(trees))) if trees.languages else trees


SEGMENT = "vector_id string, document_id string, segment int, language string, confidence double, words int, sentences int, bits double"


def passages(scorer: Scorer, texts: list[str | None]) -> tuple:
    """The number of the text, an array, and the columns of ``SEGMENT`` after the ids, of each passage of one language."""
    text, words, bits, size = scorer.sentences(texts)
    # texts without words of letters have no bits in any language
    some = np.isin(text, text[bits.any(axis=1)])
    text, words, bits, size = text[some], words[some], bits[some], size[some]
    path = best_paths(text, bits)
    at = starts_of(text, path)
    bits, words, size = (np.add.reduceat(x, at, axis=0) for x in (bits, words, size))
    text, path, sentences = text[at], path[at], np.diff(at, append=len(text))
    first = starts_of(text)
    number = np.arange(len(text)) - np.repeat(first, np.diff(first, append=len(text)))
    own = np.take_along_axis(bits, path[:, None], 1)
    confidence = 1 / np.exp2(np.minimum(own - bits, 60)).sum(axis=1)
    language = pa.array(scorer.trees.languages, pa.string()).take(pa.array(path))
    return text, pa.array(number, pa.int32()), language, pa.array(confidence), pa.array(words, pa.int32()), pa.array(sentences, pa.int32()), pa.array(own[:, 0] / np.maximum(size, 1))


def segments(chunks: DataFrame, trees: Trees | None = None) -> DataFrame:
    """Passages of one language in each chunk: (vector_id, document_id, segment, language, confidence, words, sentences).

    ``segment`` counts from 0. A passage that needs ``REJECT`` times the usual bits a byte is ``und``. ``confidence`` is the
    share of the best language among all, given equal odds before, times how usual the passage is: 1 up to ``USUAL`` times
    the median bits a byte of the language's passages in the corpus, falling to 0 at ``REJECT``. A chunk
    without words of letters (null, blank, signs or numbers only) has none. Rows sent twice count once. Null ids stay null; other columns are
    ignored; an empty table gives an empty result, and so does one without any labelled chunk to train on.
    """
    trees = trees or train(chunks)
    if not trees.languages:
        return chunks.sparkSession.createDataFrame([], SEGMENT).drop("bits")
    sent = chunks.sparkSession.sparkContext.broadcast(trees)  # bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for at in pieces(texts):
                text, *columns = passages(scorer, texts[at])
                ids = [batch.column(i).slice(at.start, at.stop - at.start).take(pa.array(text)) for i in range(2)]
                yield pa.RecordBatch.from_arrays([*ids, *columns], [c.split()[0] for c in SEGMENT.split(", ")])

    return usual(written(spread(chunks.select("vector_id", "document_id", "content")).mapInArrow(run, SEGMENT).distinct(), "language-segments"))


def usual(found: DataFrame) -> DataFrame:
    """``found`` segments without ``bits``: those far from what is usual in their language become ``und``."""
    median = found.where(F.col("words") >= PASSAGE).groupBy("language").agg(F.percentile_approx("bits", 0.5).alias("median"))  # a row a language
    times = F.coalesce(F.col("bits") / F.col("median"), F.lit(1.0))
    fit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (REJECT - times) / (REJECT - USUAL)))
    out = found.join(F.broadcast(median), "language", "left")
    return out.withColumn("language", F.when((times >= REJECT) & (F.col("words") >= PASSAGE), UNKNOWN).otherwise(F.col("language"))).withColumn("confidence", F.col("confidence") * fit).select(*[c.split()[0] for c in SEGMENT.split(", ")[:-1]])


def chunk_languages(found: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """(vector_id, language, words, confidence) of the languages in which a chunk holds a passage of ``passage`` words."""
    return found.where(F.col("words") >= passage).groupBy("vector_id", "language").agg(F.sum("words").alias("words"), F.max("confidence").alias("confidence"))


def document_languages(found: DataFrame) -> DataFrame:
    """(document_id, language, share, confidence): the language of most words of a document's chunks; ties: the first by name."""
    per = found.where("document_id IS NOT NULL").groupBy("document_id", "language").agg(F.sum("words").alias("words"), F.max("confidence").alias("confidence"))
    best = per.groupBy("document_id").agg(F.sum("words").alias("all"), F.min(F.struct((-F.col("words")).alias("w"), "language", "confidence")).alias("b"))
    return best.select("document_id", F.col("b.language").alias("language"), (-F.col("b.w") / F.col("all")).alias("share"), F.col("b.confidence").alias("confidence"))


def found(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """p4_found: (record, record_id, language) wherever the metadata don't name what the text says."""
    all_ = segments(chunks).where(F.col("language") != UNKNOWN)
    label = chunks.select(F.col("vector_id"), label_code(F.col("chunk_metadata")["language"]).alias("label")).where("vector_id IS NOT NULL").groupBy("vector_id").agg(F.max("label").alias("label"))
    spoken = chunk_languages(all_).groupBy("vector_id").agg(F.collect_set("language").alias("languages"))  # at most one a language
    of_chunks = spoken.join(label, "vector_id", "left").where((F.size("languages") > 1) | F.col("label").isNull() | ~F.array_contains("languages", F.coalesce("label", F.lit(""))))
    of_chunks = of_chunks.select(F.lit("chunk").alias("record"), F.col("vector_id").alias("record_id"), F.explode("languages").alias("language"))
    named = documents.where("document_id IS NOT NULL").select("document_id", label_code(F.get_json_object("doc_metadata", "$.language")).alias("label")).groupBy("document_id").agg(F.max("label").alias("label"))
    of_documents = document_languages(all_).join(named, "document_id").where(~F.col("language").eqNullSafe(F.col("label")))
    return of_chunks.unionByName(of_documents.select(F.lit("document").alias("record"), F.col("document_id").alias("record_id"), "language"))
