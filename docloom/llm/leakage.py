"""Problem 7: evaluation passages that stand in training texts.

Pigeonhole edit matching: every passage (``words`` words in a row of a test item) is split into one piece more than the
error budget, so a text that holds the passage with at most that many word edits holds one piece unchanged. Pieces are
found by their hashes in one pass over each text; where one stands, Myers' bit-parallel distance (over words) verifies the
passage around it.

The test items travel to the tasks in blocks of a checked size; each block is matched against all texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.storage import spread, written

#: Characters of test items that one block may hold: about 3 million words, and 30 bytes of arrays for each of them.
BLOCK_CHARS = 20_000_000
_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits, case aside."""
    return _WORD.findall(text.lower()) if text else []


def myers_search(pattern: list, text: list) -> int:
    """The least number of word edits between ``pattern`` and any stretch of ``text`` (bit-parallel, one step a word)."""
    m = len(pattern)
    peq: dict = {}
    for i, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score = full, 0, m
    best = m
    for w in text:
        eq = peq.get(w, 0)
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
        hp = vn | (full & ~(d0 | vp))
        hn = d0 & vp
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp <<= 1  # a match may begin anywhere
        vp = ((hn << 1) | (full & ~(d0 | hp))) & full
        vn = hp & d0 & full
        if score < best:
            best = score
    return best


def piece_lengths(words: int, budget: int) -> list[int]:
    """Lengths of the ``budget + 1`` pieces of a passage."""
    return [words // (budget + 1) + (i < words % (budget + 1)) for i in range(budget + 1)]


class Matcher:
    """The pieces of a block of test items as sorted arrays; words are hashes. Built once, sent to the tasks, shared by a worker."""

    def __init__(self, items: list[tuple], words: int, budget: int):
        self.words, self.budget = words, budget
        self.known: dict[str, int] = {}
        self.ids = [item for item, _ in items]
        parts = [self.hashes(text) for _, text in items]
        self.flat = np.concatenate([*parts, np.zeros(0, dtype=np.uint64)])
        self.ends = np.cumsum([len(p) for p in parts])
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        starts = np.arange(max(0, len(self.flat) - words + 1))
        starts = starts[owner[starts] == owner[starts + words - 1]] if len(starts) else starts
        #: for each length of a piece: sorted hashes, where the passage of each begins in ``flat``, and its place in the passage
        self.pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        found: dict[int, list[tuple[np.ndarray, np.ndarray, int]]] = {}
        offset = 0
        for n in piece_lengths(words, budget):
            found.setdefault(n, []).append((rolling(self.flat, n)[starts + offset] if len(starts) else np.zeros(0, np.uint64), starts, offset))
            offset += n
        for n, all_ in found.items():
            key, at = np.concatenate([k for k, _, _ in all_]), np.concatenate([s for _, s, _ in all_])
            place = np.concatenate([np.full(len(k), o, dtype=np.int16) for k, _, o in all_])
            order = np.argsort(key, kind="stable")
            self.pieces[n] = key[order], at[order].astype(np.int32), place[order]
        self.known = {}

    def hashes(self, text: str | None) -> np.ndarray:
        known, out = self.known, []
        for w in words_of(text):
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            out.append(h)
        if len(known) > 500_000:
            known.clear()
        return np.array(out, dtype=np.uint64)

    def match(self, texts: list[str | None]) -> Iterator[tuple[int, object, int]]:
        """(number of the text, item, least word edits) for each text that holds a passage of an item within the budget."""
        seqs = [self.hashes(t) for t in texts]
        starts = np.concatenate([[0], np.cumsum([len(s) for s in seqs])]).astype(np.int64)
        flat = np.concatenate([*seqs, np.zeros(0, dtype=np.uint64)])
        owner = np.repeat(np.arange(len(texts)), np.diff(starts))
        best: dict[tuple, int] = {}
        seen: set[tuple] = set()
        for n, (known, where, place) in self.pieces.items():
            keys = rolling(flat, n)
            if not len(keys) or not len(known):
                continue
            low_at = np.searchsorted(known, keys)
            spot = np.minimum(low_at, len(known) - 1)
            hit = (known[spot] == keys) & (owner[: len(keys)] == owner[n - 1 : n - 1 + len(keys)])
            for p in np.flatnonzero(hit):
                d = int(owner[p])
                low, high = int(starts[d]), int(starts[d + 1])
                for e in range(int(spot[p]), int(np.searchsorted(known, keys[p], side="right"))):
                    at, begin = int(where[e]), int(p) - int(place[e])
                    item = self.ids[int(np.searchsorted(self.ends, at, side="right"))]
                    if best.get((d, item)) == 0 or (d, at, begin) in seen:
                        continue
                    seen.add((d, at, begin))
                    passage = self.flat[at : at + self.words]
                    if begin >= low and begin + self.words <= high and np.array_equal(flat[begin : begin + self.words], passage):
                        distance = 0
                    else:
                        window = flat[max(low, begin - self.budget) : min(high, begin + self.words + self.budget)]
                        distance = myers_search(passage.tolist(), window.tolist())
                    if distance <= self.budget and distance < best.get((d, item), self.budget + 1):
                        best[d, item] = distance
        for (d, item), distance in best.items():
            yield d, item, distance


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` words from each place on."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = out * _MIX + hashes[i : len(hashes) - n + 1 + i]
    return out


def blocks_of(items: DataFrame, id_col: str, text_col: str, max_chars: int = BLOCK_CHARS) -> list[DataFrame]:
    """The test items in blocks of about ``max_chars`` characters; null or blank texts are left out."""
    kept = items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).where("item IS NOT NULL AND trim(text) <> ''").distinct()
    chars = kept.agg(F.sum(F.length("text"))).first()[0] or 0
    n = int(chars // max_chars) + 1
    if n == 1:
        return [kept]
    kept = written(kept.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n))), "test-items")
    return [kept.where(F.col("block") == b).select("item", "text") for b in range(n)]


def leaks(texts: DataFrame, items: DataFrame, words: int = 13, budget: int = 1, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(id_col, item_col, edits) for each text that holds ``words`` words in a row of an item with at most ``budget`` edits.

    ``edits`` is the least found; 0 means that the words stand in a row unchanged. ``words`` is at most 63. Items with
    fewer words have no passage. Null ids, null and empty texts and empty tables give no rows; rows with the same id are
    read together; other columns are ignored. Texts are read whole.
    """
    if not 0 < words <= 63 or not 0 <= budget < words:
        raise ValueError("words must be 1..63 and budget less than words")
    schema = T.StructType([T.StructField(id_col, texts.schema[id_col].dataType), T.StructField(item_col, items.schema[item_col].dataType), T.StructField("edits", T.IntegerType())])
    item_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[items.schema[item_col].dataType.simpleString()]
    corpus = spread(texts.select(id_col, text_col).where(F.col(id_col).isNotNull() & (F.length(text_col) > 0)))
    sc = texts.sparkSession.sparkContext

    def over(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = sent.value
            for batch in batches:
                found = list(matcher.match(batch.column(1).to_pylist()))
                if found:
                    at, item, edits = zip(*found)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(item, item_type), pa.array(edits, pa.int32())], [id_col, item_col, "edits"])

        return run

    out = None
    for block in blocks_of(items, item_col, text_col):
        sent = sc.broadcast(Matcher([tuple(r) for r in block.collect()], words, budget))  # at most BLOCK_CHARS and one item's text
        part = corpus.mapInArrow(over(sent), schema)
        out = part if out is None else out.unionByName(part)
    return out.groupBy(id_col, item_col).agg(F.min("edits").alias("edits"))


def found(texts: DataFrame, items: DataFrame) -> DataFrame:
    """p7_found: (doc_id, item_id) of the matches that are exact."""
    return leaks(texts, items).where("edits = 0").select("doc_id", "item_id")
