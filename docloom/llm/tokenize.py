"""Problem 6: texts as ids of a public byte-level BPE vocabulary.

Backtracking encoder: the longest vocabulary matches at each place come from an Aho-Corasick automaton; a match is taken
only if it is compatible with the token before it, that is, if the two would stay apart under the merges. Where none fits,
the encoder steps back. Every place is left at most once, so the work is linear in the length of the text. Compatibility of
a pair follows from the merges of both tokens and is kept in a table. Decoding joins slices of one byte string by an offset
table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.storage import spread

#: Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of pieces that a worker keeps with their ids; the table is emptied when it holds more.
CACHE = 4_000_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files of this kind."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens and merges of a vocabulary file (``tokenizers`` JSON, BPE), read once on the driver and sent to the tasks.

    Only byte-level vocabularies without other steps are encoded here. One that normalizes texts, splits them by another
    pattern or marks the ends of words would give other ids, so it is refused with a ValueError.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, splits = whole["model"], whole.get("pre_tokenizer") or {}
        wrong = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        wrong += ["model"] * (model.get("type") != "BPE") + ["normalizer"] * bool(whole.get("normalizer"))
        wrong += ["pre_tokenizer"] * (splits.get("type") != "ByteLevel" or bool(splits.get("add_prefix_space")) or not splits.get("use_regex", True))
        wrong += ["added_tokens"] * any(not t.get("special") for t in whole.get("added_tokens") or [])
        if wrong:
            raise ValueError(f"{path} can't be encoded exactly: {', '.join(wrong)}")
        letter = byte_alphabet()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # a token that is no merge and no byte (a special token) is not part of ordinary text
        names = set(letter) | {a + b for a, b in merges}
        self.tokens: dict[int, bytes] = {i: bytes(letter[c] for c in t) for t, i in model["vocab"].items() if t in names}
        self.merges = [(model["vocab"][a], model["vocab"][b], model["vocab"][a + b]) for a, b in merges]


class Encoder:
    """Encodes and decodes by the vocabulary; one for each Python worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.token = vocabulary.tokens
        self.id_of = {t: i for i, t in self.token.items()}
        self.merged = {(a, b): (rank, c) for rank, (a, b, c) in enumerate(vocabulary.merges)}
        self.parts = {c: (rank, a, b) for rank, (a, b, c) in enumerate(vocabulary.merges)}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.find = ahocorasick.Automaton()
        for i, t in self.token.items():
            self.find.add_word(t.decode("latin-1"), i)
        self.find.make_automaton()
        self.shorter: dict[int, int | None] = {}
        self.split = regex.compile(PATTERN)
        self.known: dict[str, list[int]] = {}
        self.held = 0
        size = max(self.token) + 1
        self.offsets = np.zeros(size + 1, dtype=np.int64)
        for i, t in self.token.items():
            self.offsets[i + 1] = len(t)
        self.offsets = np.cumsum(self.offsets)
        self.blob = b"".join(self.token.get(i, b"") for i in range(size))

    def _next_shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix of ``token``."""
        if token not in self.shorter:
            t = self.token[token]
            self.shorter[token] = next((self.id_of[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.id_of), None)
        return self.shorter[token]

    def _stay_apart(self, left: int, right: int) -> bool:
        """Whether the tokens side by side are what the merges make of their joined bytes.

        The merges of both tokens are undone from the last to the first. At each step the two pieces that meet at the seam
        must have no merge that would have come before the step that is undone.
        """
        key = (left, right)
        known = self.compatible.get(key)
        if known is not None:
            return known
        before = len(self.merged)  # merges from this rank on come too late to matter
        answer = True
        at_tie_left = True
        while True:
            hit = self.merged.get((left, right))
            # a merge of the same rank is applied from left to right: it matters unless the right piece's own merge came first
            if hit is not None and (hit[0] < before or (hit[0] == before and at_tie_left)):
                answer = False
                break
            l, r = self.parts.get(left), self.parts.get(right)
            if l is None and r is None:
                break
            if r is None or (l is not None and l[0] > r[0]):
                before, left, at_tie_left = l[0], l[2], False
            else:
                before, right, at_tie_left = r[0], r[1], True
        self.compatible[key] = answer
        return answer

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        whole = self.id_of.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest: list[int | None] = [None] * (n + 1)
        size = [0] * (n + 1)
        token = self.token
        for end, i in self.find.iter(piece.decode("latin-1")):
            length = len(token[i])
            start = end + 1 - length
            if length > size[start]:
                size[start], longest[start] = length, i
        open_ = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, candidate = 0, longest[0]
        while at < n:
            previous = out[-1] if out else None
            while candidate is not None:
                end = at + len(token[candidate])
                if open_[end] and (previous is None or self._stay_apart(previous, candidate)):
                    break
                candidate = self._next_shorter(candidate)
            if candidate is not None:
                out.append(candidate)
                at = end
                candidate = longest[at]
            else:
                open_[at] = 0
                last = out.pop()
                at -= len(token[last])
                candidate = self._next_shorter(last) if not open_[at + len(token[last])] else last
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; an empty list for an empty or null text."""
        if not text:
            return []
        known, pieces = self.known, self.split.findall(text)
        for piece in set(pieces).difference(known):
            self.held += len(piece)
            known[piece] = self.encode_piece(piece.encode("utf-8"))
        out = list(chain.from_iterable(map(known.__getitem__, pieces)))
        if self.held > CACHE:
            known.clear()
            self.held = 0
        return out

    def decode(self, ids: list[int] | None) -> str:
        """The text of ids; ids outside the vocabulary stand for no bytes, null for an empty text."""
        if ids is None or len(ids) == 0:
            return ""
        o, top = self.offsets, len(self.offsets) - 1
        return b"".join(self.blob[o[i] : o[i + 1]] for i in ids if 0 <= i < top).decode("utf-8", errors="replace")


_ENCODERS: dict[int, Encoder] = {}


def _encoder(sent) -> Encoder:
    """The worker's encoder of a broadcast vocabulary; a Python worker is used again by later tasks."""
    if sent.value.key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[sent.value.key] = Encoder(sent.value)
    return _ENCODERS[sent.value.key]


def _send(df: DataFrame, path: str):
    vocabulary = Vocabulary(path)
    vocabulary.key = path
    return df.sparkSession.sparkContext.broadcast(vocabulary)  # the size of the vocabulary file, whatever the corpus


def encoded(texts: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids) of each different row; ``ids`` is an empty list for an empty or null text.

    Rows whose id is null keep it. The order within a text is that of the text; a text of any length is encoded whole.
    """
    sent = _send(texts, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(sent).encode
        for batch in batches:
            ids, ends, flat = batch.column(0), [0], []
            for text in batch.column(1).to_pylist():
                flat += encode(text)
                ends.append(len(flat))
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, dtype=np.int32)))], [id_col, "ids"])

    schema = T.StructType([T.StructField(id_col, texts.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return spread(texts.select(id_col, text_col)).mapInArrow(run, schema)


def decoded(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text) of lists of ids; null gives an empty text."""
    sent = _send(tokens, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _encoder(sent).decode
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(x) for x in batch.column(1).to_pylist()], pa.string())], [id_col, "text"])

    schema = T.StructType([T.StructField(id_col, tokens.schema[id_col].dataType), T.StructField("text", T.StringType())])
    return tokens.select(id_col, F.col(ids_col)).mapInArrow(run, schema)
