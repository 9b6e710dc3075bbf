"""Words and sentences of many texts at once, as arrays: those that ``subjects.sentences_of`` gives text by text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain
from zlib import crc32

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters read at once; a longer text is read alone.
CHARACTERS = 3_000_000
#: Signs that may come between the end of a sentence and white space.
CLOSING = "\"'»)”]"
_BREAK = 10
_WORD, _SPACE, _END, _CLOSING = 1, 2, 4, 8


@cache
def _kinds(closing: str) -> np.ndarray:
    """What each character is: part of a word, white space, the end of a sentence, or a sign that may come between both."""
    chars = [chr(i) for i in range(0x110000)]
    out = np.fromiter(map(str.isalnum, chars), np.uint8, len(chars)) * _WORD + np.fromiter(map(str.isspace, chars), np.uint8, len(chars)) * _SPACE
    out[[ord(c) for c in ".!?…;"]] |= _END
    out[[ord(c) for c in closing]] |= _CLOSING
    return out


def starts_of(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where the rows of sorted columns differ from the row before."""
    new = np.ones(len(sorted_columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_columns])
    return np.flatnonzero(new)


def pieces(texts: list, characters: int = CHARACTERS) -> Iterator[slice]:
    """Slices of ``texts`` of about so many characters."""
    begin = n = 0
    for i, text in enumerate(texts):
        if n and n + len(text or "") > characters:
            yield slice(begin, i)
            begin, n = i, 0
        n += len(text or "") + 1
    if len(texts) > begin:
        yield slice(begin, len(texts))


class Words:
    """The words of the sentences of ``least`` words or more of some texts, given in lower case.

    ``word`` (place in ``unique``) and ``sentence`` of each word in order, ``size`` and ``text`` of each sentence, and the
    number ``n`` of sentences of each text. A sentence ends at a line break, and at a sign that ends one if white space
    follows it or the ``closing`` signs after it.
    """

    def __init__(self, texts: list[str], least: int = 3, closing: str = CLOSING):
        whole = "\n".join(texts)
        chars = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        kinds = _kinds(closing)[chars]
        inside = np.zeros(len(chars) + 2, bool)
        inside[1:-1] = kinds == _WORD
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        begin, end = edges[::2], edges[1::2]
        # the places where a sentence ends, then how many words come before each
        signs = np.flatnonzero((kinds == _END)[:-1])
        after = signs + 1
        closing = np.flatnonzero(kinds[after] == _CLOSING)
        while len(closing):
            after[closing] += 1
            closing = closing[after[closing] < len(chars)]
            closing = closing[kinds[after[closing]] == _CLOSING]
        inner = after < len(chars)
        ends = np.zeros(len(chars), bool)
        ends[signs[inner][kinds[after[inner]] == _SPACE]] = True
        ends[chars == _BREAK] = True
        before = np.searchsorted(begin, np.flatnonzero(ends))
        bounds = np.concatenate([[0], before, [len(begin)]])
        bounds = bounds[starts_of(bounds)]  # none is empty
        lengths = np.diff(bounds)
        long = lengths >= least
        self.size = lengths[long]
        starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
        self.text = np.searchsorted(starts, begin[bounds[:-1][long]], "right") - 1
        self.n = np.bincount(self.text, minlength=len(texts))
        self.sentence = np.repeat(np.arange(len(self.size)), self.size)
        # the characters of all words one after the other, as an Arrow array; its dictionary has them as they first come
        at = np.concatenate([[0], np.cumsum(end - begin)]) * 4
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(at), pa.py_buffer(chars[inside[1:-1]])]).dictionary_encode()
        place = coded.indices.to_numpy()
        first = starts_of(np.maximum.accumulate(place)) if len(place) else place
        self.unique = [whole[a:b] for a, b in zip(begin[first].tolist(), end[first].tolist())]
        self.word = place[np.repeat(long, lengths)]

    def of_texts(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words of the ``chosen`` texts, their texts, and whether the next word is of the same sentence."""
        text = self.text[self.sentence]
        at = np.flatnonzero(chosen[text])
        sentence = self.sentence[at]
        follows = np.zeros(len(at), bool)
        follows[:-1] = sentence[1:] == sentence[:-1]
        return self.word[at], text[at], follows


def found_in(find: ahocorasick.Automaton, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Ends and values of all that an automaton with whole numbers as values finds, in order, the longest first."""
    hits = list(find.iter(text))
    hits = np.fromiter(chain.from_iterable(hits), np.int64, 2 * len(hits)).reshape(-1, 2)
    return hits[:, 0], hits[:, 1]


class Matcher:
    """An Aho-Corasick automaton of terms of one or several words that passes over texts of coded words.

    Each word of the terms is coded by three characters, each place of which has an alphabet of its own, so a match can't
    begin within a word; any other word, and the end of a sentence, is a line break, which is in no term.
    """

    def __init__(self, terms: list[str]):
        split = [t.split(" ") for t in terms]
        self.place = {w: i for i, w in enumerate(dict.fromkeys(w for ws in split for w in ws), 1)}
        n = len(self.place)
        base = max(2, int(np.ceil(n ** (1 / 3) - 1e-9)) + 1)
        i = np.arange(n)
        # the last row is for words of no term
        self.codes = np.zeros((n + 1, 3), np.uint32)
        self.codes[1:] = np.stack([i // (base * base), i // base % base, i % base], 1) + 0x100 + base * np.arange(3)
        self.codes[0, 0] = _BREAK
        self.find = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, ws in enumerate(split):
            self.find.add_word(self._string(self.codes[[self.place[w] for w in ws]].ravel()), k)
        self.find.make_automaton()

    @staticmethod
    def _string(chars: np.ndarray) -> str:
        return chars.astype("<u4").tobytes().decode("utf-32-le")

    def matches(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The sentence and the term of each match, in the order of the text."""
        if not len(self.find) or not len(words.word):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.array([self.place.get(w, 0) for w in words.unique], np.int64)
        coded = np.zeros((len(words.word), 4), np.uint32)
        first = starts_of(words.sentence)
        coded[first, 0] = _BREAK
        coded[:, 1:] = self.codes[place[words.word]]
        coded = coded.ravel()
        end, term = found_in(self.find, self._string(coded[coded != 0]))
        size = np.where(place > 0, 3, 1)[words.word]
        size[first] += 1
        return np.repeat(words.sentence, size)[end], term


class TermCounts:
    """In how many texts of each group the words of four letters or more and the pairs of words stand (without digits).

    A term is a whole number while it is counted: the place of a word in the task's vocabulary, shifted by 32 bits, and that
    of the second word, or 0. The empty term, 0, stands in every text.
    """

    def __init__(self):
        self.groups: dict[tuple, int] = {}
        self.places: dict[str, int] = {"": 0}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows = 0

    def add(self, words: Words, groups: list[tuple | None]) -> None:
        """Count texts for their groups; those without one are left out."""
        group = np.array([-1 if g is None else self.groups.setdefault(g, len(self.groups)) for g in groups], np.int64)
        word, text, follows = words.of_texts(group >= 0)
        plain = np.array([w.isalpha() for w in words.unique], bool)
        single = plain & np.array([len(w) >= 4 for w in words.unique], bool)
        width = len(words.unique).bit_length()  # of a word's place here, counted from 1
        low = len(groups).bit_length()
        first = np.flatnonzero(follows & plain[word])
        first = first[plain[word[first + 1]]]
        alone = np.flatnonzero(single[word])
        word = word.astype(np.int64) + 1
        in_text = np.concatenate([word[alone] << (width + low) | text[alone], (word[first] << width | word[first + 1]) << low | text[first]])
        in_text.sort()
        in_text = in_text[starts_of(in_text)]
        term, n = counted(in_text >> low, group[in_text & ((1 << low) - 1)])
        empty = counted(np.zeros((group >= 0).sum(), np.int64), group[group >= 0])
        place = np.zeros(len(words.unique) + 1, np.int64)
        used = np.zeros(len(place), bool)
        a, b = term[0] >> width, term[0] & ((1 << width) - 1)
        used[a] = used[b] = True
        at = np.flatnonzero(used[1:])
        place[at + 1] = [self.places.setdefault(words.unique[i], len(self.places)) for i in at.tolist()]
        self._keep((place[a] << 32 | place[b], term[1]), n)
        self._keep(*empty)

    def _keep(self, keys: tuple[np.ndarray, np.ndarray], n: np.ndarray) -> None:
        self.parts.append((*keys, n))
        self.rows += len(n)

    def merge(self) -> int:
        """Add up what was counted so far; the number of rows."""
        if len(self.parts) > 1:
            term, group, n = (np.concatenate(c) for c in zip(*self.parts))
            self.parts, self.rows = [], 0
            self._keep(*counted(term, group, n))
        return self.rows

    def batches(self, columns: dict[str, Callable[[tuple], int]], language: Callable[[tuple], str]) -> Iterator[pa.RecordBatch]:
        """(language, term, columns) of all that was counted, a column summing what it gives a text of each group."""
        return (batch for _, batch in self.parted(columns, language, 1))

    def parted(self, columns: dict[str, Callable[[tuple], int]], language: Callable[[tuple], str], parts: int) -> Iterator[tuple[int, pa.RecordBatch]]:
        """The rows of ``batches`` by part: that of a term follows from a hash of its words, and that of the empty term is -1."""
        if not self.merge():
            return
        term, group, n = self.parts[0]
        names, of = np.unique([language(g) for g in self.groups], return_inverse=True)
        order = np.lexsort((of[group], term))
        term, group, n = term[order], group[order], n[order]
        at = starts_of(term, of[group])
        sums = [np.add.reduceat(n * np.array([f(x) for x in self.groups], np.int64)[group], at) for f in columns.values()]
        term, spoken = term[at], of[group[at]]
        first, second = term >> 32, term & 0xFFFFFFFF
        hashes = np.array([crc32(w.encode()) for w in self.places], np.int64)
        part = np.where(term == 0, -1, (hashes[first] * 31 + hashes[second]) % parts)
        order = np.argsort(part, kind="stable")
        words = pa.array(list(self.places), pa.large_string())
        a, b = words.take(pa.array(first[order])), words.take(pa.array(second[order]))
        both = pc.if_else(pa.array(second[order] == 0), a, pc.binary_join_element_wise(a, b, pa.scalar(" ", pa.large_string())))
        batch = pa.RecordBatch.from_arrays([pa.array(names.tolist(), pa.string()).take(pa.array(spoken[order])), both.cast(pa.string()), *[pa.array(x[order]) for x in sums]], ["language", "term", *columns])
        part = part[order]
        bounds = [*starts_of(part).tolist(), len(part)]
        yield from ((int(part[x]), batch.slice(x, y - x)) for x, y in zip(bounds, bounds[1:]))


def packed(parted: Iterator[tuple[int, pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """(part, size, block): each batch in one value, compressed; ``size`` is that without compression."""
    rows = [(part, buffer.size, pa.compress(buffer, "zstd", asbytes=True)) for part, batch in parted for buffer in [batch.serialize()]]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary()))], ["part", "size", "block"])


def unpacked(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The batches of ``packed``."""
    for batch in batches:
        for size, block in zip(batch.column("size").to_pylist(), batch.column("block")):
            yield pa.ipc.read_record_batch(pa.decompress(block.as_buffer(), size, "zstd"), schema)


def counted(term: np.ndarray, group: np.ndarray, n: np.ndarray | None = None) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Different (term, group), sorted, and how often they come, or the sum of ``n``."""
    order = np.lexsort((group, term))
    term, group = term[order], group[order]
    at = starts_of(term, group)
    ends = np.append(at[1:], len(term))
    return (term[at], group[at]), (ends - at if n is None else np.add.reduceat(n[order], at) if len(at) else n)
