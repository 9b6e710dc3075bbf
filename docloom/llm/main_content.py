"""Problem 3: the main body of web pages without menus, notices, sidebars and footers.

Tree scoring: a page is the tree of its document, the chunks of that, their blocks and the lines of those. A line passes
points for its length and its commas to its block and part of them to its chunk, discounted by its link density. The best
block of the document and those of its siblings that come near enough to it are kept, all others are furniture.

The texts have no anchors left, so the link density of a line is measured: it is the probability that its wording belongs to
the surroundings of a page. What stands before the title of a page (the line that repeats its heading) or after its last
paragraph, step or table row is surroundings, whatever language it is in; a logistic regression on words, pairs and shapes
learns from a bounded sample of chunks which wordings stand there, and then, relabelling its sample, that they are no main
body where they stand between paragraphs either. No phrase of any language is given.

``chunk_metadata['html_tag']`` tells which chunks are tables: a row of two cells is part of a table there, elsewhere only
beside another such row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.storage import small_side, spread, written

#: Chunks with a title line, and chunks without, in the sample that the link density is fitted on.
SAMPLE = 2000
#: Longer chunks aren't taken into the sample (they are judged like all others).
SAMPLE_CHARS = 20_000
#: A wording counts as surroundings in the next round of fitting from this probability on.
RELABEL = 0.15
ROUNDS = 2
#: Lines that a word, pair or shape stands in at least to be a feature.
FEATURE_LINES = 4
#: Weight of the lines of chunks without a title in the first fits, as a share of the weight of the others.
UNTITLED = 0.5
#: How many times the odds of a line that doesn't end as a sentence are those of one that does.
OPEN = 4.0
#: A block is kept from this part of the best block's points a line on, and from these points on.
SIBLING = 0.15
FLOOR = 0.35
#: Points that the commas of a line, and its length, give at most; the part of a chunk's points that its blocks share.
MOST = 3
SHARED = 0.05
#: A line with so many characters that ends as a sentence is a paragraph.
PARAGRAPH = 80

_WORD = re.compile(r"[^\W_]+")
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")
_NUMBERED = re.compile(r"\s*\d+\s*[.)]\s+\S")
_BULLET = re.compile(r"\s*[-–•*>▪·▲]\s*")
_ENDS = re.compile(r"[.!?…;:]['\"»)”*\s]*$")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def bare(text: str | None) -> str:
    return "".join(_WORD.findall((text or "").lower()))


def is_row(text: str) -> bool:
    """Whether a line has the form of a table row: two cells."""
    return "|" in text and len([c for c in _BULLET.sub("", text, count=1).split("|") if c.strip()]) == 2


def is_step(text: str) -> bool:
    return bool(_NUMBERED.match(text)) or bool(_BULLET.match(text)) and len(text) > 30 and bool(_ENDS.search(text))


class Page:
    """The non-blank lines of a chunk: their numbers, texts and forms, and the place of the title among them (or None)."""

    __slots__ = ("at", "lines", "title", "rows", "steps")

    def __init__(self, heading: str | None, content: str | None, tag: str | None):
        kept = [(i, x.strip()) for i, x in enumerate((content or "").split("\n")) if x.strip()]
        self.at, self.lines = [i for i, _ in kept], [x for _, x in kept]
        head = bare(heading)
        self.title = next((i for i, x in enumerate(self.lines) if len(x) <= 2 * len(heading) + 20 and bare(x) == head), None) if head else None
        cells = [is_row(x) for x in self.lines]
        in_table = (tag or "").strip().lower() == "table"
        self.rows = [c and (in_table or cells[i - 1 : i] == [True] or cells[i + 1 : i + 2] == [True]) for i, c in enumerate(cells)]
        self.steps = [is_step(x) for x in self.lines]


class Features:
    """Words, pairs of neighbours and pairs one word apart of many lines at once, as 64-bit keys."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.hashes = np.zeros(1 << 16, dtype=np.uint64)

    def number(self, word: str) -> int:
        i = self.known.get(word)
        if i is None:
            i = self.known[word] = len(self.known)
            if i == len(self.hashes):
                self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
            self.hashes[i] = xxhash.xxh64_intdigest(word)
        return i

    def of(self, lines: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(line, key) of all features; digits are one word, so are the ends of a line."""
        if len(self.known) > 500_000:
            self.known.clear()
        number = self.number
        start, end, digits = number("\x02"), number("\x03"), number("0")
        lists = [[start, *[digits if w[0].isdigit() else number(w) for w in _TOKEN.findall(x.lower())], end] for x in lines]
        sizes = np.array([len(x) for x in lists], dtype=np.int64)
        h = self.hashes[np.fromiter((i for x in lists for i in x), dtype=np.int64, count=int(sizes.sum()))]
        line = np.repeat(np.arange(len(lines)), sizes)
        with np.errstate(over="ignore"):
            pair, apart = (h[:-1] * _MIX) ^ h[1:], (h[:-2] * _MIX ^ np.uint64(7)) * _MIX ^ h[2:]
        near, far = line[:-1] == line[1:], line[:-2] == line[2:]
        return np.concatenate([line, line[:-1][near], line[:-2][far]]), np.concatenate([h, pair[near], apart[far]])


class LinkDensity:
    """The probability that a line belongs to the surroundings of a page: logistic regression on its known features."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        self.keys, self.weights, self.bias = keys, weights, bias

    def of(self, lines: Sequence[str], features: Features) -> np.ndarray:
        if not len(lines) or not len(self.keys):
            return np.zeros(len(lines))
        line, key = features.of(lines)
        spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[spot] == key
        line, spot = line[hit], spot[hit]
        n = np.maximum(np.bincount(line, minlength=len(lines)), 1)
        return 1 / (1 + np.exp(-(np.bincount(line, self.weights[spot], minlength=len(lines)) / np.sqrt(n) + self.bias)))


def fit(line: np.ndarray, column: np.ndarray, columns: int, labels: np.ndarray, weights: np.ndarray, steps: int = 80) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and probabilities of a logistic regression on sparse rows of unit length (full batches, Adagrad)."""
    n = len(labels)
    value = (1 / np.sqrt(np.maximum(np.bincount(line, minlength=n), 1)))[line]
    w, b, squares, square, total = np.zeros(columns), -2.0, np.full(columns, 1e-9), 1e-8, weights.sum()

    def chance():
        return 1 / (1 + np.exp(-(np.bincount(line, w[column] * value, minlength=n) + b)))

    for _ in range(steps):
        off = (chance() - labels) * weights
        slope = np.bincount(column, off[line] * value, minlength=columns) / total + 1e-5 * w
        squares += slope * slope
        w -= 0.7 * slope / np.sqrt(squares)
        mean = off.sum() / total
        square += mean * mean
        b -= 0.3 * mean / np.sqrt(square)
    return w, b, chance()


def outer_lines(page: Page, chance: np.ndarray) -> list[int]:
    """The places of the lines before the title and after the last paragraph, step or row of a page with a title."""
    last = None
    for i, x in enumerate(page.lines):
        if i > page.title and (page.rows[i] or page.steps[i] or len(x) >= PARAGRAPH and _ENDS.search(x) and chance[i] < 0.1):
            last = i
    return list(range(page.title)) + ([] if last is None else list(range(last + 1, len(page.lines))))


def fitted(chunks: list[tuple]) -> LinkDensity:
    """The link density learned from a sample of (heading, content, tag)."""
    pages = [Page(*c) for c in chunks]
    headings = [h.strip() for h, *_ in chunks if bare(h)]
    lines = [x for p in pages for x in p.lines] + headings
    if not any(p.title for p in pages):
        return LinkDensity(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    starts = np.concatenate([[0], np.cumsum([len(p.lines) for p in pages])])
    line, key = Features().of(lines)
    order = np.lexsort((key, line))
    line, key = line[order], key[order]
    first = np.ones(len(key), dtype=bool)
    first[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1])
    line, key = line[first], key[first]
    keys, column, count = np.unique(key, return_inverse=True, return_counts=True)
    often = count >= FEATURE_LINES
    line, column, keys = line[often[column]], (np.cumsum(often) - 1)[column[often[column]]], keys[often]
    titled, heading, before = np.zeros(len(lines), dtype=bool), np.zeros(len(lines), dtype=bool), np.zeros(len(lines))
    heading[starts[-1] :] = True
    for p, low, high in zip(pages, starts, starts[1:]):
        if p.title is not None:
            titled[low:high], heading[low + p.title], before[low : low + p.title] = True, True, 1.0
    weights = np.where(titled, 1.0, UNTITLED * titled.sum() / max((~titled).sum(), 1))
    *_, chance = fit(line, column, len(keys), before, weights)
    outer = before.copy()
    for p, low in zip(pages, starts):
        if p.title is not None:
            outer[[low + i for i in outer_lines(p, chance[low:])]] = 1.0
    w, b, chance = fit(line, column, len(keys), outer, weights)
    for _ in range(ROUNDS):
        labels = (((chance > RELABEL) & ~heading) | ((outer > 0) & (chance > 0.1))).astype(float)
        w, b, chance = fit(line, column, len(keys), labels, np.ones(len(lines)))
    return LinkDensity(keys, w, b)


def links_of(page: Page, density: np.ndarray) -> np.ndarray:
    """The link density of the lines: of a title none, of lines that don't end as sentences more than their wording says."""
    odds = density / np.maximum(1 - density, 1e-9)
    raised = odds * OPEN / (1 + odds * OPEN)
    out = np.array([d if page.rows[i] or page.steps[i] or _ENDS.search(x) else r for i, (x, d, r) in enumerate(zip(page.lines, density, raised))])
    if page.title is not None:
        out[page.title] = 0.0
    return out


def judged(page: Page, density: np.ndarray) -> tuple[np.ndarray, float]:
    """The points of the block of each line, and those of the best block.

    A block is a run of lines that are all mostly links or all mostly text; it has the mean points of its lines and a share
    in those of the whole chunk.
    """
    if not page.lines:
        return np.zeros(0), 0.0
    links = links_of(page, density)
    points = np.array([1 + min(x.count(","), MOST) + min(len(x) / 100, MOST) for x in page.lines]) * (1 - links)
    block = np.concatenate([[0], np.cumsum(np.diff(links >= 0.5))])
    scores = np.bincount(block, points) / np.bincount(block) + SHARED * points.mean()
    return scores[block], float(scores.max())


def furniture_of(page: Page, density: np.ndarray) -> list[int]:
    """The numbers of the lines of a page in one piece that are outside its main body."""
    scores, best = judged(page, density)
    return [at for at, s in zip(page.at, scores) if s < max(SIBLING * best, FLOOR)]


def html_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_id, vector_id, heading, content, tag) of the chunks with text of html documents."""
    html = documents.where("document_id IS NOT NULL AND lower(trim(source_type)) = 'html'").select("document_id").distinct()
    tag = F.col("chunk_metadata")["html_tag"] if "chunk_metadata" in chunks.columns else F.lit(None).cast("string")
    pages = chunks.where("vector_id IS NOT NULL AND length(trim(content)) > 0").select("document_id", "vector_id", "heading", "content", tag.alias("tag"))
    return spread(pages).join(small_side(html), "document_id", "left_semi")


def link_density(pages: DataFrame) -> LinkDensity:
    """Fitted on at most ``SAMPLE`` chunks that repeat their heading in the text and as many others, chosen by a hash."""
    short = pages.where(F.length("content") <= SAMPLE_CHARS).select("heading", "content", "tag", F.xxhash64("vector_id", "content").alias("h"))
    titled = F.coalesce(F.contains(F.col("content"), F.concat("heading", F.lit("\n"))), F.lit(False))
    sides = [short.where(side).distinct().orderBy("h", "content").limit(SAMPLE) for side in (titled, ~titled)]
    return fitted([(r.heading, r.content, r.tag) for r in sides[0].unionByName(sides[1]).orderBy("h", "content").collect()])  # 2 x SAMPLE


def furniture(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(vector_id, line_no) of the non-blank lines outside the main body, in chunks of html documents.

    The chunks of a document are one page: blocks are compared with the best of them all. Without any page that repeats its
    heading nothing is known of link density, and only lines too poor in points are furniture.

    Chunks of documents that aren't html, or aren't known, null ids, and null or blank contents give
    no rows; rows sent twice count once; other columns are ignored; an empty table gives an empty result.
    """
    pages = html_chunks(chunks, documents)
    sent = pages.sparkSession.sparkContext.broadcast(link_density(pages))  # features of the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, features = sent.value, Features()
        for whole in batches:
            for batch in (whole.slice(low, 1000) for low in range(0, whole.num_rows, 1000)):
                ids, vectors, *texts = [c.to_pylist() for c in batch.columns]
                parts = [Page(*t) for t in zip(*texts)]
                density = model.of([x for p in parts for x in p.lines], features)
                rows, most, low = [], {}, 0
                for d, v, p in zip(ids, vectors, parts):
                    scores, best = judged(p, density[low : low + len(p.lines)])
                    low += len(p.lines)
                    rows += [(d, v, at, float(s), None) for at, s in zip(p.at, scores)]
                    most[d] = max(best, most.get(d, 0.0))
                rows += [(d, None, None, None, best) for d, best in most.items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int32(), pa.float64(), pa.float64()))], ["document_id", "vector_id", "line_no", "score", "best"])

    lines = written(pages.mapInArrow(run, "document_id string, vector_id string, line_no int, score double, best double"), "page-lines")
    best = small_side(lines.where("best IS NOT NULL").groupBy("document_id").agg(F.max("best").alias("most")))
    low = lines.where("score IS NOT NULL").join(best, "document_id").where(F.col("score") < F.greatest(SIBLING * F.col("most"), F.lit(FLOOR)))
    return low.select("vector_id", "line_no").distinct()


def main_content(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """``chunks`` with only the main body of html pages in ``content``; ``removed_lines`` tells how many lines went.

    All rows and columns stay; chunks of other documents and null contents stay as they are; a chunk without any main body
    keeps an empty string. Blank lines stay.
    """
    gone = furniture(chunks, documents).groupBy(F.col("vector_id").alias("_v")).agg(F.collect_set("line_no").alias("_gone"))
    kept = F.filter(F.split("content", "\n", -1), lambda _, i: ~F.array_contains(F.col("_gone"), i))
    out = chunks.join(gone, F.col("vector_id") == F.col("_v"), "left")
    return out.withColumn("content", F.when(F.col("_gone").isNull() | F.col("content").isNull(), F.col("content")).otherwise(F.array_join(kept, "\n"))).withColumn("removed_lines", F.coalesce(F.size("_gone"), F.lit(0))).drop("_v", "_gone")


def found(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """p3_found: (vector_id, line_no)."""
    return furniture(chunks, documents)
