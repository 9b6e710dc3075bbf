"""Problem 5: records that share most of their runs of words, by a token-group matrix.

Tokens are hashes of runs of ``run`` words. They are ordered by rarity (a count-min sketch of the document frequency of
each token over all records; then the hash), and a record's *prefix* is its first tokens in that order: the first token
that two records above the threshold share stands in both prefixes, at places that leave enough tokens behind it.
Records are partitioned into groups of similar ones (same first token, nearly the same number of tokens). The matrix has a
row for each group with the union of its members' tokens, in ``BITS`` columns to which tokens are hashed. A record that
meets a member of a group in a prefix token is bounded against the whole group: the columns it has and the group lacks are
tokens that no member shares. Only groups whose bound reaches the threshold are opened, and the pairs in them are verified
on all their tokens. Nothing is lost: places, columns and sizes only rule out pairs that can't reach the threshold.

In scoped comparisons (candidates of one query) each scope has tokens of its own, so its records share none with others.

Records with the same letters and digits and the same token set are one class, represented by its smallest id; only
representatives go through the matrix, so groups of copies form no pairs. ``similar_pairs`` then expands the pairs of
classes to all their members; ``duplicate_groups`` keeps them as classes and links instead. Records are joined by 64-bit
hashes of their ids: two ids that collide only add candidates, as each pair is verified on its own tokens, and would be
missed only if they were similar to each other.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.storage import BROADCAST_BYTES, bytes_of, small_side, spread, written

#: Columns of the matrix, in longs of 64.
LONGS = 4
BITS = 64 * LONGS
#: Slots of the sketch of document frequencies: as many as a power of two, several times the number of records, within these.
SLOTS_LEAST, SLOTS_MOST = 1 << 20, 1 << 25
#: Slots that one row of a partial sketch holds.
SLICE = 1 << 16
_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Tokens:
    """Distinct tokens of many texts at once."""

    def __init__(self, run: int):
        self.run = run
        self.known: dict[str, int] = {}
        self.hashes = np.zeros(1 << 16, dtype=np.uint64)

    def numbers(self, text: str) -> list[int]:
        known, out = self.known, []
        for w in _WORD.findall(text.lower()):
            i = known.get(w)
            if i is None:
                i = known[w] = len(known)
                if i == len(self.hashes):
                    self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
                self.hashes[i] = xxhash.xxh64_intdigest(w)
            out.append(i)
        return out

    def of(self, texts: list[str], scopes: list[int | None]) -> tuple[np.ndarray, np.ndarray]:
        """(owner, token) of the distinct tokens of each text, sorted; tokens of different scopes differ."""
        if len(self.known) > 500_000:
            self.known.clear()
        run, lists = self.run, [self.numbers(t) for t in texts]
        sizes = np.array([len(x) for x in lists], dtype=np.int64)
        flat = np.fromiter((i for x in lists for i in x), dtype=np.int64, count=int(sizes.sum()))
        if len(flat) < run:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        h, m = self.hashes[flat], len(flat) - run + 1
        seed = np.array([(s or 0) & 0xFFFFFFFFFFFFFFFF for s in scopes], dtype=np.uint64)
        token = seed[owner[:m]]
        with np.errstate(over="ignore"):
            for k in range(run):
                token = (token ^ h[k : k + m]) * _MIX
                token ^= token >> np.uint64(29)
        whole = owner[:m] == owner[run - 1 :]
        owner, token = owner[:m][whole], token[whole]
        order = np.lexsort((token, owner))
        owner, token = owner[order], token[order]
        first = np.ones(len(token), dtype=bool)
        first[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
        return owner[first], token[first]


def copy_key(text: str, kind: str | None) -> bytes:
    """16 bytes that copies share: of letters and digits in order, of a table's lines in any order; none without any."""
    if kind is not None and kind.strip().lower() == "table":
        bare = "\n".join(sorted(x for x in ("".join(_WORD.findall(line)) for line in text.lower().split("\n")) if x))
    else:
        bare = "".join(_WORD.findall(text.lower()))
    return xxhash.xxh128_digest(bare) if bare else b""


def slots_for(records: int) -> int:
    """Slots of the sketch for a number of records; more slots only make the order by rarity finer."""
    return 1 << min(max((16 * max(records, 1)).bit_length(), SLOTS_LEAST.bit_length() - 1), SLOTS_MOST.bit_length() - 1)


def slot_of(token: np.ndarray, slots: int) -> np.ndarray:
    return (token >> np.uint64(13)).astype(np.int64) & (slots - 1)


def frequencies(texts: DataFrame, run: int, slots: int) -> np.ndarray:
    """The count-min sketch (one row of ``slots``) of the document frequencies of the tokens of (scope, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, sums, part = Tokens(run), np.zeros(slots, dtype=np.int64), 0
        for batch in batches:
            scopes, bodies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            part = part or xxhash.xxh32_intdigest(bodies[0] or "") if bodies else part
            for low in range(0, len(bodies), 2000):
                _, token = tokens.of(bodies[low : low + 2000], scopes[low : low + 2000])
                np.add.at(sums, slot_of(token, slots), 1)
        for i, values in enumerate(np.split(sums, slots // SLICE)):
            if values.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part % 64], pa.int32()), pa.array([zlib.compress(values.tobytes(), 1)], pa.binary())], ["slice", "part", "n"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(x), dtype=np.int64) for x in table.column("n").to_pylist())
        return pa.table({"slice": pa.array([table.column("slice")[0].as_py()], pa.int32()), "part": pa.array([0], pa.int32()), "n": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    schema = "slice int, part int, n binary"
    rows = texts.select("scope", "text").mapInArrow(count, schema).groupBy("slice", "part").applyInArrow(add, schema).groupBy("slice").applyInArrow(add, schema).collect()  # slots / SLICE rows
    out = np.zeros((slots // SLICE, SLICE), dtype=np.int64)
    for r in rows:
        out[r["slice"]] = np.frombuffer(zlib.decompress(r.n), dtype=np.int64)
    return out.reshape(-1)


RECORD = "scope bigint, id string, copy binary, sig binary, n int, first bigint, prefix array<bigint>, " + ", ".join(f"b{i} bigint" for i in range(LONGS))


def records_of(texts: DataFrame, run: int, threshold: float) -> DataFrame:
    """RECORD of each (scope, id, kind, text); ``first`` and ``prefix`` are empty for texts shorter than a run.

    ``sig`` is a hash of the whole token set.
    """
    slots = slots_for(texts.count())
    counts = np.minimum(frequencies(texts, run, slots), np.iinfo(np.int32).max).astype(np.int32)
    sent = texts.sparkSession.sparkContext.broadcast(counts)  # at most SLOTS_MOST numbers

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, sketch = Tokens(run), sent.value
        for whole in batches:
            for batch in (whole.slice(low, 2000) for low in range(0, whole.num_rows, 2000)):
                scopes, kinds, bodies = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
                owner, token = tokens.of(bodies, scopes)
                n = np.bincount(owner, minlength=len(bodies))
                start = np.concatenate([[0], np.cumsum(n)])
                sig = [xxhash.xxh128_digest(token[low:high]) for low, high in zip(start, start[1:])]
                order = np.lexsort((token, sketch[slot_of(token, slots)], owner))
                token = token[order]
                place = np.arange(len(token)) - start[owner]
                kept = place < (n - np.ceil(threshold * n - 1e-9) + 1)[owner]
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner[kept], minlength=len(bodies)))])
                bits = np.zeros((len(bodies), LONGS), dtype=np.uint64)
                column = (token >> np.uint64(3)) % np.uint64(BITS)
                np.bitwise_or.at(bits, (owner, (column // np.uint64(64)).astype(np.int64)), np.uint64(1) << (column % np.uint64(64)))
                signed = token.view(np.int64)
                first = np.zeros(len(bodies), dtype=np.int64)
                first[n > 0] = signed[start[:-1][n > 0]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), batch.column(1), pa.array([copy_key(t, k) for t, k in zip(bodies, kinds)], pa.binary()), pa.array(sig, pa.binary()), pa.array(n.astype(np.int32)), pa.array(first),
                        pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(signed[kept])), *[pa.array(bits[:, i].copy().view(np.int64)) for i in range(LONGS)],
                    ],
                    [c.split()[0] for c in RECORD.split(", ")],
                )

    return texts.select("scope", "id", "kind", "text").mapInArrow(work, RECORD)


def least_common(n: Column, m: Column, threshold: float) -> Column:
    """Tokens that sets of ``n`` and ``m`` tokens share at least if their Jaccard similarity reaches the threshold."""
    return F.ceil(F.lit(threshold / (1 + threshold)) * (n + m) - 1e-9)


def fits(n: Column, m: Column, threshold: float) -> Column:
    return F.least(n, m) >= F.lit(threshold) * F.greatest(n, m) - 1e-9


def verified(pairs: DataFrame, threshold: float) -> DataFrame:
    """``pairs`` whose token sets ``ta`` and ``tb`` reach the threshold, with their ``similarity``."""
    sized = pairs.where((F.size("ta") > 0) & fits(F.size("ta"), F.size("tb"), threshold)).withColumn("common", F.size(F.array_intersect("ta", "tb")))
    scored = sized.withColumn("similarity", F.col("common") / (F.size("ta") + F.size("tb") - F.col("common")))
    return scored.where(F.col("similarity") >= threshold - 1e-12).drop("ta", "tb", "common")


def classes_of(texts: DataFrame, run: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """All records with their class ``cid`` (a table), and one record a class: that of the smallest id, if it has tokens."""
    records = written(records_of(texts, run, threshold), "records").withColumn("uid", F.xxhash64("scope", "id")).withColumn("cid", F.xxhash64("scope", "copy", "sig"))
    several = records.where("n > 0").groupBy("cid").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high")
    g = small_side(written(several, "classes")).alias("g")
    r = records.alias("r")
    return records, r.join(g, (F.col("r.cid") == F.col("g.cid")) & (F.col("r.id") != F.col("g.low")), "left_anti").where("n > 0")


def class_pairs(texts: DataFrame, single: DataFrame, run: int, threshold: float) -> DataFrame:
    """(scope, first_id, second_id, first_cid, second_cid, similarity) of the representatives, through the token-group matrix.

    Pairs of classes of the same letters and digits are copies and left out.
    """
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25)))
    single = single.withColumn("gid", F.xxhash64("first", size_class))
    bits = [f"b{i}" for i in range(LONGS)]
    slim = single.select("uid", "gid", "n", *bits)
    matrix = slim.groupBy("gid").agg(F.count("*").alias("members"), F.min("n").alias("low"), *[F.bit_or(b).alias(b.replace("b", "u")) for b in bits]).where("members > 1")
    matrix = small_side(written(matrix, "groups"))
    # each record with the row of its group; a group of one is its own row
    rows = slim.join(matrix, "gid", "left").select("uid", "gid", "n", *bits, F.coalesce("low", "n").alias("low"), *[F.coalesce(b.replace("b", "u"), b).alias(b.replace("b", "u")) for b in bits])
    rows = written(rows, "matrix")
    entries = single.select("uid", "n", F.posexplode("prefix").alias("place", "token"))
    a, b = entries.alias("a"), entries.alias("b")
    left = F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place"))  # tokens from the shared one on
    meet = (F.col("a.token") == F.col("b.token")) & (F.col("a.uid") < F.col("b.uid")) & fits(F.col("a.n"), F.col("b.n"), threshold) & (left >= least_common(F.col("a.n"), F.col("b.n"), threshold))
    met = a.join(b, meet).select(F.col("a.uid").alias("ua"), F.col("b.uid").alias("ub"))
    hint = F.broadcast if bytes_of(rows) <= BROADCAST_BYTES else (lambda x: x)
    q = hint(rows.select(F.col("uid").alias("ua"), F.col("n").alias("nq"), *[F.col(b).alias(f"q{b}") for b in bits]))
    of_group = hint(rows.select(F.col("uid").alias("ub"), "gid", "low", *[b.replace("b", "u") for b in bits]))
    lacks = sum((F.bit_count(F.col(f"q{b}").bitwiseAND(F.bitwise_not(F.col(b.replace("b", "u"))))) for b in bits), F.lit(0))
    # no member shares the tokens behind the columns that the group lacks; its smallest member needs least
    need = F.greatest(F.ceil(F.lit(threshold) * F.col("nq") - 1e-9), least_common(F.col("nq"), F.col("low"), threshold))
    opened = met.join(q, "ua").join(of_group, "ub").where(F.col("nq") - lacks >= need).select("ua", "gid").distinct()
    x = slim.select(F.col("uid").alias("ua"), F.col("n").alias("nq"), *[F.col(b).alias(f"q{b}") for b in bits])
    apart = sum((F.bit_count(F.col(f"q{b}").bitwiseAND(F.bitwise_not(F.col(b)))) for b in bits), F.lit(0))
    opened = small_side(written(opened, "opened-groups"))
    pairs = opened.join(slim, "gid").where("ua <> uid").join(x, "ua").where(fits(F.col("nq"), F.col("n"), threshold) & (F.col("nq") - apart >= least_common(F.col("nq"), F.col("n"), threshold)))
    candidates = written(pairs.select(F.least("ua", "uid").alias("ua"), F.greatest("ua", "uid").alias("ub")).distinct(), "candidates")
    wanted = written(candidates.select(F.explode(F.array("ua", "ub")).alias("uid")).distinct(), "wanted")
    sets = _token_sets(texts.withColumn("uid", F.xxhash64("scope", "id")).join(small_side(wanted), "uid", "left_semi"), run)
    classes = small_side(written(single.join(small_side(wanted), "uid", "left_semi").select("uid", "cid", "copy").distinct(), "wanted-classes"))
    sets = written(sets.join(classes, "uid"), "token-sets")
    l, r = sets.alias("l"), sets.alias("r")
    both = candidates.join(l, F.col("ua") == F.col("l.uid")).join(r, F.col("ub") == F.col("r.uid")).where("l.id <> r.id AND l.copy <> r.copy AND l.scope IS NOT DISTINCT FROM r.scope")
    ordered = F.col("l.id") < F.col("r.id")
    side = lambda c, first: F.when(ordered == first, F.col(f"l.{c}")).otherwise(F.col(f"r.{c}"))
    named = [side("id", True).alias("first_id"), side("id", False).alias("second_id"), side("cid", True).alias("first_cid"), side("cid", False).alias("second_cid")]
    return verified(both.select("l.scope", *named, F.col("l.tokens").alias("ta"), F.col("r.tokens").alias("tb")), threshold)


def expanded(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """(first_id, second_id, similarity) of the members of the classes of ``pairs``; a class of one is its representative."""
    pairs = written(pairs, "class-pairs")
    named = small_side(written(pairs.select(F.explode(F.array("first_cid", "second_cid")).alias("cid")).distinct(), "paired-classes"))
    member = small_side(written(records.join(named, "cid", "left_semi").select("cid", "id").distinct(), "members"))
    a, b = (member.select(F.col("cid").alias(f"{s}_cid"), F.col("id").alias(s)) for s in ("first", "second"))
    both = pairs.select("first_cid", "second_cid", "similarity").join(a, "first_cid").join(b, "second_cid").where("first <> second")
    return both.select(F.least("first", "second").alias("first_id"), F.greatest("first", "second").alias("second_id"), "similarity").distinct()


def _token_sets(texts: DataFrame, run: int) -> DataFrame:
    """(uid, scope, id, tokens) with all tokens."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(run)
        for batch in batches:
            bodies = batch.column(3).to_pylist()
            owner, token = tokens.of(bodies, [None] * len(bodies))
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(bodies)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(pa.array(ends), pa.array(token.view(np.int64)))], ["uid", "scope", "id", "tokens"])

    return texts.select("uid", "scope", "id", "text").mapInArrow(work, "uid bigint, scope bigint, id string, tokens array<bigint>").distinct()


def _given(texts: DataFrame) -> DataFrame:
    return spread(texts.select("id", F.col("scope").cast("bigint").alias("scope"), "text", "kind").where("id IS NOT NULL AND text IS NOT NULL"))


def similar_pairs(texts: DataFrame, threshold: float = 0.8, run: int = 5) -> DataFrame:
    """(first_id, second_id, similarity) of all pairs of records whose sets of word runs reach a Jaccard similarity.

    ``texts`` has ``id`` (string), ``scope`` (bigint, null for all), ``text`` and ``kind`` (``table`` for texts whose lines
    may stand in any order). Ids are ordered as strings, the smaller first. Copies in the sense of the ledger (same letters
    and digits within the scope) don't pair with each other, but each pairs with all others that it is similar to.
    Null ids, null texts and texts shorter than a run have no pairs; rows sent twice count once; an empty table gives an
    empty result; other columns are ignored.
    """
    texts = _given(texts)
    records, single = classes_of(texts, run, threshold)
    return expanded(class_pairs(texts, single, run, threshold), records)


def duplicate_groups(texts: DataFrame, threshold: float = 0.8, run: int = 5) -> DataFrame:
    """(scope, id, class_id, group_id, links): each record with its class, its group and the number of classes it is similar to.

    ``class_id`` is the smallest id of the records with its letters and word runs, ``group_id`` the smallest ``class_id``
    that its class is linked with through any number of similar pairs, or through being a copy. Nothing is paired within a
    class, so a class of any size costs one row a record. Records without word runs stand alone, copies of each other aside.
    """
    texts = _given(texts)
    records, single = classes_of(texts, run, threshold)
    pairs = written(class_pairs(texts, single, run, threshold), "class-pairs")
    # records without runs have no representative in the matrix; they are classes of their copies
    key = F.when(F.length("copy") > 0, F.xxhash64("scope", "copy")).otherwise(F.xxhash64("scope", "id", F.lit("alone")))
    member = written(records.select("scope", "id", "cid", key.alias("copies")).distinct(), "class-members")
    classes = written(member.groupBy("cid", "copies").agg(F.min("id").alias("class_id")), "class-ids")
    links = pairs.select(F.explode(F.array("first_cid", "second_cid")).alias("cid")).groupBy("cid").agg(F.count("*").alias("links"))
    same = classes.groupBy("copies").agg(F.min("cid").alias("low"), F.max("cid").alias("high")).where("low < high").select("copies", "low")
    edges = pairs.select(F.col("first_cid").alias("a"), F.col("second_cid").alias("b")).unionByName(classes.join(same, "copies").where("cid <> low").select(F.col("cid").alias("a"), F.col("low").alias("b")))
    labels = smallest_reachable(edges)
    named = classes.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("label", "cid"))
    # groups that no edge touches are told apart by their copies, as classes of texts without runs share a hash of no tokens
    groups = named.groupBy("root", F.when(F.col("label").isNull(), F.col("copies")).alias("alone")).agg(F.min("class_id").alias("group_id"))
    n, g = named.alias("n"), groups.alias("g")
    alone = F.when(F.col("n.label").isNull(), F.col("n.copies"))
    named = n.join(g, (F.col("n.root") == F.col("g.root")) & alone.eqNullSafe(F.col("g.alone"))).select("n.cid", "n.copies", "n.class_id", "g.group_id")
    out = member.join(named, ["cid", "copies"]).join(links, "cid", "left")
    return out.select("scope", "id", "class_id", "group_id", F.coalesce("links", F.lit(0)).alias("links")).distinct()


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """(node, label): of each node of (a, b) the smallest node that any path leads to.

    Alternating large and small stars: each round joins nodes to the smallest of their neighbours, so paths shrink by half
    and a round is one shuffle of the edges that are left. Each round is written, so that a lost executor repeats only that.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        now = written(small, "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
        before = state


def sources(chunks: DataFrame, retrieved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chunks, compared with each other, and the candidates of retrieval, compared within their query."""
    c = chunks.select(F.col("vector_id").alias("id"), F.lit(None).cast("bigint").alias("scope"), F.col("content").alias("text"), F.col("chunk_type").alias("kind"))
    r = retrieved.where("query_id IS NOT NULL").select(F.col("hit_id").alias("id"), F.col("query_id").cast("bigint").alias("scope"), "text", F.col("metadata.chunk_type").alias("kind"))
    return c, r


def groups(chunks: DataFrame, retrieved: DataFrame) -> DataFrame:
    """p5_groups: (record, query_id, id, class_id, group_id, links) of all chunks and candidates with a text."""
    parts = [duplicate_groups(df, threshold=0.6, run=3).select(F.lit(record).alias("record"), F.col("scope").alias("query_id"), "id", "class_id", "group_id", "links") for record, df in zip(("chunk", "retrieved"), sources(chunks, retrieved))]
    return parts[0].unionByName(parts[1])


def found(chunks: DataFrame, retrieved: DataFrame) -> DataFrame:
    """p5_found: (record, first_id, second_id)."""
    parts = [similar_pairs(df, threshold=0.6, run=3).select(F.lit(record).alias("record"), "first_id", "second_id") for record, df in zip(("chunk", "retrieved"), sources(chunks, retrieved))]
    return parts[0].unionByName(parts[1])
