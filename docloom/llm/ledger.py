"""Problem 2: records that differ only in formatting, counted in an incremental ledger.

The ledger holds one row for each canonical key: how many different records have it, the earliest of them and the
smallest id. It is bucketed by the key. A batch is reduced to its new (key, record) pairs, aggregated, and
full-outer-joined with the ledger rows of the buckets that it touches; counts are added and the earliest
representative stays. The pairs counted so far are kept beside it, bucketed alike; each batch only appends its own.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.canonical import letters_digits, sha256_digits
from docloom.storage import shared_dir, skewed_join, written

#: Buckets of a ledger. One of very many keys needs more, so that a small batch touches few of them.
BUCKETS = 32
COUNTS = "record string, key binary, copies bigint, earliest struct<at timestamp, id string>, first_id string"
SEEN = "record string, key binary, id string, at timestamp"


def chunk_key(content, chunk_type):
    """Canonical text of a chunk: letters and digits in order; of a table, those of its lines in any order; else null."""
    lines = F.array_sort(F.filter(F.transform(F.split(content, "\n"), letters_digits), lambda x: x != ""))
    text = F.when(F.lower(F.trim(chunk_type)) == "table", F.array_join(lines, "\n")).otherwise(letters_digits(content))
    return F.nullif(text, F.lit(""))


def document_key(file_hash, doc_metadata):
    """Canonical text of a file's record: its 64 digits, or where no hash is known the metadata with sorted keys; else null."""
    pairs = F.map_entries(F.from_json(doc_metadata, "map<string,string>"))
    pairs = F.array_sort(F.transform(pairs, lambda e: F.to_json(F.struct(e["key"].alias("k"), letters_digits(e["value"]).alias("v"), e["value"].isNull().alias("n")))))
    return F.when(file_hash.isNotNull(), F.concat(F.lit("hash:"), sha256_digits(file_hash))).otherwise(F.concat(F.lit("metadata:"), F.nullif(F.array_join(pairs, "\n"), F.lit(""))))


def keyed(df: DataFrame, record: str, id_col: str, key, at: str | None = "created_at") -> DataFrame:
    """(record, key, id, at) of the rows of ``df`` that have a canonical key and an id."""
    rows = df.select(F.lit(record).alias("record"), F.col(id_col).cast("string").alias("id"), key.alias("text"), (F.col(at) if at else F.lit(None)).cast("timestamp").alias("at"))
    return rows.where("id IS NOT NULL AND text IS NOT NULL").select("record", F.unhex(F.md5(F.concat_ws(":", "record", "text"))).alias("key"), "id", "at")


def _by_time(at: Column, id_: Column) -> Column:
    """What the earliest record has least of; records without a time come last."""
    return F.struct(at.isNull().alias("none"), at.alias("at"), id_.alias("id"))


def aggregated(batch: DataFrame) -> DataFrame:
    """(record, key, copies, earliest, first_id) of keyed records; a record sent twice counts once, at its earliest time."""
    once = batch.groupBy("record", "key", "id").agg(F.min("at").alias("at"))
    rows = once.groupBy("record", "key").agg(F.count("*").alias("copies"), F.min(_by_time(F.col("at"), F.col("id"))).alias("e"), F.min("id").alias("first_id"))
    return rows.select("record", "key", "copies", F.struct("e.at", "e.id").alias("earliest"), "first_id")


def merged(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """Two aggregates of different records as one: counts are added, the earliest representative stays."""
    o, n = ledger.alias("o"), new.alias("n")
    old, add = ({c: F.col(f"{t}.{c}") for c in new.columns} for t in "on")
    earlier = _by_time(add["earliest"]["at"], add["earliest"]["id"]) < _by_time(old["earliest"]["at"], old["earliest"]["id"])
    return o.join(n, (old["record"] == add["record"]) & (old["key"] == add["key"]), "full_outer").select(
        *[F.coalesce(old[c], add[c]).alias(c) for c in ("record", "key")],
        (F.coalesce(old["copies"], F.lit(0)) + F.coalesce(add["copies"], F.lit(0))).alias("copies"),
        F.when(old["key"].isNull() | (add["key"].isNotNull() & earlier), add["earliest"]).otherwise(old["earliest"]).alias("earliest"),
        F.least(old["first_id"], add["first_id"]).alias("first_id"),
    )


class Ledger:
    """A ledger kept in a folder as tables ``counts`` and ``seen``, both partitioned by attempt and bucket.

    ``apply`` reads only the buckets that a batch touches. Each attempt writes under a name of its own: the new counts of
    those buckets and the pairs it adds. Only the manifest, written last in one file, makes them part of the ledger, so an
    attempt that breaks off changes nothing and may be repeated, and a batch applied again counts nothing twice. Writers
    take turns. ``buckets`` is fixed when a folder is first used.
    """

    def __init__(self, spark, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def manifest(self) -> list[tuple[int, str, int, bool]]:
        """(batch, attempt, bucket, whole) in order; ``whole`` marks compacted buckets, before which nothing counts."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return []
        rows = self.spark.read.schema("batch int, attempt string, bucket int, whole boolean").parquet(f"{self.path}/manifest")
        return sorted(tuple(r) for r in rows.collect())  # a row for each batch and bucket since the last compaction or before

    def _read(self, kind: str, schema: str, attempts: dict[str, list[int]]) -> DataFrame:
        if not attempts:
            return self.spark.createDataFrame([], schema)
        at = reduce(Column.__or__, [(F.col("attempt") == a) & F.col("bucket").isin(b) for a, b in attempts.items()])
        paths = [f"{self.path}/{kind}/attempt={a}" for a in attempts]
        rows = self.spark.read.schema(f"{schema}, attempt string, bucket int").option("basePath", f"{self.path}/{kind}").parquet(*paths)
        return rows.where(at).drop("attempt", "bucket")

    def counts(self, buckets: set[int] | None = None) -> DataFrame:
        """(record, key, copies, earliest, first_id)."""
        last = {b: a for _, a, b, _ in self.manifest() if buckets is None or b in buckets}
        return self._read("counts", COUNTS, _grouped(last.items()))

    def seen(self, buckets: set[int] | None = None) -> DataFrame:
        """(record, key, id, at): the pairs counted so far."""
        parts: dict[int, list[str]] = {}
        for _, a, b, whole in self.manifest():
            if buckets is None or b in buckets:
                parts[b] = [a] if whole else [*parts.get(b, []), a]
        return self._read("seen", SEEN, _grouped((b, a) for b, all_ in parts.items() for a in all_))

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")

    def _write(self, df: DataFrame, kind: str, attempt: str) -> None:
        # rebalanced: adaptive execution splits a large bucket over tasks and lets one task write several small ones
        parts = df.withColumn("bucket", self.bucket()).hint("rebalance", "bucket")
        parts.write.partitionBy("bucket").parquet(f"{self.path}/{kind}/attempt={attempt}")

    def _commit(self, attempt: str, buckets: set[int], whole: bool) -> None:
        batch = max((n for n, *_ in self.manifest()), default=0) + 1
        rows = [(batch, attempt, b, whole) for b in sorted(buckets)]
        self.spark.createDataFrame(rows, "batch int, attempt string, bucket int, whole boolean").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def apply(self, batch: DataFrame, stored: bool = False) -> None:
        """Count a batch of keyed records; those that an earlier batch had under the same key are not counted again.

        The batch is written first, as it is read twice, unless it is ``stored``, that is, selected from a table.
        """
        if not stored:
            batch = written(batch, "ledger-batch")
        touched = {r[0] for r in batch.select(self.bucket()).distinct().collect()}  # at most one a bucket
        if not touched:
            return
        attempt = uuid.uuid4().hex
        once = batch.groupBy("record", "key", "id").agg(F.min("at").alias("at"))
        self._write(once.join(self.seen(touched).select("record", "key", "id"), ["record", "key", "id"], "left_anti"), "seen", attempt)
        added = self._read("seen", SEEN, {attempt: sorted(touched)})
        self._write(merged(self.counts(touched), aggregated(added)), "counts", attempt)
        self._commit(attempt, touched, False)

    def compact(self) -> None:
        """Put the pairs of all batches into one attempt, so that later reads open fewer files; the content stays."""
        buckets = {b for _, _, b, _ in self.manifest()}
        if buckets:
            attempt = uuid.uuid4().hex
            self._write(self.seen(), "seen", attempt)
            self._write(self.counts(), "counts", attempt)
            self._commit(attempt, buckets, True)


def _grouped(pairs) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for bucket, attempt in pairs:
        out.setdefault(attempt, []).append(bucket)
    return out


def records_of(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """The keyed records of both kinds, as a table in the shared folder."""
    of_chunks = keyed(chunks, "chunk", "vector_id", chunk_key(F.col("content"), F.col("chunk_type")))
    of_documents = keyed(documents, "document", "document_id", document_key(F.col("file_hash"), F.col("doc_metadata")))
    return written(of_chunks.unionByName(of_documents), "keyed-records")


def build(records: DataFrame, batches: int = 2, buckets: int = BUCKETS, path: str | None = None) -> Ledger:
    """A ledger of ``records`` (keyed, a table), applied in ``batches`` by time of creation; rows without a time come first."""
    spark = records.sparkSession
    ledger = Ledger(spark, path or f"{shared_dir(spark)}/docloom-ledger-{uuid.uuid4().hex}", buckets)
    low, high = records.agg(F.unix_micros(F.min("at")), F.unix_micros(F.max("at"))).first()
    low, high = low or 0, high or 0
    step = max(1, (high - low) // batches + 1)
    batch_no = F.coalesce(F.floor((F.unix_micros("at") - F.lit(low)) / F.lit(step)), F.lit(0))
    for i in range(batches):
        ledger.apply(records.where(batch_no == i), stored=True)
    return ledger


def collapsed(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(record, first_id, copies): one row for each group of records that say the same.

    Contents without letters and digits, hashes that don't denote 64 digits and records without an id have no group. With
    a null hash and null or unreadable metadata a document has none either. Rows sent twice count once; empty tables give
    an empty result; other columns are ignored.
    """
    return build(records_of(chunks, documents)).counts().select("record", "first_id", "copies")


def found(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """p2_found: (record, first_id, copy_id) for every copy but the first, from the ledger's groups of two or more."""
    ledger = build(records_of(chunks, documents))
    groups = ledger.counts().where("copies > 1").select("key", "first_id")
    return skewed_join(ledger.seen(), groups, ["key"]).where("id <> first_id").select("record", "first_id", F.col("id").alias("copy_id"))
