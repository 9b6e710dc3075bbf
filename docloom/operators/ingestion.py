"""From files to tables: new files only, chunks with vectors, links, images, statistics and upserts."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from docloom.functions import text as T
from docloom.operators import chunking
from docloom.params import Params
from docloom.sources import extract, images
from docloom.sources.files import is_small_image, route
from docloom.storage import written


def new_files(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Files whose ``file_hash`` isn't among ``known``; of files with the same content the first by path."""
    first = files.withColumn("_n", F.row_number().over(Window.partitionBy("file_hash").orderBy("path"))).where("_n = 1").drop("_n")
    return first if known is None else first.join(known.select("file_hash").where("file_hash IS NOT NULL").distinct(), "file_hash", "left_anti")


def hashing_embedder(size: int) -> Callable[[list[str]], np.ndarray]:
    """A deterministic embedder for tests and defaults: hashed words with signs, of unit length."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size), dtype=np.float32)
        for i, text in enumerate(texts):
            for w in text.lower().split():
                h = xxhash.xxh64_intdigest(w)
                out[i, h % size] += 1.0 if h >> 63 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)

    return embed


def embedded(chunks: DataFrame, embed: Callable[[list[str]], np.ndarray], text_col: str = "content", batch: int = 256) -> DataFrame:
    """``chunks`` with ``embedding`` (array<float>): texts go to ``embed`` in batches across documents."""
    schema = ST.StructType([*chunks.schema.fields, ST.StructField("embedding", ST.ArrayType(ST.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(low, batch) for low in range(0, whole.num_rows, batch)):
                vectors = np.asarray(embed([t or "" for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]), dtype=np.float32)
                ends = np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(vectors.reshape(-1)))], [*b.schema.names, "embedding"])

    return chunks.mapInArrow(run, schema)


def point_id(document_id: Column, filename: Column, chunk_index: Column) -> Column:
    """The id of a chunk's vector: the same chunk has the same id in every run."""
    return T.uuid5(document_id, F.concat(filename, F.lit(":"), chunk_index.cast("string")))


def upserted(points: DataFrame, batch: DataFrame, key: str = "vector_id", newest: str = "created_at") -> DataFrame:
    """``points`` with the rows of ``batch`` in place of those of the same key; of a key's rows in the batch the newest counts.

    Rows without a key in the batch are left out. Columns are those of ``points``.
    """
    columns = points.columns
    last = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(F.col(newest).isNotNull().alias("has"), F.col(newest), F.hash(*[c for c in columns if not batch.schema[c].dataType.simpleString().startswith("map")]))).alias("r")).select("r.*")
    return points.join(last.select(key), key, "left_anti").unionByName(last)


def reindexed(chunks: DataFrame, documents: DataFrame, embed: Callable[[list[str]], np.ndarray], batch: int = 256) -> DataFrame:
    """Stored chunks with new vectors under the same ids; documents without chunks have none."""
    return embedded(chunks.join(documents.select("document_id").distinct(), "document_id", "left_semi"), embed, batch=batch)


def deleted(documents: DataFrame, chunks: DataFrame, links: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables without the documents of ``ids`` (document_id): their chunks and links go, links to them lose their target."""
    gone = ids.select("document_id").where("document_id IS NOT NULL").distinct()
    target = gone.select(F.col("document_id").alias("_gone"))
    kept = links.join(gone.withColumnRenamed("document_id", "source_document_id"), "source_document_id", "left_anti").join(target, F.col("target_document_id") == F.col("_gone"), "left")
    kept = kept.withColumn("target_document_id", F.when(F.col("_gone").isNull(), F.col("target_document_id"))).drop("_gone").select(*links.columns)
    return documents.join(gone, "document_id", "left_anti"), chunks.join(gone, "document_id", "left_anti"), kept


def index_status(points: DataFrame, vector_col: str = "embedding", id_col: str = "vector_id") -> DataFrame:
    """(points, vector_size): different points and the greatest length of their vectors."""
    return points.agg(F.count_distinct(id_col).alias("points"), F.coalesce(F.max(F.size(vector_col)), F.lit(0)).alias("vector_size"))


def target_path(source_path: Column, href: Column) -> Column:
    """The local path that a link leads to: none for other hosts and for anchors; relative to the folder of its source.

    ``..`` isn't resolved. A path that begins with the folder itself stays; a leading ``/`` goes.
    """
    clean = F.regexp_replace(href, r"#.*$", "")
    base = F.regexp_extract(source_path, r"^(.*)/[^/]*$", 1)
    foreign = href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") | href.startswith("//")
    inside = F.when((base != "") & clean.startswith(F.concat(base, F.lit("/"))), clean).when(clean.startswith("/"), F.ltrim(clean, F.lit("/"))).when(base != "", F.concat(base, F.lit("/"), F.regexp_replace(clean, r"^(?:\./)+", ""))).otherwise(clean)
    return F.when(~foreign & (clean != ""), F.when(source_path.isNull(), clean).otherwise(inside))


def local_asset_path(source_path: Column, href: Column, root: Column) -> Column:
    """``target_path`` with ``.`` and ``..`` resolved; null where it leads out of ``root``."""
    start = F.array().cast("array<string>")

    def step(out, x):
        up = F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))
        return F.when(x == ".", out).when(x == "..", up).otherwise(F.concat(out, F.array(x)))

    path = F.array_join(F.aggregate(F.split(target_path(source_path, href), "/"), start, step), "/")
    inside = F.regexp_replace(root, "/+$", "")
    return F.when((inside == "") & ~target_path(source_path, href).rlike(r"^(?:\./)*\.\.(?:/|$)"), path).when((inside != "") & path.startswith(F.concat(inside, F.lit("/"))), path)


def image_assets(refs: DataFrame, files: DataFrame, root: str = "") -> DataFrame:
    """(document_id, path, filename, file_hash, width, height, content_type, referenced_src): images that documents show and that are on disk.

    ``refs`` has (document_id, source_path, src); ``files`` (path, file_hash, width, height, content_type). Icons and
    references that lead out of ``root`` are left out. A reference made twice is one row.
    """
    r = refs.select("document_id", F.col("src").alias("referenced_src"), local_asset_path(F.col("source_path"), F.col("src"), F.lit(root)).alias("path")).where("path IS NOT NULL").distinct()
    name = F.regexp_extract("path", r"[^/\\]*$", 0)
    kept = r.join(files.select("path", "file_hash", "width", "height", "content_type"), "path").withColumn("filename", name).where(~is_small_image(name, F.col("width"), F.col("height")))
    return kept.select("document_id", "path", "filename", "file_hash", "width", "height", "content_type", "referenced_src")


def resolved_links(links: DataFrame, documents: DataFrame) -> DataFrame:
    """``links`` with ``target_document_id`` filled in where ``target_path`` is the path of a document, and ``newly_resolved``.

    Targets that are set stay. Where several documents have a path, the smallest id is taken.
    """
    paths = documents.where("source_path IS NOT NULL").groupBy(F.col("source_path").alias("_path")).agg(F.min("document_id").alias("_id"))
    open_ = F.col("target_document_id").isNull() & (F.coalesce("target_path", F.lit("")) != "")
    out = links.join(paths, open_ & (F.col("target_path") == F.col("_path")), "left")
    return out.withColumn("newly_resolved", open_ & F.col("_id").isNotNull()).withColumn("target_document_id", F.coalesce("target_document_id", "_id")).drop("_path", "_id")


def new_images(images: DataFrame, known: DataFrame) -> DataFrame:
    """Images that ``known`` doesn't have under the same hash, path and document; null equals null."""
    i, k = images.alias("i"), known.alias("k")
    same = [F.col(f"i.{c}").eqNullSafe(F.col(f"k.{c}")) for c in ("file_hash", "path", "referenced_by_document_id")]
    return i.join(k, same[0] & same[1] & same[2], "left_anti")


@dataclass(frozen=True)
class Ingested:
    """The tables of one ingestion run."""

    documents: DataFrame
    chunks: DataFrame
    links: DataFrame
    images: DataFrame
    stats: DataFrame


def ingest(files: DataFrame, known: DataFrame | None = None, params: Params = Params(), embed: Callable | None = None, root: str = "") -> Ingested:
    """Files (path, content, route, file_hash) as documents, chunks with vectors, links, images and statistics.

    Files known by their hash are skipped before they are read. A file that can't be read, or has no text, has no document;
    it is counted and doesn't touch other files.
    """
    readable = files.where(F.col("route").isin("html", "word", "text", "pdf"))
    fresh = written(extract.extracted(new_files(readable, known)).join(files.select("path", "file_hash", "route", "content_type"), "path"), "extracted")
    docs = fresh.withColumn("document_id", T.uuid5(F.lit("6ba7b811-9dad-11d1-80b4-00c04fd430c8"), F.col("file_hash"))).withColumn("filename", F.regexp_extract("path", r"[^/\\]*$", 0))
    chunks = chunking.chunked(docs, "document_id", "blocks", params.max_chunk, params.min_chunk, searched_only=True)
    chunks = chunks.join(docs.select("document_id", "filename"), "document_id").withColumn("vector_id", point_id(F.col("document_id"), F.col("filename"), F.col("chunk_index")))
    chunks = written(embedded(chunks.drop("filename"), embed or hashing_embedder(params.vector_size), batch=params.embed_batch), "chunks")
    size = chunking.document_stats(chunks, "document_id")
    documents = docs.join(size, "document_id").select("document_id", "filename", F.col("path").alias("source_path"), "file_hash", "content_type", F.col("route").alias("source_type"), F.lit("ingested").alias("status"), "text_length", "chunk_count", "title", "breadcrumbs")
    links = docs.join(size.select("document_id"), "document_id").select(F.col("document_id").alias("source_document_id"), F.col("path").alias("source_path"), F.explode("links").alias("l")).select("source_document_id", F.col("l.text").alias("link_text"), F.col("l.href").alias("href"), target_path(F.col("source_path"), F.col("l.href")).alias("target_path"), F.lit(None).cast("string").alias("target_document_id"))
    links = written(resolved_links(links, documents), "links")
    pictures = files.where("route = 'image'")
    sized = written(pictures.select("path", "file_hash", "content_type").join(images.with_dimensions(pictures), "path"), "pictures")
    refs = docs.join(size.select("document_id"), "document_id").select("document_id", F.col("path").alias("source_path"), F.explode("images").alias("i")).select("document_id", "source_path", "i.src")
    assets = written(image_assets(refs, sized, root), "images")
    seen = files.groupBy().agg(F.count("*").alias("total_files"), *[F.count_if(F.col("route") == r).alias(f"route_{r}") for r in ("html", "word", "text", "pdf", "image", "ignored", "unsupported")])
    read = fresh.agg(F.count("*").alias("files_read"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    done = documents.agg(F.count("*").alias("documents_ingested"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("total_chunks"))
    shown = assets.agg(F.count("*").alias("images_stored"))
    small = sized.agg(F.count_if(is_small_image(F.regexp_extract("path", r"[^/\\]*$", 0), F.col("width"), F.col("height"))).alias("images_skipped"))
    found = links.agg(F.count_if("newly_resolved").alias("links_resolved"))
    stats = reduce(DataFrame.crossJoin, [seen, read, done, shown, small, found])  # single rows
    supported = F.col("route_html") + F.col("route_word") + F.col("route_text") + F.col("route_pdf")
    stats = stats.withColumn("skipped_duplicate", supported - F.col("files_read")).withColumn("skipped_empty", F.col("files_read") - F.col("failed") - F.col("documents_ingested"))
    stats = stats.withColumn("processed", F.col("total_files")).withColumn("indexed", F.col("documents_ingested")).withColumn("documents_skipped", F.col("skipped_duplicate") + F.col("skipped_empty")).withColumn("ignored", F.col("route_ignored") + F.col("route_unsupported"))
    stats = stats.withColumn("batch_flushes", F.ceil(F.col("total_chunks") / params.embed_batch))
    return Ingested(documents, chunks, links.drop("newly_resolved"), assets, stats)


def ingest_folder(spark: SparkSession, folder: str, known: DataFrame | None = None, params: Params | None = None, embed: Callable | None = None) -> Ingested:
    """``ingest`` of a folder and those below it."""
    from docloom.sources.files import scan

    return ingest(scan(spark, folder), known, params or Params.from_conf(spark), embed, _uri(folder))


def _uri(folder: str) -> str:
    """A folder as the file source names the paths in it."""
    return folder if "://" in folder or folder.startswith("file:") else "file:" + os.path.abspath(folder)


def import_counters(documents: DataFrame, chunks: DataFrame, links: DataFrame, pictures: DataFrame, embed_batch: int = 256) -> DataFrame:
    """One row with the counters of what the tables hold, as an import reports them.

    Files recorded under a hash that an earlier path has are duplicates; ingested files without chunks are empty; rows sent
    twice count once.
    """
    d = documents.select("document_id", "filename", "file_hash", "status", "content_type").distinct()
    kind = route(F.col("filename"), F.col("content_type"))
    has = chunks.where(~F.col("chunk_type").isin("empty", "navigation")).select("document_id", "vector_id").distinct().groupBy("document_id").agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy("file_hash").orderBy("filename", "document_id"))
    d = d.join(has, "document_id", "left").withColumn("again", F.col("file_hash").isNotNull() & (first > 1)).withColumn("route", kind)
    readable = F.col("route").isin("html", "word", "text", "pdf")
    done = readable & ~F.col("again") & (F.col("status") == "ingested")
    of_documents = d.agg(
        F.count("*").alias("total_files"), F.count_if(F.col("status") == "ingested").alias("processed"), F.count_if(readable & F.col("again")).alias("skipped_duplicate"), F.count_if(done & F.col("n").isNull()).alias("skipped_empty"),
        F.count_if(done & F.col("n").isNotNull()).alias("documents_ingested"), F.count_if(F.col("route").isin("ignored", "unsupported")).alias("ignored"), F.coalesce(F.sum(F.when(done, F.col("n"))), F.lit(0)).alias("total_chunks"),
    )
    p = pictures.select("image_id", "filename", "width", "height").distinct()
    small = is_small_image(F.col("filename"), F.col("width"), F.col("height"))
    of_pictures = p.agg(F.count_if(~small).alias("images_stored"), F.count_if(small).alias("images_skipped"))
    found = resolved_links(links.distinct(), documents).agg(F.count_if("newly_resolved").alias("links_resolved"))
    out = of_documents.crossJoin(of_pictures).crossJoin(found)  # single rows
    return out.withColumn("documents_skipped", F.col("skipped_duplicate") + F.col("skipped_empty")).withColumn("batch_flushes", F.ceil(F.col("total_chunks") / embed_batch))


def import_stats(documents: DataFrame) -> DataFrame:
    """(source_type, documents, chunks, text_length, processing) of different documents by type."""
    d = documents.select("document_id", "source_type", "status", "chunk_count", "text_length").distinct()
    return d.groupBy("source_type").agg(F.count("*").alias("documents"), F.sum(F.coalesce("chunk_count", F.lit(0)).cast("bigint")).alias("chunks"), F.sum(F.coalesce("text_length", F.lit(0)).cast("bigint")).alias("text_length"), F.count_if(F.col("status") == "processing").alias("processing"))
