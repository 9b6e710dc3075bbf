"""Scanning folders and routing files by extension and content type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Content types of extensions, and the routes of both.
TYPES = {
    ".html": "text/html", ".htm": "text/html", ".xhtml": "application/xhtml+xml", ".pdf": "application/pdf", ".doc": "application/msword",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".md": "text/markdown", ".txt": "text/plain", ".csv": "text/csv", ".xml": "text/xml",
    ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif", ".svg": "image/svg+xml", ".bmp": "image/bmp", ".css": "text/css", ".js": "text/javascript",
    ".json": "application/json", ".zip": "application/zip",
}
ROUTES = [
    ("html", [".html", ".htm"], ["text/html", "application/xhtml+xml"], None),
    ("pdf", [".pdf"], ["application/pdf"], None),
    ("word", [".doc", ".docx"], ["application/msword", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"], None),
    ("text", [".md", ".txt"], [], "text/"),
    ("image", [".jpg", ".jpeg", ".png", ".gif"], [], "image/"),
    ("ignored", [".css", ".js"], [], None),
]
ICON_WORDS = "icon logo spacer bullet btn button pixel".split()


def extension(path: Column) -> Column:
    """The last extension of a path's file name, in lower case, with its dot; empty for names that only begin with one."""
    return F.lower(F.regexp_extract(F.regexp_extract(path, r"[^/\\]*$", 0), r"[^.](\.[^.]*)$", 1))


def content_type(path: Column) -> Column:
    """The content type of a path's extension; null if it isn't known."""
    types = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    return F.try_element_at(types, extension(path))


def route(path: Column, given_type: Column | None = None) -> Column:
    """html, pdf, word, text, image, ignored or unsupported: the first whose extension or content type fits.

    A given content type goes before that of the extension. Null paths are ``unsupported`` unless their type tells.
    """
    kind = F.coalesce(*([given_type] if given_type is not None else []), content_type(path), F.lit(""))
    ext = F.coalesce(extension(path), F.lit(""))
    out = None
    for name, extensions, types, prefix in ROUTES:
        fits = ext.isin(extensions)
        if types:
            fits = fits | kind.isin(types)
        if prefix:
            fits = fits | kind.startswith(prefix)
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out.otherwise("unsupported")


def source_type(route_: Column) -> Column:
    return F.when(route_.isin("unsupported", "ignored"), "document").otherwise(route_)


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder and those below it: (path, length, modified, content, route, content_type, file_hash).

    Files of no length are not listed by Spark's file source.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return with_route(files.select("path", "length", F.col("modificationTime").alias("modified"), "content"))


def with_route(files: DataFrame) -> DataFrame:
    return files.withColumn("route", route(F.col("path"))).withColumn("content_type", F.coalesce(content_type(F.col("path")), F.lit("application/octet-stream"))).withColumn("file_hash", F.sha2("content", 256))


def accepted(files: DataFrame, max_bytes: int) -> DataFrame:
    """Files that may be uploaded: of a supported route, not empty, not above ``max_bytes``; others with the ``reason``."""
    reason = F.when(F.col("route").isin("unsupported", "ignored"), "unsupported_type").when(F.length("content") == 0, "empty").when(F.length("content") > max_bytes, "too_large")
    return files.withColumn("reason", reason)


def route_counts(files: DataFrame) -> DataFrame:
    """(route, files)."""
    return files.groupBy("route").agg(F.count("*").alias("files"))


def route_samples(files: DataFrame, n: int = 5) -> DataFrame:
    """(route, samples): the first ``n`` paths of each route."""
    first = files.withColumn("_n", F.row_number().over(Window.partitionBy("route").orderBy("path"))).where(F.col("_n") <= n)
    return first.groupBy("route").agg(F.array_sort(F.collect_list("path")).alias("samples"))


def is_small_image(name: Column, width: Column, height: Column) -> Column:
    """An icon by its name, or at most 32 by 32; unknown sizes are kept."""
    low = F.lower(F.coalesce(name, F.lit("")))
    named = low.rlike("|".join(ICON_WORDS))
    return named | F.coalesce((width <= 32) & (height <= 32), F.lit(False))
