"""Blocks of documents as chunks: headings carried forward, paragraphs packed up to a size.

A document is one row with an array of blocks; everything happens within the row, so no plan here has a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from docloom.functions import text as T

#: Fixed values.
HEADING_STYLES = ["title", "heading 1", "heading 2", "heading 3"]
BLOCK = "struct<text:string,heading:string,style:string,html_tag:string>"
PIECE = "struct<content:string,heading:string,html_tag:string>"


def text_blocks(text: Column) -> Column:
    """Paragraphs (parted by empty lines) of a plain text as an array of BLOCK."""
    none = F.lit(None).cast("string")
    parts = F.split(F.regexp_replace(T.sanitize(text), r"\r\n?", "\n"), r"\n\n")
    return F.transform(parts, lambda p: F.struct(p.alias("text"), none.alias("heading"), none.alias("style"), none.alias("html_tag")))


def normalized_blocks(blocks: Column) -> Column:
    """An array of BLOCK as an array of (text, name, html_tag) without blank ones; ``name`` is that of a heading, else null.

    A block is a heading by its style, by being equal to its own heading, or by its look.
    """

    def read(b):
        return T.let(T.squeeze(T.sanitize(b["text"])), lambda t: T.let(T.sanitize(b["heading"]), lambda h: judged(b, t, h)))

    def judged(b, t, h):
        head = F.lower(F.coalesce(b["style"], F.lit(""))).isin(HEADING_STYLES) | ((h != "") & (h == t)) | T.looks_like_heading(t)
        return F.struct(t.alias("text"), F.when(head, F.coalesce(F.nullif(h, F.lit("")), t)).alias("name"), b["html_tag"].alias("html_tag"))

    return F.filter(F.transform(blocks, read), lambda b: b["text"] != "")


def packed(blocks: list[dict], max_chars: int, min_chars: int) -> list[dict]:
    """Chunks (content, heading, html_tag) of normalized blocks, folded in order: where one ends depends on the one before.

    A heading names the paragraphs after it and is used up. Paragraphs of one heading share a chunk until the next would
    pass ``max_chars``, unless the chunk has fewer than ``min_chars`` (line breaks don't count). A longer paragraph is cut
    into slices of ``max_chars``. The tag of the last paragraph that has one is the chunk's.
    """
    out: list[dict] = []
    held: list[str] = []
    size, heading, tag, name = 0, None, None, None

    def flush():
        if held:
            out.append({"content": "\n\n".join(held).strip(), "heading": heading, "html_tag": tag})
            held.clear()

    for b in blocks:
        if b["name"] is not None:
            name = b["name"]
            continue
        text = b["text"]
        if held and (name != heading or (size + len(text) > max_chars and size >= min_chars)) or len(text) > max_chars:
            flush()
            size, tag = 0, None
        heading = name
        if len(text) > max_chars:
            slices = (text[low : low + max_chars].strip() for low in range(0, len(text), max_chars))
            out += [{"content": x, "heading": heading, "html_tag": b["html_tag"]} for x in slices if x]
            continue
        held.append(text)
        size, tag = size + len(text), b["html_tag"] or tag
    flush()
    return out


def chunked(documents: DataFrame, id_col: str = "doc_id", blocks_col: str = "blocks", max_chars: int = 1800, min_chars: int = 300, searched_only: bool = False) -> DataFrame:
    """(id_col, chunk_index, content, heading, html_tag, chunk_type, language, char_count) of documents with an array of BLOCK.

    With ``searched_only`` chunks that aren't searched (empty, navigation) are left out before chunks are numbered from 0.
    """
    given = documents.select(id_col, normalized_blocks(F.col(blocks_col)).alias("blocks"))
    list_type = pa.list_(pa.struct([(n, pa.string()) for n in ("content", "heading", "html_tag")]))
    schema = ST.StructType([documents.schema[id_col], ST.StructField("pieces", ST._parse_datatype_string(f"array<{PIECE}>"))])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = [packed(b or [], max_chars, min_chars) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pieces, list_type)], [id_col, "pieces"])

    typed = F.transform("pieces", lambda c: F.struct(c["content"].alias("content"), c["heading"].alias("heading"), c["html_tag"].alias("html_tag"), T.chunk_type(c["content"], c["html_tag"]).alias("chunk_type")))
    kept = F.filter(typed, lambda c: ~c["chunk_type"].isin("empty", "navigation")) if searched_only else typed
    out = given.mapInArrow(fold, schema).select(id_col, F.posexplode(kept).alias("chunk_index", "c")).select(id_col, "chunk_index", "c.*")
    return out.withColumn("language", T.fallback_language(F.col("content"))).withColumn("char_count", F.length("content"))


def chunk_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_chars: int = 1800, min_chars: int = 300) -> DataFrame:
    """The searched chunks of plain texts, row by row. Null and blank texts have none."""
    blocks = documents.where(F.col(text_col).isNotNull()).select(id_col, text_blocks(F.col(text_col)).alias("blocks"))
    return chunked(blocks, id_col, max_chars=max_chars, min_chars=min_chars, searched_only=True)


def document_stats(chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, text_length, chunk_count) of each document with chunks."""
    return chunks.groupBy(id_col).agg(F.sum(F.length("content")).cast("int").alias("text_length"), F.count("*").cast("int").alias("chunk_count"))
