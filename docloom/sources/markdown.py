"""Markdown as typed blocks. A text is one row: its lines are read as an array, so nothing is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from docloom.functions import text as T

#: What tells tables, fences and navigation apart.
SEPARATOR = r"^\s*\|?\s*:?-{3,}"
RULE = r"^\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?\s*$"
FRONT = r"(?s)\A---\n(.*?\n)?[ \t]*---[ \t]*(?:\n|\z)"
NAVIGATION = "previous next printer print welcome contents".split()
HEADING = r"^#{1,6}\s+(.+)$"
#: Characters of a table that don't count for its length, and the length below which one with navigation words is navigation.
TABLE_MARKS = r"[|\-:\s\[\]()_./]+"
NAVIGATION_CHARS = 80


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n", "\n")


def front_matter(text: Column) -> Column:
    """The lines between the fences at the very beginning of a text; empty where there are none."""
    return F.regexp_extract(unix_lines(text), FRONT, 1)


def unquoted(value: Column) -> Column:
    v = T.sanitize(value)
    return F.when(v.rlike("(?s)^(?:'.*'|\".*\")$") & (F.length(v) >= 2), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)


def front_matter_fields(text: Column) -> Column:
    """Front matter as ``map<string, array<string>>``: one value, the values of ``[a, b]``, or those of indented ``- a`` lines.

    Comments and lines without a colon don't count; a key given again keeps its last values.
    """
    lines = F.filter(F.split(front_matter(text), "\n"), lambda x: ~x.rlike(r"^\s*(?:#.*)?$"))
    entry = "struct<key:string,values:array<string>>"
    start = F.array().cast(f"array<{entry}>")

    def step(out, x):
        item = x.rlike(r"^[ \t]+")
        last = F.element_at(out, -1)
        grown = F.struct(last["key"].alias("key"), F.concat(last["values"], F.array(unquoted(F.regexp_replace(x, r"^\s+- ", "")))).alias("values")).cast(entry)
        key, value = T.sanitize(F.substring_index(x, ":", 1)), F.trim(F.regexp_replace(x, r"^[^:]*:", ""))
        listed = F.transform(F.filter(F.split(F.regexp_replace(value, r"^\[|\]$", ""), ","), lambda v: F.trim(v) != ""), lambda v: unquoted(F.trim(v)))
        values = F.when(value == "", F.array().cast("array<string>")).when(value.rlike(r"(?s)^\[.*\]$"), listed).otherwise(F.array(unquoted(value)))
        new = F.struct(key.alias("key"), values.alias("values")).cast(entry)
        return (
            F.when(item & (F.size(out) > 0) & x.rlike(r"^\s+- "), F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(grown)))
            .when(item | ~F.contains(x, F.lit(":")), out)
            .otherwise(F.concat(F.filter(out, lambda e: e["key"] != key), F.array(new)))
        )

    return F.map_from_entries(F.aggregate(lines, start, step))


def breadcrumbs(fields: Column) -> Column:
    """The path of a document: listed values, or one value parted at ``>`` or else ``/``."""
    values = F.coalesce(fields["breadcrumbs"], F.array().cast("array<string>"))
    one = F.get(values, F.lit(0))
    parts = F.when(F.contains(one, F.lit(">")), F.split(one, ">")).otherwise(F.split(one, "/"))
    clean = lambda a: F.filter(F.transform(a, T.sanitize), lambda x: x != "")
    return F.when(F.size(values) == 1, clean(parts)).otherwise(clean(values))


def is_breadcrumb_only(line: Column) -> Column:
    """Two links or more with nothing but ``>`` between them."""
    plain = F.regexp_replace(F.regexp_replace(line, r"\[[^\]]+]\([^)]+\)", ""), r"\[[^\]]+]", "")
    return F.contains(line, F.lit(">")) & (F.regexp_count(line, F.lit(r"\[[^\]]+]\([^)]+\)|\[[^\]]+]")) >= 2) & (F.trim(F.translate(plain, ">", "")) == "")


def lines_of(text: Column) -> Column:
    """The lines of a text after its front matter, without image and breadcrumb lines, as structs.

    ``line`` is sanitized, ``head`` the text of a heading or null; for lines with a bar ``row`` has their cells (null without
    any), ``bare`` their lower case without marks, ``rule`` tells whether a table's head stands above.
    """
    raw = F.split(F.regexp_replace(unix_lines(text), FRONT, ""), "\n", -1)

    def read(r):
        return T.let(T.sanitize(r), lambda x: parts(r, x))

    def parts(r, x):
        bar = F.contains(r, F.lit("|"))
        cells = F.filter(F.transform(F.split(F.regexp_replace(F.trim(r), r"^\|+|\|+$", ""), r"\|"), T.sanitize), lambda c: c != "")
        row = T.let(cells, lambda c: F.when(~r.rlike(RULE) & (F.size(c) > 0), F.array_join(c, " | ")))
        return F.struct(
            (T.is_image_line(x) | is_breadcrumb_only(x)).alias("skip"), x.alias("line"), F.nullif(T.sanitize(F.regexp_extract(x, HEADING, 1)), F.lit("")).alias("head"),
            bar.alias("bar"), F.when(bar, row).alias("row"), F.when(bar, F.lower(r)).alias("low"), r.rlike(SEPARATOR).alias("rule"),
        )

    return F.filter(F.transform(raw, read), lambda x: ~x["skip"])


def grouped(lines: list[dict], title: str | None) -> list[dict]:
    """Blocks (block_no, text, heading, kind) of the lines of one text.

    A table begins with a line with a bar above a rule and goes on as long as lines have bars. Lines of one kind are one
    block; a heading is a block of its own and names those after it.
    """
    out: list[dict] = []
    number, before, heading, in_table = 0, None, title, False
    for i, x in enumerate(lines):
        in_table = x["bar"] and (in_table or (i + 1 < len(lines) and lines[i + 1]["rule"]))
        kind = "table" if in_table else "heading" if x["head"] is not None else "blank" if x["line"] == "" else "paragraph"
        if kind == "heading":
            heading = x["head"]
        if kind == "heading" or kind != before:
            number += 1
            out.append({"block_no": number, "parts": [], "low": [], "heading": heading, "kind": kind})
        before = kind
        out[-1]["parts"].append(x["row"] if kind == "table" else x["head"] if kind == "heading" else x["line"])
        out[-1]["low"].append(x["low"])
    return out


def block_lists(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", title_col: str = "title") -> DataFrame:
    """(id_col, md): the blocks (block_no, text, heading, kind) of each row's markdown text, in order.

    ``kind`` is title, heading, table or paragraph. Image lines, breadcrumb lines and tables of navigation are left out. A
    row without a title has no title block; a null text has no row.
    """
    given = documents.where(F.col(text_col).isNotNull()).select(id_col, F.col(title_col).alias("title"), lines_of(F.col(text_col)).alias("lines"))
    fields = [("block_no", pa.int32()), ("text", pa.string()), ("low", pa.string()), ("heading", pa.string()), ("kind", pa.string())]
    schema = ST.StructType([documents.schema[id_col], ST.StructField("title", ST.StringType()), ST.StructField("md", ST._parse_datatype_string("array<struct<block_no:int,text:string,low:string,heading:string,kind:string>>"))])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for title, lines in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                blocks_ = [b for b in grouped(lines, title) if b["kind"] != "blank"]
                lists.append([{**b, "text": "\n".join(x for x in b["parts"] if x is not None).strip(), "low": "\n".join(b["low"]) if b["kind"] == "table" else None} for b in blocks_])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([[{n: b[n] for n, _ in fields} for b in x] for x in lists], pa.list_(pa.struct(fields)))], [id_col, "title", "md"])

    navigation = lambda b: F.coalesce(b["low"].rlike("|".join(NAVIGATION)) & (F.length(F.regexp_replace(b["low"], TABLE_MARKS, "")) < NAVIGATION_CHARS), F.lit(False))
    kept = F.filter("md", lambda b: (b["text"] != "") & ~navigation(b))
    plain = F.transform(kept, lambda b: F.struct(b["block_no"].alias("block_no"), b["text"].alias("text"), b["heading"].alias("heading"), b["kind"].alias("kind")))
    first = F.struct(F.lit(0).alias("block_no"), T.sanitize(F.col("title")).alias("text"), F.col("title").alias("heading"), F.lit("title").alias("kind"))
    titled = F.when(T.sanitize(F.col("title")) != "", F.concat(F.array(first), plain)).otherwise(plain)
    return given.mapInArrow(fold, schema).select(id_col, titled.alias("md"))


def blocks(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", title_col: str = "title") -> DataFrame:
    """(id_col, block_no, text, heading, kind): one row for each block of ``block_lists``."""
    return block_lists(documents, id_col, text_col, title_col).select(id_col, F.explode("md").alias("b")).select(id_col, "b.*")


def as_chunk_blocks(lists: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, blocks) of ``block_lists`` as the chunker takes them."""

    def one(b):
        names = b["kind"].isin("title", "heading")
        none = F.lit(None).cast("string")
        return F.struct(b["text"].alias("text"), F.when(names, b["text"]).otherwise(b["heading"]).alias("heading"), F.when(names, "heading 1").otherwise(none).alias("style"), F.when(b["kind"] == "table", "table").otherwise(none).alias("html_tag"))

    return lists.select(id_col, F.transform("md", one).alias("blocks"))
