"""Sizes of images from the headers of their files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dimensions(head: bytes) -> tuple[int | None, int | None]:
    """(width, height) of a PNG, GIF, BMP or JPEG; (None, None) for anything else or a broken file.

    The segments of a JPEG are followed to its frame, however far behind its metadata that stands.
    """
    try:
        if head[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", head[16:24])
        if head[:6] in (b"GIF87a", b"GIF89a"):
            return struct.unpack("<HH", head[6:10])
        if head[:2] == b"BM":
            width, height = struct.unpack("<ii", head[18:26])
            return width, abs(height)
        if head[:2] == b"\xff\xd8":
            at = 2
            while at + 9 < len(head):
                marker, size = head[at + 1], struct.unpack(">H", head[at + 2 : at + 4])[0]
                if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                    height, width = struct.unpack(">HH", head[at + 5 : at + 9])
                    return width, height
                at += 2 + size
    except struct.error:
        pass
    return None, None


def with_dimensions(files: DataFrame) -> DataFrame:
    """(path, width, height) of files (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [dimensions(memoryview(c.as_buffer()).cast("B") if c.is_valid else b"") for c in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([s[i] for s in sizes], pa.int32()) for i in (0, 1)]], ["path", "width", "height"])

    return files.select("path", "content").mapInArrow(run, "path string, width int, height int")
