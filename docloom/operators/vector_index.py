"""An inverted-file index of vectors: cells around centers, searched cell by cell."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.storage import spread

#: Vectors that the centers are fitted on.
SAMPLE = 20_000


def centers_of(vectors: DataFrame, cells: int, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, rounds: int = 12) -> np.ndarray:
    """Unit centers by spherical k-means over a bounded sample (by a hash of the ids); fewer vectors give fewer centers."""
    ids = vectors.where(f"{id_col} IS NOT NULL AND size({vector_col}) > 0").select(id_col).distinct().orderBy(F.xxhash64(id_col), id_col).limit(sample)
    rows = vectors.join(F.broadcast(ids), id_col).select(F.col(vector_col).cast("array<double>").alias("v")).limit(sample).toPandas()["v"]
    x = np.array([v for v in rows if len(v) == len(rows.iloc[0])], dtype=float).reshape(len(rows) and -1, len(rows.iloc[0]) if len(rows) else 0)
    norm = np.linalg.norm(x, axis=1)
    x = x[norm > 0] / norm[norm > 0, None]
    x = x[np.lexsort(x.T[::-1])] if len(x) else x
    c = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)] if len(x) else x
    for _ in range(rounds if len(x) else 0):
        nearest = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, nearest, x)
        size = np.linalg.norm(total, axis=1)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1e-12)[:, None], c)
    return c


def with_cells(vectors: DataFrame, centers: np.ndarray, probes: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id_col, cell, v): every vector under its ``probes`` nearest centers, ``v`` of unit length; zero vectors have no cell."""
    sent = vectors.sparkSession.sparkContext.broadcast(centers)  # cells times dimensions, whatever the number of vectors
    kind = vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            keep = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False) & (sizes == c.shape[1])) if len(c) else np.zeros(0, dtype=int)
            if not len(keep):
                continue
            values = lists.values.to_numpy(zero_copy_only=False)
            x = values[lists.offsets.to_numpy()[:-1][keep][:, None] + np.arange(c.shape[1])[None, :]]
            norm = np.linalg.norm(x, axis=1)
            good = np.isfinite(norm) & (norm > 0)
            keep, x = keep[good], x[good] / norm[good, None]
            if not len(keep):
                continue
            k = min(probes, len(c))
            near = np.argpartition(-(x @ c.T), k - 1, axis=1)[:, :k]
            at = np.repeat(np.arange(len(keep)), k)
            flat = x[at]
            ends = np.arange(len(flat) + 1, dtype=np.int32) * x.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep[at])), pa.array(near.reshape(-1).astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.reshape(-1)))], [id_col, "cell", "v"])

    return spread(vectors.where(f"{id_col} IS NOT NULL").select(id_col, F.col(vector_col).cast("array<double>").alias("v"))).mapInArrow(run, f"{id_col} {kind}, cell int, v array<double>")


def search(queries: DataFrame, index: DataFrame, centers: np.ndarray, k: int = 10, probes: int = 8, id_col: str = "vec_id") -> DataFrame:
    """(query_id, id_col, cosine, rank): the ``k`` nearest among the vectors in the ``probes`` cells next to each query.

    ``index`` is ``with_cells`` of all vectors, best stored partitioned by cell. Queries meet only the vectors of their cells.
    """
    q = with_cells(queries, centers, probes, "query_id").withColumnRenamed("v", "q")
    dot = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    found = index.join(q, "cell").select("query_id", id_col, dot.alias("cosine")).dropDuplicates(["query_id", id_col])
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 9)), id_col)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """(queries, recall): the part of the exact neighbours that ``found`` holds."""
    hit = exact.join(found.select("query_id", id_col, F.lit(1).alias("hit")), ["query_id", id_col], "left")
    return hit.agg(F.count_distinct("query_id").alias("queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
