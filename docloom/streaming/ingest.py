"""Continuous ingestion of a folder and windows over event streams, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.operators import ingestion
from docloom.params import Params
from docloom.sources.files import with_route

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def watch_folder(spark: SparkSession, folder: str, table_dir: str, checkpoint: str, params: Params | None = None, embed: Callable | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Ingest files as they appear under ``folder`` into the tables documents, chunks, links, images and stats of ``table_dir``.

    Each micro-batch skips contents that the documents table holds. A batch that is run again writes the same files under
    its number in place of the first try's, so nothing is counted twice. Default trigger: what is there now, then stop.
    """
    params = params or Params.from_conf(spark)
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(folder)

    def one(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        known = _table(s, table_dir, "documents")
        if known is not None:
            known = known.where(F.col("batch") != number)
        out = ingestion.ingest(with_route(batch.select("path", "length", "content")), known, params, embed, ingestion._uri(folder))
        for name in ("documents", "chunks", "links", "images", "stats"):
            getattr(out, name).write.mode("overwrite").parquet(f"{table_dir}/{name}/batch={number}")

    return files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _table(spark: SparkSession, table_dir: str, name: str) -> DataFrame | None:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{table_dir}/{name}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.parquet(f"{table_dir}/{name}")


def windowed(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str | None = "2 hours") -> DataFrame:
    """(start, end, event_type, events, users, value) by time window of (ts, event_type, user_id, value).

    The same plan serves tables and streams; on a stream ``late`` is the watermark.
    """
    e = events.withWatermark("ts", late) if events.isStreaming and late else events
    users = F.approx_count_distinct("user_id") if events.isStreaming else F.count_distinct("user_id")
    w = e.groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("events"), users.alias("users"), F.round(F.sum("value"), 4).alias("value"))
    return w.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "events", "users", "value")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, end, events): runs of a user's events without a gap of that length."""
    s = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events"))
    return s.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def job_states(log: DataFrame) -> DataFrame:
    """A stream of job rows reduced to the latest of each (id, status, processed_files, failed_files), in update mode."""
    return log.groupBy("id").agg(*[F.max_by(c, "updated_at").alias(c) for c in ("status", "processed_files", "failed_files")])
