"""Ingestion jobs as a table: the latest state of each, lists and the next to run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(jobs: DataFrame) -> DataFrame:
    """One row a job: the one updated last; later creation, then status, decide ties."""
    columns = [F.col(c) for c in jobs.columns if not jobs.schema[c].dataType.simpleString().startswith("map")]
    return jobs.where("id IS NOT NULL").groupBy("id").agg(F.max_by(F.struct(*jobs.columns), F.struct(F.coalesce("updated_at", "created_at").alias("at"), "created_at", "status", F.hash(*columns))).alias("j")).select("j.*")


def listed(jobs: DataFrame, limit: int = 50, status: str | None = None) -> DataFrame:
    """The newest ``limit`` (1 to 200) jobs, of a status if one is given."""
    j = latest(jobs)
    return (j.where(F.col("status") == status) if status else j).orderBy(F.desc("created_at"), "id").limit(max(1, min(limit, 200)))


def next_pending(jobs: DataFrame) -> DataFrame:
    """The oldest pending job that isn't to be canceled: none or one row."""
    return latest(jobs).where("status = 'pending' AND NOT coalesce(cancel_requested, false)").orderBy("created_at", "id").limit(1)


def progress(jobs: DataFrame) -> DataFrame:
    """(status, jobs, total_files, processed_files, failed_files, seconds): totals of each status."""
    seconds = F.unix_timestamp("finished_at") - F.unix_timestamp("started_at")
    return latest(jobs).groupBy("status").agg(F.count("*").alias("jobs"), *[F.sum(F.coalesce(c, F.lit(0)).cast("bigint")).alias(c) for c in ("total_files", "processed_files", "failed_files")], F.sum(seconds).alias("seconds"))
