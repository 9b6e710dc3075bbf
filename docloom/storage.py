"""Reading tables, spreading scans and cutting lineage with tables in the shared folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a side of a join that are broadcast at most.
BROADCAST_BYTES = 64 << 20

_KEPT: set[str] = set()
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session's application, once; they may run where it isn't installed."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "docloom.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Only a local session, as in tests, gets a temporary folder of its own where it is unset; a cluster must name one.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def written(df: DataFrame, name: str = "work", partition_by: list[str] | None = None, **options: str) -> DataFrame:
    """``df`` as a parquet table in the shared folder: later reads survive lost executors and recompute nothing.

    The table is deleted when the session's program ends, or by ``clear``. ``options`` are those of the writer.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docloom-{name}-{uuid.uuid4().hex}"
    writer = df.write.options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _KEPT.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_docloom_path"] = path
    return out


def clear(spark: SparkSession) -> None:
    """Delete the tables that ``written`` made; results that still read them must be written first."""
    for path in list(_KEPT):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _KEPT.discard(path)


@atexit.register
def _clear() -> None:
    spark = SparkSession.getActiveSession()
    try:
        if spark is not None and spark.sparkContext._jsc is not None:
            clear(spark)
    except Exception:  # noqa: BLE001 - the session may be gone; local folders are removed below
        pass
    for path in _KEPT:
        local = path.removeprefix("file://")
        if path.startswith("file://") and os.path.basename(local).startswith("docloom-"):
            shutil.rmtree(local, ignore_errors=True)


def spread(df: DataFrame) -> DataFrame:
    """Round-robin ``df`` over the cluster where its scan has fewer partitions than there are cores (few small files).

    On large inputs the scan already has more partitions and nothing is shuffled. Only for scans, filters and projections:
    asking a plan with a shuffle for its partitions would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` partitioned by ``keys`` for all that follows: windows, groups and joins on them shuffle no more.

    The number of partitions is left to the session, so adaptive execution may merge small ones and split others.
    """
    return df.repartition(*keys)


def _bytes(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 8
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.aggregate(c, F.lit(0).cast("bigint"), lambda n, x: n + _bytes(x, kind.elementType)), F.lit(0)) + 16
    if isinstance(kind, T.StructType):
        return reduce(Column.__add__, [_bytes(c[f.name], f.dataType) for f in kind.fields], F.lit(8))
    return F.lit(8)


def bytes_of(df: DataFrame) -> int:
    """The bytes that the rows of ``df`` hold, summed on the executors."""
    row = reduce(Column.__add__, [_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields], F.lit(16))
    return df.agg(F.sum(row.cast("bigint"))).first()[0] or 0


def small_side(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` for one side of a join: with a broadcast hint if its rows hold at most ``max_bytes``, else for a shuffled join.

    A plan that isn't a table yet is written first, so measuring it computes nothing twice.
    """
    kept = df if "_docloom_path" in df.__dict__ else written(df, "small-side")
    return F.broadcast(kept) if bytes_of(kept) <= max_bytes else kept


def skewed_join(left: DataFrame, right: DataFrame, on: list[str], salts: int = 16, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Inner join of ``left``, of whose keys one may hold any part of the rows, with ``right``, which has few rows a key.

    A small ``right`` is broadcast. Otherwise each of its rows is sent ``salts`` times and each key of ``left`` is spread
    over as many tasks, chosen by a hash of the row.
    """
    kept = small_side(right, max_bytes)
    if kept._jdf.queryExecution().logical().getClass().getSimpleName() == "UnresolvedHint":
        return left.join(kept, on)
    rest = [c for c in left.columns if c not in on]
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*(rest or on)), F.lit(salts)))
    return salted.join(kept.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))), [*on, "_salt"]).drop("_salt")
