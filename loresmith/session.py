"""Session helpers: shared scratch folder, lineage cuts and the size check that guards every broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_MAX_BYTES = 64 << 20
BROADCAST_MAX_ROWS = 2_000_000
SPREAD_MAX_BYTES_PER_CORE = 16 << 20
_OWN_FOLDERS: dict[str, str] = {}  # per application, only where the session names no shared folder


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    A folder of our own is made only in local mode, where one machine runs everything; a cluster has to name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not base:
        base = _OWN_FOLDERS.get(spark.sparkContext.applicationId) or tempfile.mkdtemp(prefix="loresmith-")
        _OWN_FOLDERS[spark.sparkContext.applicationId] = base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by writing a table to the shared folder and reading it back."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_and_counted(df: DataFrame, name: str, counts: dict[str, Column]) -> tuple[DataFrame, dict]:
    """``written``, with aggregates of the rows taken while they are written, so that the table is not read for them.

    They are observed in the stage that writes, where a task that is run again counts once.
    """
    spark, seen = df.sparkSession, Observation()
    path = scratch_dir(spark, name)
    df.observe(seen, *[c.alias(n) for n, c in counts.items()]).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread an input with fewer splits than cores (a small file is one row group, so one task).

    Decided on the plan's size in bytes; an input large enough to have splits of its own is returned unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= cores * SPREAD_MAX_BYTES_PER_CORE:
        return df
    return df.repartition(cores, *keys)


def _width(field: T.StructField) -> Column:
    """Bytes of a value: fixed for plain types, measured for strings and arrays, by its JSON for anything nested."""
    value, kind = F.col("`" + field.name.replace("`", "``") + "`"), field.dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(value)
    elif isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)):
        size = F.size(value) * 8
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        size = F.octet_length(F.to_json(F.struct(value.alias("v"))))
    else:
        return F.lit(8)
    return F.coalesce(size, F.lit(8)).cast("long")


def fits_broadcast(
    df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES, max_rows: int = BROADCAST_MAX_ROWS
) -> bool:
    """Measure ``df`` by partial sums (no row leaves its task) and say whether it is safe to broadcast."""
    width = sum((_width(f) for f in df.schema.fields), F.lit(16))
    size = df.agg(F.count("*").alias("n"), F.sum(width).alias("b")).first()
    return size["n"] <= max_rows and (size["b"] or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Hint a broadcast when the measured size allows it; otherwise leave the join to a shuffle (AQE splits skew)."""
    return F.broadcast(df) if fits_broadcast(df, max_bytes) else df
