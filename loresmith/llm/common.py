"""Helpers shared by the pipeline operators: whole rows as one struct, fold of labelled rows, table reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOWER_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER_TO = LOWER_FROM.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def packed(docs: DataFrame) -> Column:
    """All columns of a row as one struct, so that helper columns never clash with the input's own."""
    return F.struct(*[F.col(quoted(c)).alias(c) for c in docs.columns])


def unpacked(row: str, docs: DataFrame, **replaced: Column) -> list[Column]:
    """The columns of a packed row again; ``replaced`` gives new values or, for names the row lacks, further columns."""
    kept = [replaced.pop(c).alias(c) if c in replaced else F.col(f"{row}.{quoted(c)}").alias(c) for c in docs.columns]
    return kept + [value.alias(name) for name, value in replaced.items()]


def text_of(docs: DataFrame, name: str = "text") -> Column:
    """The text column, null as empty."""
    return F.coalesce(docs[name].cast("string"), F.lit(""))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3: rows with remainder 1 are held out of every training.  A null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3


def held_out(doc_id: Column) -> Column:
    return fold(doc_id) == 1


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, LOWER_FROM, LOWER_TO)


BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Hand rows to Python in batches of a few megabytes, however long the texts are; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = spark.conf.get(name, None)
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(given) if given else BATCH_BYTES + 1
    if size <= 0 or size > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
