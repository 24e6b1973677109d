"""Shards of bounded size by extendible hashing.

The directory is indexed by leading bits of a hash of the row.  A bucket is split on one more bit only while it is over
the byte limit, so a shard is the shortest prefix whose rows fit.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loresmith.llm.common import packed, text_of, unpacked
from loresmith.session import written

LIMIT_BYTES = 64 << 20
TASK_BYTES = 1 << 30  # text that a task of clustered shards has, about
ROW_BYTES = 32  # counted for each row besides its text
HASH_BITS = 60
FINER_BITS = 4  # the first directory has about 2 ** FINER_BITS cells per shard
STEP_BITS = 8


def _directory(keys: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """cell (first ``high`` bits) -> depth of its shard between ``low`` and ``high``; null where the cell is over the limit."""
    cells = keys.groupBy(F.shiftright("h", HASH_BITS - high).alias("cell")).agg(
        F.sum("bytes").alias("bytes"), F.sum("n").alias("n")
    )
    above = cells.select("cell", "bytes", "n", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
    above = above.withColumn("prefix", F.expr(f"shiftright(cell, {high} - depth)"))
    sums = above.groupBy("depth", "prefix").agg(F.sum("bytes").alias("b"), F.sum("n").alias("m"))
    fitting = sums.where((F.col("b") <= limit) | (F.col("m") == 1)).select("depth", "prefix", F.lit(True).alias("fits"))
    found = above.select("cell", "depth", "prefix").join(fitting, ["depth", "prefix"], "left")
    return found.groupBy("cell").agg(F.min(F.when(F.col("fits"), F.col("depth"))).alias("depth"))


def shard(
    docs: DataFrame, limit: int = LIMIT_BYTES, text: str = "text", doc_id: str = "doc_id", cluster: bool = True
) -> DataFrame:
    """Rows of ``docs`` with ``shard_id`` (``s`` and the bits of the prefix) and ``row_bytes``.

    ``row_bytes`` is the UTF-8 length of the text plus 32.  The rows of a shard sum to ``limit`` at most; a single row
    over the limit is a shard of its own.  With ``cluster`` the rows of a shard lie in one partition, ready to be written.
    Null ids and texts count as empty.  Rows equal in id and text can't be told apart by bits: where such a group alone is
    over the limit its rows are counted and dealt out by number (``s<bits>-<row hash>-<part>``), without gathering
    them.  An input column named ``shard_id`` or ``row_bytes`` is replaced.  Empty input gives an empty result.
    """
    identity = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), text_of(docs, text))
    h = F.conv(F.substring(F.md5(identity), 1, HASH_BITS // 4), 16, 10).cast("long")
    size = (F.octet_length(text_of(docs, text)) + ROW_BYTES).cast("long")
    rows = docs.select(packed(docs).alias("row"), h.alias("h"), size.alias("size"))
    # One light row per distinct hash; equal rows are summed before the shuffle.
    keys = written(rows.groupBy("h").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "shard-keys")
    total = keys.agg(F.sum("bytes")).first()[0] or 0

    low, high = 0, min(HASH_BITS, max(0, math.ceil(math.log2(max(1, total) / limit))) + FINER_BITS)
    depths, rest = [], keys
    while True:
        directory = written(_directory(rest, low, high, limit), "shard-directory")
        # Read from a written table: broadcast where the planner sees that it is small, else joined through a shuffle.
        known = directory.where("depth IS NOT NULL").select(F.col("cell").alias(f"c{high}"), F.col("depth").alias(f"d{high}"))
        rows = rows.join(known, F.shiftright("h", HASH_BITS - high) == F.col(f"c{high}"), "left").drop(f"c{high}")
        depths.append(F.col(f"d{high}"))
        over = directory.where("depth IS NULL").select(F.col("cell").alias("over"))
        if over.isEmpty() or high == HASH_BITS:
            break
        rest = rest.join(over, F.shiftright("h", HASH_BITS - high) == F.col("over"), "left_semi")
        low, high = high + 1, min(HASH_BITS, high + STEP_BITS)

    depth = F.coalesce(*depths)
    rows = rows.select("row", "h", "size", depth.cast("int").alias("depth"))
    name = F.concat(F.lit("s"), F.expr(f"right(lpad(bin(shiftright(h, {HASH_BITS} - depth)), {HASH_BITS}, '0'), depth)"))
    placed = rows.where("depth IS NOT NULL").select("row", "size", name.alias("shard"))
    if not over.isEmpty():
        equal = rows.where("depth IS NULL").groupBy("row", "h", "size").agg(F.count("*").alias("n"))
        # Equal rows are interchangeable: keep one, count, and number the copies again.
        per_part = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("size")))
        dealt = equal.select("row", "h", "size", per_part.alias("per"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
        part = F.concat(
            F.lit("s"), F.lpad(F.bin("h"), HASH_BITS, "0"), F.lit("-"), F.hex(F.xxhash64("row")), F.lit("-"),
            F.floor(F.col("i") / F.col("per")).cast("string"),
        )
        placed = placed.unionByName(dealt.select("row", "size", part.alias("shard")))
    if cluster:
        # As many tasks as the bytes that the directory has counted ask for, where that is more than the session's number.
        tasks = math.ceil(total / TASK_BYTES)
        more = [tasks] if tasks > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
        placed = placed.repartition(*more, "shard")
    return placed.select(*unpacked("row", docs, shard_id=F.col("shard"), row_bytes=F.col("size")))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard below ``path``; the rows of a clustered shard make one file."""
    sharded.write.partitionBy("shard_id").mode("overwrite").parquet(path)


def shard_sql(limit: int = LIMIT_BYTES, deepest: int = 24) -> str:
    """The same as SQL, where no prefix of ``deepest`` bits is over the limit."""
    return f"""
WITH hashed AS (
  SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h,
         strlen(coalesce(text, '')) + {ROW_BYTES} AS row_bytes FROM documents),
prefixes AS (SELECT h, row_bytes, d, h >> ({HASH_BITS} - d) AS prefix FROM hashed, range(0, {deepest + 1}) AS r(d)),
fitting AS (SELECT d, prefix FROM prefixes GROUP BY d, prefix HAVING sum(row_bytes) <= {limit} OR count(*) = 1),
depths AS (SELECT p.h, min(p.d) AS depth FROM prefixes p JOIN fitting f ON f.d = p.d AND f.prefix = p.prefix GROUP BY p.h)
SELECT doc_id, text, lang, source, n_chars,
       's' || right(lpad(bin(x.h >> ({HASH_BITS} - depth)), {HASH_BITS}, '0'), depth::INT) AS shard_id, row_bytes
FROM hashed x JOIN depths USING (h)"""
