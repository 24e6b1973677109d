"""Mix sources to target weights by Poisson replication (DataFrame functions only).

Every source gets a mean repetition rate, every row draws a Poisson number with that mean by inverting the distribution
at a uniform number made from a hash of the row, the row is exploded into that many copies, and all copies are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loresmith.llm.common import packed, text_of, unpacked
from loresmith.session import written

ALPHA = 0.5
SEED = "mix-1"
RATE_PER_DRAW = 256  # a larger mean is drawn as a sum of independent Poisson numbers, so exp(-mean) never underflows
HEX_DIGITS = 13  # 52 bits of the hash make the uniform number


def source_rates(
    docs: DataFrame, weights: dict[str, float] | None, alpha: float, epochs: float, source: str, text: str
) -> DataFrame:
    """One row per source: key, mean rate, number of draws and the distribution function of one draw.

    ``rate = epochs * share * all characters / characters of the source``.  Without ``weights`` the shares are tempered:
    proportional to characters ** ``alpha``.  A source that ``weights`` leaves out, or without any character, gets rate 0.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))
    sizes = docs.select(key.alias("source_key"), F.char_length(text_of(docs, text)).alias("size"))
    sizes = written(sizes.groupBy("source_key").agg(F.sum("size").cast("double").alias("size")), "mix-sizes")
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow("size", F.lit(alpha)))
    else:
        listed = [(f"={name}", float(weight)) for name, weight in weights.items()]
        listed = spark.createDataFrame(listed, "source_key string, weight double")
        sizes = sizes.join(listed, "source_key", "left").fillna(0.0, ["weight"])
    whole = sizes.where("size > 0").agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    total, weighed = whole["size"] or 0.0, whole["weight"] or 0.0
    if not weighed:
        rate = F.lit(0.0)
    else:
        rate = F.when(F.col("size") > 0, epochs * F.col("weight") / weighed * total / F.col("size")).otherwise(0.0)
    rates = sizes.select("source_key", rate.alias("rate"))
    rates = rates.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / RATE_PER_DRAW)).cast("int"))
    mean = F.col("rate") / F.col("draws")
    last = F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))

    def further(acc, k):
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    table = F.aggregate(F.sequence(F.lit(1), last), start, further)["cdf"]
    return written(rates.withColumn("cdf", table), "mix-rates")


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    alpha: float = ALPHA,
    epochs: float = 1.0,
    seed: str = SEED,
    source: str = "source",
    text: str = "text",
    doc_id: str = "doc_id",
    marked: bool = True,
) -> DataFrame:
    """Rows of ``docs`` repeated so that each source holds its target share of the characters, in a global random order.

    Adds ``copy`` (from 1) and ``mix_key`` (32 hex digits; a partition holds a random part of all copies, ordered by it).
    An input column of one of these names is replaced; without ``marked`` none is added and the input's own stay.
    A null source is a source of its own and can't be listed.
    Null and empty texts count no characters but are drawn like the other rows of their source.  Rows equal in id and
    text draw the same number; the draw depends on id, text and seed alone, so a repeated task draws again the same.
    Empty input gives an empty result.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))
    identity = F.concat(
        F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), text_of(docs, text)
    )
    rates = source_rates(docs, weights, alpha, epochs, source, text)
    # The identity is hashed once; draws and order keys hash its digest.
    rows = docs.select(packed(docs).alias("row"), key.alias("source_key"), F.md5(identity).alias("digest"))
    # Rates are read from a written table, so the planner knows its size: broadcast if small, else a join that
    # adaptive execution splits where one source is hot.
    drawn = rows.join(rates, "source_key")

    def inverted(total, draw):
        digits = F.substring(F.md5(F.concat("digest", F.lit("#"), draw.cast("string"))), 1, HEX_DIGITS)
        u = F.conv(digits, 16, 10).cast("double") / 16**HEX_DIGITS
        return total + F.size(F.filter("cdf", lambda c: c < u))

    count = F.aggregate(F.sequence(F.lit(1), F.col("draws")), F.lit(0), inverted)
    copies = drawn.where(F.col("rate") > 0).select("row", "digest", count.alias("n")).where("n > 0")
    copies = copies.select("row", "digest", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    order = F.md5(F.concat("digest", F.lit("@"), F.col("copy").cast("string")))
    shuffled = copies.select("row", "copy", order.alias("mix_key")).repartition("mix_key").sortWithinPartitions("mix_key")
    marks = {"copy": F.col("copy"), "mix_key": F.col("mix_key")} if marked else {}
    return shuffled.select(*unpacked("row", docs, **marks))


def mix_sql(alpha: float = ALPHA, seed: str = SEED) -> str:
    """The same with tempered weights as SQL, for sources whose rate needs one draw."""
    return f"""
WITH sizes AS (SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS size FROM documents GROUP BY source),
whole AS (SELECT sum(size) AS total, sum(pow(size, {alpha})) AS weighed FROM sizes WHERE size > 0),
rates AS (SELECT source, CASE WHEN size > 0 THEN pow(size, {alpha}) / weighed * total / size ELSE 0 END AS rate
          FROM sizes, whole),
parts AS (SELECT source, k, exp(CASE WHEN k = 0 THEN 0 ELSE k * ln(rate) END - rate - lgamma(k + 1)) AS p
          FROM rates, range(0, 400) AS r(k) WHERE rate > 0 AND k <= ceil(rate + 12 * sqrt(rate) + 24)),
cdf AS (SELECT source, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM parts),
hashed AS (SELECT *, md5('{seed}:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS digest FROM documents),
drawn AS (SELECT h.*, ('0x' || substr(md5(digest || '#1'), 1, {HEX_DIGITS}))::BIGINT / {16**HEX_DIGITS}.0::DOUBLE AS u
          FROM hashed h),
lists AS (SELECT source, list(c) AS cs FROM cdf GROUP BY source),
counted AS (SELECT d.*, len(list_filter(l.cs, lambda c: c < d.u)) AS n
            FROM drawn d JOIN lists l ON l.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, text, lang, source, n_chars, copy::INT AS copy, md5(digest || '@' || copy::VARCHAR) AS mix_key
FROM (SELECT *, unnest(range(1, n + 1)) AS copy FROM counted)"""
