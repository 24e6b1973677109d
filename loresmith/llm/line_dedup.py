"""Remove repeated passages by overlapping windows of three lines (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loresmith.llm.common import packed, text_of, unpacked
from loresmith.session import written

WINDOW = 3


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Packed rows with their id, a hash of the text (rows that share an id but not the text stay apart) and their lines."""
    body = text_of(docs, text)
    return docs.select(
        packed(docs).alias("row"), F.col(doc_id).alias("id"), F.xxhash64(body).alias("th"), F.split(body, "\n").alias("lines")
    )


def _windows(keyed: DataFrame) -> DataFrame:
    """One row per window: id, th, position of its first line, and 128 bits of hash.  Windows of blank lines are left out."""

    def window(i):
        lines = [F.get("lines", i + k) for k in range(WINDOW)]
        filled = F.length(F.trim(F.concat(*lines))) > 0
        hashed = F.struct(
            i.alias("pos"), F.xxhash64(*lines).alias("h1"), F.xxhash64(F.lit(WINDOW), *lines).alias("h2")
        )
        return F.when(filled, hashed)

    starts = F.sequence(F.lit(0), F.size("lines") - WINDOW)
    made = F.when(F.size("lines") >= WINDOW, F.transform(starts, window))
    exploded = keyed.select("id", "th", F.explode_outer(made).alias("w")).where("w IS NOT NULL")
    return exploded.select("id", "th", "w.pos", "w.h1", "w.h2")


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose text lost every later occurrence of a repeated three-line window.

    Lines end at ``\\n`` and are compared exactly.  Of a window that occurs more than once, the occurrence with the smallest
    (id, text hash, position), nulls first, stays; all lines that any other occurrence covers are removed, once, however
    many windows cover them.  A document of fewer than three lines has no window and stays as it is; so do null texts.
    Windows whose three lines hold spaces only never count.  Rows equal in id and text are one document and are treated
    alike.  Adds ``n_lines`` and ``n_removed``; an input column of one of these names is replaced.
    """
    keyed = _keyed(docs, text, doc_id)
    repeated = _windows(keyed).groupBy("h1", "h2").agg(
        F.min(F.struct("id", "th", "pos")).alias("first"), F.max(F.struct("id", "th", "pos")).alias("last")
    )
    # Written, so that its size is known: the join below is a broadcast if small, else adaptive execution splits hot windows.
    repeated = written(repeated.where("first <> last").select("h1", "h2", "first"), "line-windows")
    later = _windows(keyed).join(repeated, ["h1", "h2"]).where(F.struct("id", "th", "pos") != F.col("first"))
    covered = later.groupBy("id", "th").agg(F.collect_set("pos").alias("starts"))
    covered = covered.select(F.col("id").alias("cid"), F.col("th").alias("cth"), "starts")
    rows = keyed.join(covered, keyed["id"].eqNullSafe(covered["cid"]) & (keyed["th"] == covered["cth"]), "left")
    removed = F.array_distinct(F.flatten(F.transform("starts", lambda p: F.transform(
        F.sequence(F.lit(0), F.lit(WINDOW - 1)), lambda k: p + k))))
    rows = rows.withColumn("removed", removed)
    stays = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "removed")
    kept = F.transform(stays, lambda i: F.get("lines", i))
    cleaned = F.when(F.col("removed").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col(f"row.{text}").cast("string"))
    return rows.select(*unpacked(
        "row", docs, **{text: cleaned}, n_lines=F.size("lines"), n_removed=F.coalesce(F.size("removed"), F.lit(0))
    ))


DEDUP_SQL = f"""
WITH d AS (SELECT *, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
starts AS (SELECT doc_id, text, lines, unnest(range(1, len(lines) - {WINDOW - 2})) AS pos FROM d WHERE len(lines) >= {WINDOW}),
windows AS (SELECT doc_id, pos, array_to_string(lines[pos : pos + {WINDOW - 1}], chr(10)) AS body FROM starts),
filled AS (SELECT * FROM windows WHERE length(trim(replace(body, chr(10), ''))) > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, pos) AS nth FROM filled),
gone AS (SELECT DISTINCT doc_id, pos + k AS line FROM ranked, range(0, {WINDOW}) AS r(k) WHERE nth > 1),
lists AS (SELECT doc_id, list(line) AS removed FROM gone GROUP BY doc_id)
SELECT doc_id,
       CASE WHEN removed IS NULL THEN text ELSE coalesce(array_to_string(
         [x.l for x in list_transform(lines, lambda l, i: {{'l': l, 'i': i}}) if NOT list_contains(removed, x.i)], chr(10)), '')
       END AS text,
       lang, source, n_chars, len(lines)::INT AS n_lines, coalesce(len(removed), 0)::INT AS n_removed
FROM d LEFT JOIN lists USING (doc_id)"""
