"""Dates written inside names and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loresmith.functions.lookup import let

# --- fixed values: the four written forms, tried in this order ---------------------------------------------------
FULL_KOREAN = r"(\d{4})\s*년\s*(\d{1,2})\s*월\s*(\d{1,2})\s*일"
NUMERIC = r"(?<!\d)(20\d{2})[-/_.\s](\d{1,2})[-/_.\s](\d{1,2})(?!\d)"
MONTH_DAY_KOREAN = r"(\d{1,2})\s*월\s*(\d{1,2})\s*일"
MONTH_DAY = r"(?<!\d)(\d{1,2})/(\d{1,2})(?!\d)"
LINE_BREAK = "\r\n|\n|\r"


def _date(year: Column, month: Column, day: Column) -> Column:
    """A calendar date, or null when there is no such day."""
    iso = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when(month != "", F.try_to_date(iso, "yyyy-MM-dd"))


def _full(text: Column, pattern: str) -> Column:
    y, m, d = (F.regexp_extract(text, pattern, i) for i in (1, 2, 3))
    return F.struct(_date(y, m, d).alias("d"), F.regexp_extract(text, pattern, 0).alias("t"))


def _yearless(text: Column, pattern: str, year: int) -> Column:
    m, d = (F.regexp_extract(text, pattern, i) for i in (1, 2))
    return F.struct(_date(F.lit(f"{year:04d}"), m, d).alias("d"), F.regexp_extract(text, pattern, 0).alias("t"))


def find_date(text: Column, default_year: int) -> Column:
    """struct(d date, t text) of the first form that gives a real date, or null."""

    def first_form(t: Column) -> Column:
        forms = (
            _full(t, FULL_KOREAN),
            _full(t, NUMERIC),
            _yearless(t, MONTH_DAY_KOREAN, default_year),
            _yearless(t, MONTH_DAY, default_year),
        )
        return F.get(F.filter(F.array(*forms), lambda f: f["d"].isNotNull()), F.lit(0))

    return let(text, first_form)


def head_lines(text: Column, n: int = 20) -> Column:
    return F.array_join(F.slice(F.split(text, LINE_BREAK), 1, n), "\n")


def document_date(file_name: Column, content: Column, default_year: int) -> Column:
    """struct(document_date, date_text, date_source): the name first, then the first 20 lines."""
    places = ((find_date(file_name, default_year), "file_name"), (find_date(head_lines(content), default_year), "content_title"))
    found = F.filter(
        F.array(*[F.struct(f.alias("f"), F.lit(where).alias("w")) for f, where in places]),
        lambda x: x["f"]["d"].isNotNull(),
    )
    none = F.struct(
        F.struct(F.lit(None).cast("date").alias("d"), F.lit(None).cast("string").alias("t")).alias("f"),
        F.lit("unknown").alias("w"),
    )
    return F.transform(
        F.slice(F.concat(found, F.array(none)), 1, 1),
        lambda x: F.struct(
            x["f"]["d"].alias("document_date"), x["f"]["t"].alias("date_text"), x["w"].alias("date_source")
        ),
    )[0]
