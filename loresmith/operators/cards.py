"""Cards (normalized documents): model answers parsed, coerced, checked, rendered, searched and turned into chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loresmith import vocab
from loresmith.config import CARDS, CardConfig
from loresmith.functions.text import strip
from loresmith.operators.ordering import running_total

LIST_FIELDS = (
    "prerequisites", "steps", "checkpoints", "cautions", "examples", "related_terms", "open_questions",
    "answer_use_cases",
)
SPAN = "struct<section_title: string, chunk_index: int, summary: string>"
CARD_SCHEMA = (
    "card_id string, card_type string, title string, summary string, source_file_name string, source_file_hash string, "
    "source_category string, source_type string, document_date string, display_date string, primary_topic string, "
    "topic_tags array<string>, task_type string, when_to_use string, prerequisites array<string>, steps array<string>, "
    "checkpoints array<string>, cautions array<string>, examples array<string>, related_terms array<string>, "
    f"open_questions array<string>, evidence_spans array<{SPAN}>, parent_raw_chunk_ids array<string>, "
    "answer_use_cases array<string>, sanitized_markdown string"
)
# --- fixed values: placeholders -----------------------------------------------------------------------------------------
NO_TITLE, NO_ITEM, NO_EVIDENCE = "(제목 없음)", "(없음)", "(근거 없음)"
FENCE = r"(?s)^```[a-zA-Z0-9_-]*\s*\n?(.*?)\n?```\s*$"
ALL = "전체"
SEARCHED = ("steps", "checkpoints", "cautions", "related_terms")


def eligible_for_normalization(category: Column, source_type: Column) -> Column:
    """guide, slack or null."""
    c, s = F.lower(F.trim(F.coalesce(category, F.lit("")))), F.lower(F.trim(F.coalesce(source_type, F.lit(""))))
    return F.when((c == "guide") | (s == "guide"), "guide").when(
        c.isin("slack", "slack_manual") | s.isin("slack", "slack_manual"), "slack"
    )


def normalization_input(sections: DataFrame, cfg: CardConfig = CARDS) -> DataFrame:
    """Per document the leading text of its sections (at most ``max_chars``), first scalars and ordered tags.

    sections(document_id, section_no, content, sanitized_content, topic_tags, todo_phase, parser_format,
    document_date, display_date).  Only sections that start before the cap are ever brought together.
    """
    text = strip(F.coalesce(F.when(strip("sanitized_content") != "", F.col("sanitized_content")), F.col("content"), F.lit("")))
    rows = sections.withColumn("_text", text)
    said = rows.select("document_id", "section_no", "_text").where(F.col("_text") != "")
    said = running_total(said, ["document_id"], "section_no", F.length("_text") + 2, "_upto")
    totals = said.groupBy("document_id").agg((F.max("_upto") - 2).alias("_length"))
    lead = said.where(F.col("_upto") - F.length("_text") - 2 <= cfg.max_chars)
    parts = F.array_sort(F.collect_list(F.struct("section_no", "_text")))
    texts = lead.groupBy("document_id").agg(F.array_join(F.transform(parts, lambda p: p["_text"]), "\n\n").alias("_joined"))
    scalars = ("todo_phase", "parser_format", "document_date", "display_date")
    given = lambda c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col("section_no"))
    facts = rows.groupBy("document_id").agg(*[F.min_by(F.col(c).cast("string"), given(c)).alias(c) for c in scalars])
    tags = rows.select("document_id", "section_no", F.posexplode("topic_tags").alias("_pos", "tag"))
    tags = tags.where(F.trim("tag") != "").groupBy("document_id", "tag").agg(F.min(F.struct("section_no", "_pos")).alias("_at"))
    tags = tags.groupBy("document_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_at", "tag"))), lambda t: t["tag"]).alias("topic_tags")
    )
    joined = facts.join(texts, "document_id", "left").join(totals, "document_id", "left").join(tags, "document_id", "left")
    short = F.concat(F.substring("_joined", 1, cfg.max_chars - 3), F.lit("..."))
    return joined.select(
        "document_id",
        F.when(F.col("_length") > cfg.max_chars, short).otherwise(F.coalesce("_joined", F.lit(""))).alias("text"),
        F.coalesce("topic_tags", F.array().cast("array<string>")).alias("topic_tags"),
        *scalars,
    )


def parse_cards(responses: DataFrame, cfg: CardConfig = CARDS, response_col: str = "response") -> DataFrame:
    """Add parse_status (ok, empty, not_json, not_object, no_cards, cards_not_list) and cards, an array of variants."""
    raw = strip(F.coalesce(F.col(response_col), F.lit("")))
    body = F.when(raw.rlike(FENCE), strip(F.regexp_extract(raw, FENCE, 1))).otherwise(raw)
    rows = responses.withColumn("_body", body)
    rows = rows.withColumn("_json", F.try_parse_json("_body"))
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit(""))
    rows = rows.withColumns(
        {
            "_kind": kind(F.col("_json")),
            "_has": F.expr("variant_get(_json, '$.cards', 'variant')"),
        }
    )
    status = (
        F.when(F.col("_body") == "", "empty")
        .when(F.col("_json").isNull(), "not_json")
        .when(~F.startswith("_kind", F.lit("OBJECT")), "not_object")
        .when(F.col("_has").isNull(), "no_cards")
        .when(~F.startswith(kind(F.col("_has")), F.lit("ARRAY")), "cards_not_list")
        .otherwise("ok")
    )
    rows = rows.withColumn("parse_status", status)
    listed = F.when(F.col("parse_status") == "ok", F.expr("try_variant_get(_has, '$', 'array<variant>')"))
    listed = F.slice(listed, 1, cfg.max_cards) if cfg.max_cards > 0 else listed
    return rows.withColumn("cards", listed).drop("_body", "_json", "_kind", "_has")


def _field(name: str, kind: str = "string", card: str = "card") -> Column:
    return F.expr(f"try_variant_get({card}, '$.{name}', '{kind}')")


def _kind_of(name: str) -> Column:
    return F.coalesce(F.schema_of_variant(_field(name, "variant")), F.lit("VOID"))


def _text(name: str) -> Column:
    return F.coalesce(_field(name), F.lit(""))


def _texts(name: str) -> Column:
    """A list stays a list, a single text becomes one, anything else is empty; blank entries are dropped."""
    kind = _kind_of(name)
    listed = F.when(F.startswith(kind, F.lit("ARRAY")), _field(name, "array<string>"))
    listed = listed.when(kind == "STRING", F.array(_field(name)))
    return F.filter(F.coalesce(listed, F.array().cast("array<string>")), lambda t: strip(t) != "")


def _spans() -> Column:
    """Evidence objects with their alternative names; anything that is not an object is dropped."""
    listed = F.when(F.startswith(_kind_of("evidence_spans"), F.lit("ARRAY")), _field("evidence_spans", "array<variant>"))
    objects = F.filter(listed, lambda s: F.startswith(F.schema_of_variant(s), F.lit("OBJECT")))
    part = lambda s, name: F.nullif(F.try_variant_get(s, f"$.{name}", "string"), F.lit(""))
    span = lambda s: F.struct(
        F.coalesce(part(s, "section_title"), part(s, "section"), F.lit("")).alias("section_title"),
        F.coalesce(F.try_variant_get(s, "$.chunk_index", "int"), F.lit(-1)).alias("chunk_index"),
        F.coalesce(part(s, "quote_or_summary"), part(s, "summary"), part(s, "text"), F.lit("")).alias("summary"),
    )
    return F.coalesce(F.transform(objects, span), F.array().cast(f"array<{SPAN}>"))


def coerce_cards(parsed: DataFrame) -> DataFrame:
    """Parsed cards as typed rows.

    ``parsed`` also carries kind (guide / slack), file_name, file_hash, file_hash_short, source_category, source_type,
    document_date, display_date and input_topic_tags (merged into the tags of slack cards).  A card keeps its number
    even when entries before it are not objects.
    """
    # Only answers that are ok have cards.  A filter on the status would be pushed below and parse the answers there again.
    rows = parsed.select("*", F.posexplode_outer("cards").alias("card_no", "card"))
    rows = rows.where(F.startswith(F.schema_of_variant("card"), F.lit("OBJECT")))
    fallback = F.when(F.col("kind") == "slack", "issue").otherwise("workflow")
    named = F.lower(strip(_text("card_type")))
    own = F.transform(_texts("topic_tags"), strip)
    extra = F.filter(F.transform(F.coalesce("input_topic_tags", F.array().cast("array<string>")), strip), lambda t: t != "")
    rows = rows.withColumn("card_type", F.when(named.isin(*vocab.CARD_TYPES), named).otherwise(fallback))
    short = F.coalesce(F.nullif(strip("file_hash_short"), F.lit("")), F.lit("unknown"))
    return rows.select(
        F.format_string("kc_%s_%03d_%s", short, F.col("card_no"), F.col("card_type")).alias("card_id"),
        "card_type",
        F.coalesce(F.nullif(strip(_text("title")), F.lit("")), F.lit(NO_TITLE)).alias("title"),
        strip(_text("summary")).alias("summary"),
        F.col("file_name").alias("source_file_name"),
        F.col("file_hash").alias("source_file_hash"),
        "source_category", "source_type",
        F.col("document_date").cast("string").alias("document_date"),
        "display_date",
        F.nullif(strip(_text("primary_topic")), F.lit("")).alias("primary_topic"),
        F.when(F.col("kind") == "slack", F.array_union(own, extra)).otherwise(_texts("topic_tags")).alias("topic_tags"),
        F.nullif(strip(_text("task_type")), F.lit("")).alias("task_type"),
        strip(_text("when_to_use")).alias("when_to_use"),
        *[_texts(f).alias(f) for f in LIST_FIELDS],
        _spans().alias("evidence_spans"),
        F.array().cast("array<string>").alias("parent_raw_chunk_ids"),
        F.col("card_no").cast("long").alias("card_no"),
    ).withColumn("sanitized_markdown", render_markdown())


def render_markdown() -> Column:
    """A card row as markdown (fixed layout)."""
    dash = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "-").otherwise(c)

    def bullets(name: str) -> Column:
        listed = F.transform(name, lambda x: F.concat(F.lit("- "), x))
        return F.when(F.size(F.coalesce(name, F.array().cast("array<string>"))) > 0, F.array_join(listed, "\n")).otherwise(
            f"- {NO_ITEM}"
        )

    def numbered(name: str) -> Column:
        listed = F.transform(name, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
        return F.when(F.size(F.coalesce(name, F.array().cast("array<string>"))) > 0, F.array_join(listed, "\n")).otherwise(
            f"1. {NO_ITEM}"
        )

    spans = F.transform(
        "evidence_spans",
        lambda s: F.concat(
            F.lit("- section: "), dash(s["section_title"]), F.lit(", chunk_index: "),
            F.coalesce(s["chunk_index"].cast("string"), F.lit("-")), F.lit(", summary: "), dash(s["summary"]),
        ),
    )
    has_spans = F.size(F.coalesce("evidence_spans", F.array().cast(f"array<{SPAN}>"))) > 0
    head = lambda name, value: F.concat(F.lit(f"- {name}: "), value)
    parts = [
        F.concat(F.lit("# "), F.col("title")), F.lit(""),
        head("card_type", F.col("card_type")), head("primary_topic", dash(F.col("primary_topic"))),
        head("task_type", dash(F.col("task_type"))), head("source_file", F.coalesce("source_file_name", F.lit(""))),
        head("source_category", F.coalesce("source_category", F.lit(""))),
        head("display_date", dash(F.col("display_date"))),
        head("answer_use_cases", dash(F.array_join("answer_use_cases", ", "))), F.lit(""),
        F.lit("## 요약"), F.coalesce("summary", F.lit("")), F.lit(""),
        F.lit("## 언제 사용하는가"), F.coalesce("when_to_use", F.lit("")), F.lit(""),
        F.lit("## 선행 조건"), bullets("prerequisites"), F.lit(""),
        F.lit("## 업무 절차"), numbered("steps"), F.lit(""),
        F.lit("## 체크포인트"), bullets("checkpoints"), F.lit(""),
        F.lit("## 주의사항"), bullets("cautions"), F.lit(""),
        F.lit("## 예시"), bullets("examples"), F.lit(""),
        F.lit("## 관련 용어"), bullets("related_terms"), F.lit(""),
        F.lit("## 미확인 사항"), bullets("open_questions"), F.lit(""),
        F.lit("## 근거"), F.when(has_spans, F.array_join(spans, "\n")).otherwise(f"- {NO_EVIDENCE}"),
    ]
    return strip(F.concat_ws("\n", *parts))


def is_valid_card() -> Column:
    """Required fields are there, type and use cases are of the closed sets."""
    filled = lambda c: strip(F.coalesce(c, F.lit(""))) != ""
    return (
        filled("card_id")
        & F.coalesce(F.col("card_type").isin(*vocab.CARD_TYPES), F.lit(False))
        & F.coalesce(F.forall("answer_use_cases", lambda u: u.isin(*vocab.USE_CASES)), F.lit(True))
        & filled("title")
        & filled("summary")
        & filled("source_file_name")
    )


def first_chunk_ids(chunks: DataFrame, n: int = CARDS.parent_ids) -> DataFrame:
    """The first n chunk ids of each document.  The limit is pushed below the shuffle."""
    w = Window.partitionBy("document_id").orderBy("chunk_index")
    first = chunks.select("document_id", "chunk_index", "chunk_id").withColumn("_n", F.row_number().over(w))
    first = first.where(F.col("_n") <= n)
    return first.groupBy("document_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id"))), lambda c: c["chunk_id"]).alias(
            "first_ids"
        )
    )


def cards_to_chunks(cards: DataFrame, chunks: DataFrame, cfg: CardConfig = CARDS) -> DataFrame:
    """Valid cards (with document_id and card_no) as chunks that point to the first raw chunks of their document."""
    rows = cards.where(is_valid_card()).join(first_chunk_ids(chunks, cfg.parent_ids), "document_id", "left")
    body = F.coalesce(F.nullif(strip("sanitized_markdown"), F.lit("")), render_markdown())
    suffix = F.regexp_replace("card_id", " ", "_")
    suffix = F.when(F.length(suffix) > 24, F.substring(suffix, -24, 24)).otherwise(suffix)
    given = F.size(F.coalesce("parent_raw_chunk_ids", F.array().cast("array<string>"))) > 0
    return rows.select(
        F.concat(F.lit("chunk_"), "document_id", F.format_string("_norm_%04d_", "card_no"), suffix).alias("chunk_id"),
        "document_id", F.col("card_no").alias("chunk_index"),
        F.lit(vocab.CARD_SOURCE_TYPE).alias("source_type"),
        F.coalesce("source_category", F.lit("")).alias("uploaded_category"),
        F.coalesce("source_file_name", F.lit("")).alias("file_name"),
        F.col("title").alias("section_title"),
        F.lit(vocab.CARD_CONTENT_TYPES[0]).alias("content_type"),
        body.alias("content"), body.alias("clean_content"), body.alias("embedding_text"),
        F.lit(cfg.source_weight).alias("source_weight"),
        "card_id", "card_type", "primary_topic", "topic_tags", "answer_use_cases", "task_type", "source_file_hash",
        F.when(given, F.col("parent_raw_chunk_ids"))
        .otherwise(F.coalesce("first_ids", F.array().cast("array<string>")))
        .alias("parent_raw_chunk_ids"),
    )


def card_stats(cards: DataFrame) -> DataFrame:
    """One pass: the total and the counts by type, topic and file (unknown when empty), ranked by count, then name."""
    named = {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown")) for c in ("card_type", "primary_topic", "source_file_name")}
    rows = cards.select(*[e.alias(c) for c, e in named.items()])
    c = [F.col(n) for n in named]
    counted = rows.groupingSets([[], [c[0]], [c[1]], [c[2]]], *c).agg(F.count("*").alias("n"), F.grouping_id().alias("_g"))
    # grouping_id has a 1 for every column that is rolled up: 7 none left, 3 type, 5 topic, 6 file.
    facet = F.when(F.col("_g") == 7, "total").when(F.col("_g") == 3, "card_type").when(F.col("_g") == 5, "primary_topic")
    return counted.select(
        facet.otherwise("source_file_name").alias("facet"), F.coalesce(*c, F.lit("all")).alias("name"), "n"
    )


def filter_cards(
    cards: DataFrame,
    card_type: str | None = None,
    primary_topic: str | None = None,
    source_file_name: str | None = None,
    query: str | None = None,
) -> DataFrame:
    """All given conditions; the query is looked for in title, summary, use and lists, case ignored."""
    for column, wanted in (("card_type", card_type), ("primary_topic", primary_topic), ("source_file_name", source_file_name)):
        if wanted and wanted != ALL:
            value = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("unknown")) if column == "primary_topic" else F.col(column)
            cards = cards.where(value == wanted)
    q = (query or "").strip().lower()
    if q:
        texts = [F.coalesce(c, F.lit("")) for c in ("title", "summary", "when_to_use")]
        lists = [F.array_join(F.coalesce(c, F.array().cast("array<string>")), "\n") for c in SEARCHED]
        cards = cards.where(F.contains(F.lower(F.concat_ws("\n", *texts, *lists)), F.lit(q)))
    return cards


def card_display(cards: DataFrame) -> DataFrame:
    """Flat rows with list sizes."""
    sizes = [F.size(F.coalesce(c, F.array().cast("array<string>"))).cast("long").alias(f"{c}_count")
             for c in ("checkpoints", "steps", "open_questions")]
    return cards.select(
        "title", "card_type", F.coalesce(F.nullif("primary_topic", F.lit("")), F.lit("unknown")).alias("primary_topic"),
        F.coalesce("task_type", F.lit("")).alias("task_type"), "source_file_name",
        F.coalesce("display_date", F.lit("")).alias("display_date"), *sizes,
    )


def summaries_by_file(summaries: DataFrame) -> DataFrame:
    """Number of summaries and sheets of each file."""
    return summaries.groupBy("file_name").agg(
        F.count("*").alias("summaries"), F.count_distinct("sheet_name").alias("sheets"), F.min("created_at").alias("first_at")
    )


def summaries_first(summaries: DataFrame, raw: DataFrame, order: str = "section_no") -> DataFrame:
    """Sections of both, numbered so that the summaries of a document come before its raw rows.

    ``order`` starts at 0 in either table; raw numbers are moved behind the document's summaries.
    """
    counts = summaries.groupBy("document_id").agg((F.max(order) + 1).alias("_before"))
    moved = raw.join(counts, "document_id", "left").withColumn(order, F.col(order) + F.coalesce("_before", F.lit(0)))
    return summaries.unionByName(moved.drop("_before"), allowMissingColumns=True)
