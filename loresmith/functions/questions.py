"""What a question is about: date, topics, intents and classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loresmith import vocab
from loresmith.functions.dates import find_date, head_lines
from loresmith.functions.lookup import first_tag, matching_tags, mentions_any


def query_intents(text: Column, dictionary=vocab.QUERY_INTENTS) -> Column:
    return matching_tags(F.lower(text), dictionary)


def query_topics(text: Column, dictionary=vocab.QUERY_TOPICS) -> Column:
    return matching_tags(F.lower(text), dictionary)


def query_class(text: Column, name: str, dictionary=vocab.QUERY_CLASSES) -> Column:
    return mentions_any(F.lower(text), dictionary[name])


def answer_intent(text: Column, dictionary=vocab.ANSWER_INTENTS) -> Column:
    return first_tag(F.lower(text), dictionary)


def query_features(
    questions: DataFrame,
    default_year: int,
    text_col: str = "question",
    topics=vocab.QUERY_TOPICS,
    intents=vocab.QUERY_INTENTS,
    classes=vocab.QUERY_CLASSES,
) -> DataFrame:
    """Add query_date, query_topics, query_topic, query_intent and a flag for each of the classes."""
    text = F.trim(F.coalesce(F.col(text_col), F.lit("")))
    return questions.withColumns(
        {
            "query_date": find_date(head_lines(text), default_year)["d"],
            "query_topics": query_topics(text, topics),
            "query_intent": query_intents(text, intents),
            **{name: query_class(text, name, classes) for name in classes},
        }
    ).withColumn("query_topic", F.get("query_topics", F.lit(0)))
