"""From raw classifier answers to label rows, in native expressions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslens.functions.labels import label_fuzzy, label_score
from newslens.functions.text import first_filled, or_empty, slug_classifier, strip
from newslens.schema import (
    ANSWER_FIELDS,
    ERROR_PREFIX,
    FIELD_CAPS,
    KEY_SEPARATOR,
    LABEL_COLUMNS,
)

# The label keeps its JSON type: an answer whose label is a number or an object
# is unusable as a whole.
_ANSWER_TYPE = "array<struct<{}>>".format(
    ", ".join(f"{f}: {'variant' if f == 'label' else 'string'}" for f in ANSWER_FIELDS)
)
_JSON_OPTIONS = {"allowUnquotedControlChars": "true", "allowSingleQuotes": "false"}
_FALSY_JSON = ["0", "0.0", "false", "{}", "[]"]


def parse_answers(rows: DataFrame, content: str = "content") -> DataFrame:
    """Add ``parsed`` (the answer's fields, text) and ``answered`` (is it usable?).

    The object is cut from the first ``{`` to the last ``}``, which also drops
    code fences and prose around it. Reading it as the only element of an array
    rejects anything that is not exactly one object.
    """
    body = F.regexp_extract(F.col(content), r"(?s)\{.*\}", 0)
    items = F.from_json(F.concat(F.lit("["), body, F.lit("]")), _ANSWER_TYPE, _JSON_OPTIONS)
    # one column per step, so that each is computed once per row
    rows = (
        rows.withColumn("_items", items)
        .withColumn("_answer", F.when(F.size("_items") == 1, F.get("_items", F.lit(0))))
        .withColumns(
            {
                "_label": F.col("_answer.label").cast("string"),
                "_is_text": F.schema_of_variant("_answer.label") == "STRING",
            }
        )
    )
    is_text, label = F.coalesce("_is_text", F.lit(False)), F.col("_label")
    usable = F.col("_answer").isNotNull() & (is_text | label.isNull() | label.isin(_FALSY_JSON))
    fields = [F.when(is_text, label).alias("label")] + [
        F.col(f"_answer.{f}").alias(f) for f in ANSWER_FIELDS if f != "label"
    ]
    return rows.withColumns({"answered": usable, "parsed": F.struct(*fields)}).drop(
        "_items", "_answer", "_label", "_is_text"
    )


def event_name(event: Column, key: Column) -> Column:
    """Event name, else the event key."""
    return strip(first_filled(event, key))


def event_key(key: Column, name: Column) -> Column:
    """Event key, else the event name. Its classifier slug is the event id."""
    return strip(first_filled(key, name))


def reason_text(answer: Column) -> Column:
    return first_filled(answer["reason_sentimento"], answer["reason"])


def cap(name: str, text: Column, caps: Mapping[str, int]) -> Column:
    """The field's text, cut if ``caps`` names a length for it."""
    return F.substring(text, 1, caps[name]) if name in caps else text


def answer_fields(responses: DataFrame, caps: Mapping[str, int] | None = None) -> DataFrame:
    """``recordKey`` and the 12 answer-derived label columns.

    A failed call or an unreadable answer gives label n/a with the error or the
    raw answer as its reason, and no event. An empty answer has the failure before it
    (``earlier``) as its reason; no error text is ever read as an answer. Fields are whole unless ``caps`` (for
    instance ``FIELD_CAPS``) cuts them.
    """
    caps = caps or {}
    for absent in {"error", "earlier"} - set(responses.columns):
        responses = responses.withColumn(absent, F.lit(None).cast("string"))
    rows = parse_answers(responses.withColumn("content", strip(or_empty(F.col("content")))))
    ok = F.col("answered") & F.col("error").isNull()
    answer = F.col("answer")
    failure = F.coalesce(
        F.concat(F.lit(ERROR_PREFIX), F.col("error")), first_filled(F.col("content"), F.col("earlier"))
    )
    rows = (
        rows.withColumn("answer", F.when(ok, F.col("parsed")))
        .withColumns(
            {
                "label": label_fuzzy(answer["label"]),
                "reason": cap("reason", F.when(answer.isNull(), failure).otherwise(reason_text(answer)), caps),
                "evento": event_name(answer["evento"], answer["evento_chave"]),
            }
        )
        .withColumns(
            {
                "sentiment_score": label_score(F.col("label")),
                "evento_chave": event_key(answer["evento_chave"], F.col("evento")),
            }
        )
        .withColumn("evento_id", slug_classifier(F.col("evento_chave")))
    )
    optional = [cap(f, answer[f], caps).alias(f) for f in FIELD_CAPS if f != "reason"]
    return rows.select(
        "recordKey", "label", "sentiment_score", "reason", "evento", "evento_chave", "evento_id",
        *optional,
    )


def label_rows(
    articles: DataFrame, responses: DataFrame, model: str, caps: Mapping[str, int] | None = None
) -> DataFrame:
    """The 25-column label rows of all articles that have an answer."""
    answers = answer_fields(responses, caps)
    own = [c for c in LABEL_COLUMNS if c not in (*answers.columns[1:], "model", "targetKeys")]
    about = articles.select(*own, F.array_join("targetKeys", KEY_SEPARATOR).alias("targetKeys"))
    return about.join(answers, "recordKey").withColumn("model", F.lit(model)).select(*LABEL_COLUMNS)
