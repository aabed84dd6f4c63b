"""Label, score, date and missing-value rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from newslens.functions.text import or_empty, strip
from newslens.schema import LABELS, NA_SENTINELS, NO_LABEL, SCORES

# Labels searched for inside a longer answer, in this order.
CONTAINED_LABELS = ["muito negativo", "muito positivo", "negativo", "positivo", "neutro"]

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_ISO_DATE = r"^\d{4}(-\d{1,2}(-\d{1,2}([T ].+)?)?)?$"


def na_to_null(text: Column) -> Column:
    """Missing-value spellings become NULL (the sentiment stage's reading rule)."""
    return F.when(~text.isin(NA_SENTINELS), text)


def label_fuzzy(label: Column) -> Column:
    """Label of a model answer: exact, else the first label it contains, else n/a."""
    value = F.lower(strip(or_empty(label)))
    out = F.when(value.isin(LABELS), value)
    for known in CONTAINED_LABELS:
        out = out.when(F.contains(value, F.lit(known)), F.lit(known))
    return out.otherwise(F.lit(NO_LABEL))


def label_strict(label: Column) -> Column:
    """Label of a stored row: exact after strip and lower-casing, else n/a."""
    value = F.lower(strip(label))
    return F.when(value.isin(LABELS), value).otherwise(F.lit(NO_LABEL))


def label_score(label: Column) -> Column:
    """Score -2..2 of a label; n/a has none."""
    first, *rest = SCORES.items()
    out = F.when(label == first[0], F.lit(first[1]))
    for name, score in rest:
        out = out.when(label == name, F.lit(score))
    return out


def to_number(text: Column) -> Column:
    """Plain decimal text to DOUBLE, anything else to NULL."""
    text = strip(text.cast("string"))
    return F.when(F.rlike(text, F.lit(_NUMBER)), text.try_cast("double"))


def to_article_id(value: Column) -> Column:
    """Numeric id as BIGINT; non-numeric text is NULL, a fraction is cut off."""
    return F.coalesce(
        strip(value.cast("string")).try_cast("bigint"), to_number(value).try_cast("bigint")
    )


def score_repair(score: Column, label: Column) -> Column:
    """Parsed score, else the label's; a number beside an n/a label is kept."""
    return F.coalesce(score, label_score(label).cast("double"))


def parse_timestamp(text: Column, formats: Sequence[str] = ()) -> Column:
    """ISO 8601 text, or any of ``formats``, to TIMESTAMP; invalid text to NULL."""
    text = strip(text)
    ts = F.when(F.rlike(text, F.lit(_ISO_DATE)), text.try_cast("timestamp"))
    return F.coalesce(ts, *[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def month_of(ts: Column) -> Column:
    """``YYYY-MM``; NULL for undated rows."""
    return F.date_format(ts, "yyyy-MM")


def presentation_score(score: Column) -> Column:
    """Score -2..2 on the 0..1 scale of the report."""
    return (score + F.lit(2)) / F.lit(4)
