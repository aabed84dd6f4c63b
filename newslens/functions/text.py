"""Text expressions: accent folding, slugs, phrase match, prompt text.

Everything here builds native column expressions. Character tables come from
Python's ``unicodedata`` by rule, once per driver, and travel as literals.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from newslens.schema import NO_EVENT_SLUG, TEXT_SLOT

# The accented letters that the classifier's slug knows.
SLUG_ACCENTS = "áàãâéêíóôõúç"
SLUG_PLAIN = "aaaaeeiooouc"

#: every character Python's ``str.strip`` removes
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip(text: Column) -> Column:
    """Remove Unicode whitespace at both ends (``trim`` alone removes spaces only)."""
    return F.trim(text, F.lit(WHITESPACE))


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def first_filled(*texts: Column) -> Column:
    """The first text that is neither missing nor empty, else the empty text."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit(""))


def is_ascii(text: Column) -> Column:
    """One byte per character; lets plain texts skip the character tables."""
    return F.length(text) == F.octet_length(text)


def _is_mark(ch: str) -> bool:
    return unicodedata.category(ch) == "Mn"


def _code_points():
    for cp in range(0x80, sys.maxunicode + 1):
        if not 0xD800 <= cp <= 0xDFFF:
            yield chr(cp)


@lru_cache(maxsize=1)
def _base_letters() -> dict[str, str]:
    """Accented characters by their base.

    Characters whose decomposition has more than one base character (Hangul
    syllables, some two-part vowels) are not in it and stay as they are.
    """
    bases = {}
    for ch in _code_points():
        if unicodedata.decomposition(ch) and not _is_mark(ch):
            kept = [c for c in unicodedata.normalize("NFD", ch) if not _is_mark(c)]
            if len(kept) == 1 and kept[0] != ch:
                bases[ch] = kept[0]
    return bases


@lru_cache(maxsize=1)
def _caseless_letters() -> dict[str, str]:
    """As above, and small letters that share a capital (``ſ`` and ``s``) become one.

    Capital sigma is included because its small form depends on its place in the word.
    """
    twins = {ch: ch.upper().lower() for ch in _code_points() if unicodedata.category(ch) == "Ll"}
    twins = {ch: twin for ch, twin in twins.items() if len(twin) == 1 and twin != ch}
    twins["Σ"] = "σ"
    return {**twins, **{ch: twins.get(base, base) for ch, base in _base_letters().items()}}


@lru_cache(maxsize=2)
def _translation(caseless: bool) -> tuple[str, str]:
    """``translate`` arguments. It deletes what has no counterpart: the marks come last."""
    letters = _caseless_letters() if caseless else _base_letters()
    marks = [ch for ch in _code_points() if _is_mark(ch)]
    return "".join([*letters, *marks]), "".join(letters.values())


def fold_accents(text: Column, caseless: bool = False) -> Column:
    """Lower-case text without accents; missing becomes empty.

    ``caseless`` also merges letters that only a case-blind comparison equates.
    """
    text = or_empty(text)
    plain = F.translate(text, *_translation(caseless))
    return F.lower(F.when(is_ascii(text), text).otherwise(plain))


def fold_literal(text: str, caseless: bool = False) -> str:
    """The driver-side twin of :func:`fold_accents`, for one constant."""
    source, target = _translation(caseless)
    table = {ord(ch): target[i] if i < len(target) else None for i, ch in enumerate(source)}
    return text.translate(table).lower()


def contains_phrase(text: Column, phrase: str) -> Column:
    """Whole-phrase match that ignores accents and case.

    The pattern starts with the phrase itself, so the search can skip ahead
    through a long text, and looks back for the word boundary before it. ``U``
    keeps boundaries Unicode-aware on every Java version.
    """
    words = re.escape(fold_literal(phrase, caseless=True))
    return F.rlike(fold_accents(text, caseless=True), F.lit(rf"(?U){words}\b(?<=\b{words})"))


def compose_text(title: Column, summary: Column, body: Column) -> Column:
    """Title, summary and body with a blank line between, also around empty parts."""
    return F.concat_ws("\n\n", or_empty(title), or_empty(summary), or_empty(body))


def render_prompt(template: str, text: Column, max_chars: int | None = None) -> Column:
    """Put the text, or its first ``max_chars`` characters, into the template's slot."""
    shown = text if max_chars is None else F.substring(text, 1, max_chars)
    return F.replace(F.lit(template), F.lit(TEXT_SLOT), shown)


def _dashed(text: Column) -> Column:
    slug = F.trim(F.regexp_replace(text, "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit(NO_EVENT_SLUG))


def slug_classifier(text: Column) -> Column:
    """Slug of the classification stage: twelve known accents, the rest becomes a dash."""
    text = F.lower(or_empty(text))
    plain = F.translate(text, SLUG_ACCENTS, SLUG_PLAIN)
    return _dashed(F.when(is_ascii(text), text).otherwise(plain))


@lru_cache(maxsize=1)
def _ascii_table() -> tuple[str, str, dict[str, str]]:
    """Compatibility characters by their ASCII part: one character, or several."""
    source, target, longer = [], [], {}
    for ch in _code_points():
        if unicodedata.decomposition(ch):
            plain = unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode()
            if len(plain) == 1:
                source.append(ch)
                target.append(plain)
            elif plain:
                longer[ch] = plain
    return "".join(source), "".join(target), longer


def slug_ranker(text: Column) -> Column:
    """Slug of the ranking stage: compatibility decomposition, other non-ASCII dropped.

    Most texts are ASCII after the one-to-one replacements. Characters with
    several ASCII letters (``ﬁ``, ``½``, ``™``) are then spelled out one kind at a
    time, for the kinds the text holds.
    """
    source, target, longer = _ascii_table()
    spelled = F.str_to_map(
        F.lit("\x01".join(f"{ch}\x02{plain}" for ch, plain in longer.items())),
        F.lit("\x01"),
        F.lit("\x02"),
    )
    text = or_empty(text)
    single = F.translate(text, source, target)
    others = F.array_distinct(F.regexp_extract_all(single, F.lit(r"[^\x00-\x7F]"), F.lit(0)))
    kinds = F.filter(others, lambda ch: F.try_element_at(spelled, ch).isNotNull())
    spelled_out = F.aggregate(
        kinds, single, lambda out, ch: F.replace(out, ch, F.try_element_at(spelled, ch))
    )
    plain = F.regexp_replace(spelled_out, r"[^\x00-\x7F]+", "")
    return _dashed(F.lower(F.when(is_ascii(text), text).otherwise(plain)))
