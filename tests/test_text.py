import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newslens.functions import text as X


def test_strip_removes_all_unicode_whitespace(evaluate):
    samples = [" a ", "\t\na b\r\n", "  a　", "\x1ca\x1f", "", None, "​a"]
    assert evaluate(X.strip, samples) == [s.strip() if s is not None else None for s in samples]


def test_fold_composed_and_decomposed(evaluate):
    samples = ["EDUCAÇÃO", "educac\u0327a\u0303o", "Ünïcödé ÀÈ", "", None, "açãó", "が", "plain"]
    assert evaluate(X.fold_accents, samples) == [
        "educacao", "educacao", "unicode ae", "", "", "acao", "か", "plain",
    ]


def test_fold_equals_unicode_rule_on_every_two_byte_character(evaluate):
    # conjoining letters decompose to several; unassigned ones depend on the Unicode version
    chars = [chr(c) for c in range(0x80, 0x2000) if unicodedata.category(chr(c)) != "Cn"]
    expected = []
    for ch in chars:
        kept = [c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c) != "Mn"]
        expected.append("".join(kept) if len(kept) < 2 else ch)
    got = evaluate(X.fold_accents, chars)
    assert [(c, g) for c, e, g in zip(chars, expected, got) if e.lower() != g] == []


def test_fold_literal_is_the_same_rule(evaluate):
    samples = ["Educação Nova", "ÁÉÍ", "x́y", "MÜLLER ñ"]
    assert evaluate(X.fold_accents, samples) == [X.fold_literal(s) for s in samples]


def phrase(text):
    return X.contains_phrase(text, "Polícia  Nova")


def test_phrase_is_whole_words_without_accents_or_case(evaluate):
    samples = {
        "a polícia  nova chegou": True,
        "POLICIA  NOVA": True,
        "polícia  nova.": True,
        "xpolícia  nova": False,
        "polícia  novas": False,
        "polícia nova": False,
        "polícia  nova_": False,
        "(polícia  nova)": True,
        "épolicia  nova": False,
        "": False,
        None: False,
    }
    assert evaluate(phrase, list(samples)) == list(samples.values())


def test_case_variants_match_as_in_a_case_blind_search(evaluate):
    found = lambda t: X.contains_phrase(t, "rios σ")
    assert evaluate(found, ["RIOS Σ", "rıoſ ς", "RİOS σ́", "ríos Σ.", "rioss σ"]) == [True] * 4 + [False]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="aàÀ bB._-\nſ", max_size=14), min_size=20, max_size=60), st.text(alphabet="aàb _", min_size=1, max_size=3))
def test_phrase_equals_a_plain_search(spark, texts, words):
    def plain(text):
        return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").lower()

    df = spark.createDataFrame([(t,) for t in texts], "x string")
    got = [r[0] for r in df.select(X.contains_phrase(df.x, words)).collect()]
    assert got == [bool(re.search(rf"\b{re.escape(plain(words))}\b", plain(t), re.IGNORECASE)) for t in texts]


def test_phrase_with_pattern_characters(evaluate):
    found = evaluate(lambda t: X.contains_phrase(t, "a.b (c"), ["x a.b (c y", "x aXb (c y"])
    assert found == [True, False]


def test_compose_keeps_separators_around_empty_parts(evaluate):
    parts = [("t", "s", "b"), ("t", "", "b"), (None, None, None)]
    got = evaluate(X.compose_text, parts, "a string, b string, c string")
    assert got == ["t\n\ns\n\nb", "t\n\n\n\nb", "\n\n\n\n"]


def test_prompt_truncates_by_characters_and_fills_every_slot(evaluate):
    long = "é" * 9_999 + "ãx"
    render = lambda t: X.render_prompt("[{noticia}|{noticia}]", t, 10_000)
    cut = long[:10_000]
    assert evaluate(render, [long, "a{noticia}b"]) == [
        f"[{cut}|{cut}]", "[a{noticia}b|a{noticia}b]",
    ]


SLUGS = {
    # text: (classifier slug, ranker slug)
    "Búzios": ("buzios", "buzios"),
    "Müller": ("m-ller", "muller"),
    "a–b": ("a-b", "ab"),
    "--x--": ("x", "x"),
    "": ("evento-sem-chave", "evento-sem-chave"),
    None: ("evento-sem-chave", "evento-sem-chave"),
    "  Ação & Reação 2026!  ": ("acao-reacao-2026", "acao-reacao-2026"),
    "ﬁm ½ ™": ("m", "fim-12-tm"),
    "日本": ("evento-sem-chave", "evento-sem-chave"),
    "piñata è": ("pi-ata", "pinata-e"),
    "ÀÃÂ ÉÊ Í ÓÔÕ Ú Ç": ("aaa-ee-i-ooo-u-c", "aaa-ee-i-ooo-u-c"),
    "a…b": ("a-b", "a-b"),
    "café": ("cafe", "cafe"),
}


def test_slugs(evaluate):
    assert evaluate(X.slug_classifier, list(SLUGS)) == [a for a, _ in SLUGS.values()]
    assert evaluate(X.slug_ranker, list(SLUGS)) == [b for _, b in SLUGS.values()]


@pytest.mark.parametrize("kind", ["one", "several"])
def test_ranker_slug_on_every_compatibility_character(evaluate, kind):
    source, _, longer = X._ascii_table()
    chars = list(source) if kind == "one" else list(longer)
    plain = [unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode() for c in chars]
    expected = evaluate(X.slug_classifier, [f"q{p}q" for p in plain])
    assert evaluate(X.slug_ranker, [f"q{c}q" for c in chars]) == expected


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=20), min_size=20, max_size=60))
def test_slugs_are_clean_for_any_text(spark, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    for slug in (X.slug_classifier, X.slug_ranker):
        for (value,) in df.select(slug(df.x)).collect():
            assert value and value.strip("-") == value and "--" not in value
            assert set(value) <= set("abcdefghijklmnopqrstuvwxyz0123456789-")
