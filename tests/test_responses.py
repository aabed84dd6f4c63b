import pytest

from newslens.operators import responses as R
from newslens.schema import FIELD_CAPS
from newslens.schema import LABEL_COLUMNS

GOOD = '{"label":"Positivo","evento":" Obra ","evento_chave":"Obra Nova","local":null}'


def parsed(spark, contents):
    df = spark.createDataFrame(list(enumerate(contents)), "i int, content string")
    return R.parse_answers(df).orderBy("i").collect()


@pytest.mark.parametrize(
    "content",
    [
        GOOD,
        f"```json\n{GOOD}\n```",
        f"```\n{GOOD}```",
        f"Resposta: {GOOD} fim.",
        f"[{GOOD}]",
        GOOD.replace('"label"', '"x":{"y":[1,{"z":2}]},"label"'),
    ],
)
def test_readable_answers(spark, content):
    (row,) = parsed(spark, [content])
    assert row.answered and row.parsed.label == "Positivo" and row.parsed.evento == " Obra "
    assert row.parsed.local is None and row.parsed.tipo_evento is None


def test_line_break_inside_a_text(spark):
    (row,) = parsed(spark, ['{"label":"neutro","evento":"a\nb\tc"}'])
    assert row.answered and row.parsed.evento == "a\nb\tc"


@pytest.mark.parametrize(
    "content",
    ["{bad", "{bad}", "", "nothing", "}{", "[1, 2]", f"{GOOD} and {GOOD}", f"{GOOD},{GOOD}",
     '{"label": 3}', '{"label": ["positivo"]}', '{"label": true}', '{"label": {"a": 1}}',
     "{'label': 'positivo'}", '{"label": "positivo",}', None],
)
def test_unusable_answers(spark, content):
    df = spark.createDataFrame([("k", content)], "recordKey string, content string")
    row = R.answer_fields(df).first()
    assert (row.label, row.sentiment_score, row.evento, row.evento_chave) == ("n/a", None, "", "")
    assert row.evento_id == "evento-sem-chave"
    assert row.reason == (content or "") and row.tipo_evento is None


@pytest.mark.parametrize("label", ["null", '""', "0", "false", "[]", "{}"])
def test_empty_labels_keep_the_rest(spark, label):
    (row,) = parsed(spark, [f'{{"label": {label}, "evento": "e"}}'])
    assert row.answered and row.parsed.evento == "e"


def test_answer_without_fields(spark):
    df = spark.createDataFrame([("k", "{}")], "recordKey string, content string")
    row = R.answer_fields(df).first()
    assert (row.label, row.reason, row.evento_id) == ("n/a", "", "evento-sem-chave")


def fields(spark, content, error=None, caps=None):
    df = spark.createDataFrame([("k", content, error)], "recordKey string, content string, error string")
    return R.answer_fields(df, caps).first()


def test_event_name_and_key_stand_in_for_each_other(spark):
    def event(**given):
        body = ", ".join(f'"{k}": "{v}"' for k, v in given.items())
        row = fields(spark, f'{{"label": "neutro", {body}}}')
        return row.evento, row.evento_chave, row.evento_id

    assert event(evento=" Obra ", evento_chave="obra-1") == ("Obra", "obra-1", "obra-1")
    assert event(evento="", evento_chave=" Chave Só ") == ("Chave Só", "Chave Só", "chave-so")
    assert event(evento="Nome É") == ("Nome É", "Nome É", "nome-e")
    assert event(evento="Nome", evento_chave="  ") == ("Nome", "", "evento-sem-chave")


def test_score_comes_from_the_label(spark):
    row = fields(spark, '{"label": "muito negativo", "sentiment_score": 2}')
    assert (row.label, row.sentiment_score) == ("muito negativo", -2)


def test_reason_fallback_and_caps(spark):
    long = "é" * 3000
    answer = (f'{{"label":"neutro","reason_sentimento":"","reason":"{long}","tipo_evento":"{long}",'
              f'"local":"{long}","data_evento":"{long}","descricao_curta":"{long}",'
              f'"evidencia_evento":"{long}","evidencia_sentimento":"{long}"}}')
    columns = ("reason", "tipo_evento", "local", "data_evento", "descricao_curta", "evidencia_evento", "evidencia_sentimento")
    for caps, expected in ((None, [3000] * 7), (FIELD_CAPS, [1200, 200, 200, 100, 1200, 1200, 1200])):
        row = fields(spark, answer, caps=caps)
        assert [len(row[c]) for c in columns] == expected


def test_error_rows(spark):
    row = fields(spark, None, "timeout")
    assert (row.label, row.reason, row.evento_chave) == ("n/a", "API error: timeout", "")
    assert fields(spark, GOOD, "late").label == "n/a"


def test_label_rows_have_25_columns(spark):
    article = spark.createDataFrame(
        [("k", 1, "k", 5, "2024", "", "", "h", "t", None, "", ["a", "b"], "text")],
        "recordKey string, jsonIndex long, id string, articleId long, publishedAt string, publishedDisplay string, "
        "sourceName string, sourceHost string, title string, storyId string, storyTitle string, "
        "targetKeys array<string>, rawText string",
    )
    answers = spark.createDataFrame([("k", GOOD), ("other", GOOD)], "recordKey string, content string")
    rows = R.label_rows(article, answers, "m")
    assert rows.columns == LABEL_COLUMNS
    (row,) = rows.collect()
    assert (row.targetKeys, row.label, row.sentiment_score, row.evento_id, row.model) == (
        "a; b", "positivo", 1, "obra-nova", "m",
    )
