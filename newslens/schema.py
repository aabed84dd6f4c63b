"""Column lists, types and fixed values of the data contract."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must keep exactly this text and order, because tables,
# rankings and stored label files are keyed on them.
# ---------------------------------------------------------------------------

#: label, score, display name; the order is the order of every sentiment table
LABEL_DIMENSION = [
    ("muito negativo", -2, "Muito negativo"),
    ("negativo", -1, "Negativo"),
    ("neutro", 0, "Neutro"),
    ("positivo", 1, "Positivo"),
    ("muito positivo", 2, "Muito positivo"),
    ("n/a", None, "Não aplicável"),
]

NO_EVENT_SLUG = "evento-sem-chave"

ERROR_PREFIX = "API error: "
KEY_SEPARATOR = "; "

TEXT_SLOT = "{noticia}"
MAX_INPUT_CHARS = 10_000

#: free-text answer fields and the longest text each may keep
FIELD_CAPS = {
    "reason": 1200,
    "evidencia_sentimento": 1200,
    "tipo_evento": 200,
    "local": 200,
    "data_evento": 100,
    "descricao_curta": 1200,
    "evidencia_evento": 1200,
}

#: texts that the sentiment stage reads as "missing" in a label file
NA_SENTINELS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

LABEL_COLUMNS = [
    "recordKey", "jsonIndex", "id", "articleId", "publishedAt",
    "publishedDisplay", "sourceName", "sourceHost", "title", "storyId",
    "storyTitle", "targetKeys", "label", "sentiment_score", "reason",
    "evidencia_sentimento", "evento", "evento_chave", "evento_id",
    "tipo_evento", "local", "data_evento", "descricao_curta",
    "evidencia_evento", "model",
]

CLASSIFIED_COLUMNS = [*LABEL_COLUMNS, "month"]

ARTICLE_EVENT_COLUMNS = [
    "articleId", "recordKey", "publishedAt", "sourceName", "sourceHost",
    "title", "label", "sentiment_score", "evento", "evento_chave",
    "evento_id", "tipo_evento", "local", "data_evento", "descricao_curta",
    "model",
]

EVENT_SUMMARY_COLUMNS = [
    "evento_id", "evento", "evento_exemplo", "tipo_evento", "local",
    "n_artigos", "n_classificados", "score_medio", "media_sentimento",
    "muito_negativo", "negativo", "neutro", "positivo", "muito_positivo",
    "n/a", "n_positivas", "n_negativas", "n_muito_positivas",
    "n_muito_negativas", "share_positivo", "share_negativo",
    "share_muito_positivo", "share_muito_negativo", "peso_positivo",
    "peso_negativo", "titulos_exemplo",
]

#: text fields of an article that default to the empty string
ARTICLE_TEXT_COLUMNS = [
    "title", "url", "sourceName", "sourceHost", "publishedAt",
    "publishedDisplay", "rawTextKey", "rawText", "summaryPreview",
    "summaryLabel", "storyTitle",
]

#: fields of the classifier's answer
ANSWER_FIELDS = [
    "label", "reason_sentimento", "reason", "evento", "evento_chave",
    "tipo_evento", "local", "data_evento", "descricao_curta",
    "evidencia_sentimento", "evidencia_evento",
]

# ---------------------------------------------------------------------------

LABELS = [label for label, _, _ in LABEL_DIMENSION]
SCORES = {label: score for label, score, _ in LABEL_DIMENSION if score is not None}
NO_LABEL = "n/a"
POSITIVE = ["positivo", "muito positivo"]
NEGATIVE = ["negativo", "muito negativo"]

#: one element of the corpus; ids are read as text so that one bad id cannot
#: fail the whole file
ARTICLE_SCHEMA = T.StructType(
    [T.StructField("articleId", T.StringType()), T.StructField("id", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in ARTICLE_TEXT_COLUMNS]
    + [
        T.StructField("targetKeys", T.ArrayType(T.StringType())),
        T.StructField("storyId", T.StringType()),
    ]
)

INDEXED_ARTICLE_SCHEMA = T.StructType(
    [T.StructField("jsonIndex", T.LongType()), *ARTICLE_SCHEMA.fields]
)

CORPUS_SCHEMA = T.StructType([T.StructField("articles", T.ArrayType(ARTICLE_SCHEMA))])

#: label rows as this package produces them
LABEL_SCHEMA = T.StructType(
    [
        T.StructField(
            c,
            T.LongType()
            if c in ("jsonIndex", "articleId")
            else T.IntegerType()
            if c == "sentiment_score"
            else T.StringType(),
        )
        for c in LABEL_COLUMNS
    ]
)

#: answers of the classifier as landed, before any parsing
RESPONSE_SCHEMA = T.StructType(
    [
        T.StructField("recordKey", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("error", T.StringType()),
        # the failure before a later answer, the reason if that answer is empty
        T.StructField("earlier", T.StringType()),
        T.StructField("attempts", T.IntegerType()),
    ]
)
