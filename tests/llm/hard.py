"""Documents that operators must survive, and tables to run them against."""

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"

#: names that operators use inside
CLASHES = ["row", "digest", "fp", "size", "found", "windows", "quality_verdict", "line_dedup", "left", "starts", "part",
           "target", "taken", "ids", "form", "prefix", "n", "output", "kept_id", "hit_id", "mix", "m_id", "sampling_key", "component_id", "first", "s", "i"]

PROSE = [
    "\n".join(" ".join(f"{w}{d}x{i}" for i in range(s, s + 12)) for s in range(0, 60, 12))
    for d, w in ((1, "alpha"), (2, "beta"), (3, "gamma"))
]
LONG = " ".join(f"w{i % 5000}" for i in range(60_000))

ROWS = [
    (0, PROSE[0], "en", "a"), (1, PROSE[0], "en", "a"), (2, PROSE[1], "en", None), (2, PROSE[1], "en", None),
    (2, PROSE[2], None, "b"), (3, None, "en", "a"), (4, "", "en", "c"), (5, " \n\t\n ", "en", "c"),
    (6, "one", "en", "c"), (None, PROSE[2], "en", "d"), (None, None, None, None), (7, LONG, "en", "e"),
    (8, "çé ñ 中文   x", "de", "é"), (9, "the " * 200, "en", "e"),
]


def documents(spark, rows=None):
    rows = ROWS if rows is None else rows
    df = spark.createDataFrame(
        [(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long"
    )
    for name in CLASHES:
        df = df.withColumn(name, F.lit("mine"))
    return df


def labels(spark, rows=((0, 1, 0), (0, 0, 1), (2, 1, None), (None, 1, 1), (7, None, 0), (99, 1, 1))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def benchmark(spark, rows=None):
    if rows is None:
        rows = [(1, " ".join(PROSE[0].split()[5:25])), (2, None), (3, ""), (4, "çé ñ 中文"), (4, "ONE"), (None, "alpha1x0 alpha1x1"),
                (10, " ".join(PROSE[0].split()[5:25]))]
    return spark.createDataFrame(list(rows), "item_id long, text string")


def folder(spark, path, **tables):
    """A folder of tables, the hard ones unless given."""
    made = {"documents": documents, "labels": labels, "benchmark": benchmark}
    for name, make in made.items():
        (tables[name] if name in tables else make(spark)).write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)
