import numpy as np
from pyspark.sql import functions as F

from newslens.functions.rounding import round4, share4


def test_shares_equal_correct_rounding_for_all_small_quotients(spark):
    n = 900
    pairs = spark.range(1, n + 1).select(F.col("id").alias("whole")).select(
        "whole", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("whole"))).alias("part")
    )
    rows = pairs.select("part", "whole", share4(F.col("part"), F.col("whole")).alias("s")).toPandas()
    expected = [round(p / w, 4) for p, w in zip(rows.part.tolist(), rows.whole.tolist())]
    assert rows.s.tolist() == expected


def test_shares_at_half_way_points(spark):
    # every odd multiple of 1/20000, with wholes that are multiples of 20000
    df = spark.range(1, 20_000, 2).select(
        F.col("id").alias("m"), share4(F.col("id") * 7, F.lit(140_000)).alias("s")
    )
    for m, s in df.collect():
        assert s == round(m / 20_000, 4)


def test_share_of_nothing(evaluate):
    assert evaluate(share4, [(0, 0), (1, 32), (3, 32)], "a int, b int") == [None, 0.0312, 0.0938]


def test_round4_scales_first(evaluate):
    values = [0.03125, 12.34565, 0.00625, 100 / 3, -0.03125, 1 / 128 * 100, None]
    expected = [None if v is None else float(np.round(v, 4)) for v in values]
    assert evaluate(round4, values, "x double") == expected
