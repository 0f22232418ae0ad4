import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.ranks import order_statistics

AT = {"a": 0.2, "b": 0.5, "c": 0.8, "least": 0.0, "most": 1.0}


@pytest.mark.parametrize("cells,direct", [(1_024, 10_000), (64, 20)])
def test_ranks_are_those_of_the_sorted_values(spark, cells, direct):
    g = random.Random(cells)
    rows = [("hot", g.choice([g.gauss(0, 1), 10 ** g.uniform(-3, 4), 7.0, 7.0])) for _ in range(900)] + [("one", 3.0)] + [(f"k{g.randrange(9)}", float(g.randrange(5))) for _ in range(200)]
    rows += [("hot", None), ("hot", float("nan")), ("none", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "t string, x double")
    got = {r.t: tuple(r[n] for n in AT) for r in order_statistics(df, "t", "x", AT, cells, direct).collect() if r.t is not None}
    by = {}
    for t, x in rows:
        if t is not None and x is not None and not math.isnan(x):
            by.setdefault(t, []).append(x)
    assert got == {t: tuple(sorted(xs)[max(1, math.ceil(len(xs) * p)) - 1] for p in AT.values()) for t, xs in by.items()}


def test_no_rows(spark):
    assert order_statistics(spark.range(0).select(F.lit("t").alias("t"), F.lit(1.0).alias("x")), "t", "x", AT).count() == 0
