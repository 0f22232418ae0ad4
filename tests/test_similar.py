import random

import numpy as np
import pytest

from tidemark.operators import similar


def brute(rows, ask, k):
    out = []
    for q, cat, v in ask:
        if v is None or not any(v) or cat is None:
            continue
        q_ = np.array(v) / np.linalg.norm(v)
        near = sorted((-round(float(q_ @ (np.array(x) / np.linalg.norm(x))), 9), i) for i, c, x in rows if c == cat and i != q and x and any(x) and len(x) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near[:k])]
    return sorted(out)


@pytest.mark.parametrize("block,records", [(2048, 65536), (3, 7)])
def test_blocks_give_what_all_pairs_give(spark, block, records):
    g = random.Random(5)
    rows = [(i, g.choice(["a", "a", "b"]), [round(g.gauss(0, 1), 3) for _ in range(6)]) for i in range(180)]
    rows += [(200 + i, "a", rows[0][2]) for i in range(60)]  # a third of the rows are copies
    rows += [(300, "a", None), (301, "a", [0.0] * 6), (302, None, rows[1][2]), (303, "c", rows[2][2]), (304, "a", [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id int, category string, embedding array<double>")
    ask = [r for r in rows if r[0] % 4 == 0 or r[0] >= 300]
    got = similar.semantic_topk(df, spark.createDataFrame(ask, "query_id int, category string, embedding array<double>"), 4, block, records).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.similarity, 9)) for r in got) == [(q, n, i, pytest.approx(s, abs=1e-8)) for q, n, i, s in brute(rows, ask, 4)]


def test_no_queries(spark):
    df = spark.createDataFrame([(1, "a", [1.0])], "vec_id int, category string, embedding array<double>")
    assert similar.semantic_topk(df, df.limit(0).withColumnRenamed("vec_id", "query_id")).count() == 0
