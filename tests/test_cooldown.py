import datetime as dt
import random

import numpy as np
import pytest

from tidemark.operators import watchlist as wl


def fold(edges, limit):
    last, out = {}, []
    for key, t, e in sorted(edges):
        if key not in last or t - last[key] >= limit:
            last[key] = t
            out.append((key, e))
    return sorted(out)


def test_step_maps_and_their_composition_follow_the_fold():
    g = random.Random(1)
    for _ in range(300):
        t = np.sort(np.array([g.randrange(0, 60) for _ in range(g.randrange(1, 12))]))
        start, value = wl._step_map(t, 7)
        for a in [wl.NEVER, *range(-20, int(t[0]) + 1)]:
            alerts = wl._alerts(t, a, 7)
            assert wl._apply(start, value, np.array([a]))[0] == (t[alerts[-1]] if alerts else a)


@pytest.mark.parametrize("fan,blocks,step", [(16, 4, 40), (2, 13, 40), (2, 9, 3), (3, 40, 1)])
def test_a_key_that_never_pauses(spark, fan, blocks, step):
    """One key holds most edges, minutes apart; blocks may be shorter than the cooldown."""
    g, t0 = random.Random(step), dt.datetime(2024, 1, 1)
    edges = [("hot", 60 * step * k + g.randrange(60), k) for k in range(500)] + [(f"k{g.randrange(40)}", g.randrange(10**6), 1000 + k) for k in range(250)] + [("hot", 60 * step * 7, 700), ("hot", 60 * step * 7, 701)]
    rows = spark.createDataFrame([(k, t0 + dt.timedelta(seconds=t), e, 1.0) for k, t, e in edges], "key string, ts timestamp, event_id bigint, price double")
    got = sorted((r.key, r.event_id) for r in wl.fire(rows, 6, fan, blocks).collect())
    assert got == fold(edges, 6 * 3600)


def test_no_edges(spark):
    assert wl.fire(spark.createDataFrame([], "key string, ts timestamp, event_id bigint, price double")).count() == 0
