"""First passages: the first place at which a series reaches one of two levels."""

from __future__ import annotations

import numpy as np


def first_passage(lows: np.ndarray, highs: np.ndarray, start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Per query the first place in [start, end) whose low is at or under `low` or whose high is at or over `high`;
    `end` if none.

    Minima and maxima of blocks of 1, 2, 4, ... places let all queries skip in logarithmically many steps.
    """
    levels = [(lows, highs)]
    while len(levels[-1][0]) > 1:
        lo, hi = levels[-1]
        odd = len(lo) % 2
        lo, hi = np.append(lo, [np.inf] * odd), np.append(hi, [-np.inf] * odd)
        levels.append((np.minimum(lo[::2], lo[1::2]), np.maximum(hi[::2], hi[1::2])))
    at = np.minimum(start, end).astype(np.int64)
    up = np.zeros(len(at), np.int64)  # the level a query is on; it climbs while blocks are free of a passage
    active = np.flatnonzero(at < end)
    while len(active):
        a, k = at[active], up[active]
        hit = np.zeros(len(active), bool)
        for level in np.unique(k):
            mine = k == level
            lo, hi = levels[level]
            block = a[mine] >> level
            hit[mine] = (lo[block] <= low[active[mine]]) | (hi[block] >= high[active[mine]])
        done = hit & (k == 0)
        down, on = active[hit & (k > 0)], active[~hit]
        up[down] -= 1
        at[on] = ((at[on] >> up[on]) + 1) << up[on]
        climb = ((at[on] >> up[on]) & 1 == 0) & (up[on] + 1 < len(levels))
        up[on[climb]] += 1
        active = active[~done]
        active = active[at[active] < end[active]]
    return np.minimum(at, end)
