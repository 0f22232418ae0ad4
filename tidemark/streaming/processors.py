"""Keyed state machines for transformWithStateInPandas."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.passage import first_passage

ACK, CHANGE, TICK = 0, 1, 2
PREDICTION = 3
FAR = 1 << 62


def _micros(ts: pd.Series) -> np.ndarray:
    return ts.to_numpy().astype("datetime64[us]").astype(np.int64)


class WatchEdges(StatefulProcessor):
    """Alerts of one watched target: each trigger fires on false -> true, at most once per cooldown.

    A suppressed edge still uses up the edge. A row of ticks has the four triggers as bits. With `confirmed` an alert is
    pending until an acknowledgement says that it was delivered: one that says otherwise, or ticks that arrive before
    any, put the trigger back to where it was, so the next satisfied tick fires again. In a batch, acknowledgements go
    before changes of the watch table and these before ticks; a removed target forgets everything.
    """

    FIELDS = "last int, alert array<bigint>, fired array<bigint>, trigger array<int>, event array<bigint>, at array<bigint>"

    def __init__(self, triggers: tuple[str, ...], cooldown_hours: int = 6, ttl_days: int | None = None, confirmed: bool = False):
        self.triggers, self.confirmed = triggers, confirmed
        self.cooldown_us = cooldown_hours * 3_600_000_000
        self.ttl_ms = None if ttl_days is None else ttl_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        # the TTL drops targets nobody watches any more and nobody removed
        self.state = handle.getValueState("edge", self.FIELDS, ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        n = len(self.triggers)
        last, alert, fired, pending = 0, [-FAR] * n, [-1] * n, []
        if self.state.exists():
            last, alert, fired, *p = self.state.get()
            alert, fired, pending = list(alert), list(fired), list(zip(*p, strict=True))
        acks, removed, ticks = {}, False, []
        for b in rows:
            kind = b["kind"].to_numpy()
            for r in b[kind == ACK].itertuples():
                acks[int(r.bits), int(r.event_id)] = bool(r.ok)
            removed |= any(x is False or x == 0 for x in b["ok"][kind == CHANGE] if x is not None)
            t = b[kind == TICK]
            ticks.append((_micros(t["ts"]), t["event_id"].to_numpy(np.int64), t["bits"].to_numpy(np.int64), t["price"].to_numpy(float)))
        ts, event, bits, price = (np.concatenate(x) for x in zip(*ticks, strict=True))

        left = []
        for i, e, at in pending:
            told = acks.get((i, e), False if len(ts) else None)
            if told:
                alert[i] = max(alert[i], at)
            elif told is None:
                left.append((i, e, at))
            elif fired[i] == e:  # still in the stretch that it began
                last &= ~(1 << i)
                fired[i] = -1
        pending = left
        if removed:
            last, alert, fired, pending = 0, [-FAR] * n, [-1] * n, []
        out = []
        if len(ts):
            order = np.lexsort((event, ts))
            ts, event, bits, price = ts[order], event[order], bits[order], price[order]
            before = np.concatenate([[last], bits[:-1]])
            for i in range(n):
                since = alert[i]
                for k in np.flatnonzero((bits & ~before) >> i & 1).tolist():
                    fired[i] = -1
                    if ts[k] - since >= self.cooldown_us:
                        since = int(ts[k])
                        fired[i] = int(event[k])
                        pending.append((i, fired[i], since))
                        out.append((f"{key[0]}:{self.triggers[i]}", ts[k], event[k], price[k]))
                if not int(bits[-1]) >> i & 1:
                    fired[i] = -1
                if not self.confirmed:
                    alert[i] = since
            last = int(bits[-1])
        if not self.confirmed:
            pending = []
        if removed and not len(ts):
            self.state.clear()
        else:
            self.state.update((last, alert, fired, *([list(x) for x in zip(*pending, strict=True)] or [[], [], []])))
        k, t, e, p = zip(*out, strict=True) if out else ((), (), (), ())
        yield pd.DataFrame({"key": pd.Series(k, dtype=object), "ts": pd.Series(np.array(t, "datetime64[us]")).dt.tz_localize("UTC"), "event_id": np.array(e, np.int64), "price": np.array(p, float)})

    def close(self) -> None:
        pass


class OutcomeCloser(StatefulProcessor):
    """Finds the tick that decides each open prediction; a key holds the predictions of many tickers.

    It is the first, in event time, at or beyond a level before the prediction is due. Without one the prediction expires
    when it is due, by an event-time timer and at the last price before; one without a price until then waits for the
    first after. A decision leaves once the watermark is past it, so ticks may come out of order, and its state with it.
    """

    NUMBERS = ("id", "created", "due", "hit", "hit_event", "last", "last_event", "next", "next_event")
    PRICES = ("low", "high", "hit_price", "last_price", "next_price")

    def __init__(self, ticker_type: str):
        self.fields = ", ".join([f"ticker {ticker_type}", *[f"{c} bigint" for c in self.NUMBERS], *[f"{c} double" for c in self.PRICES]])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", self.fields)

    def _held(self) -> dict[str, np.ndarray]:
        rows = list(zip(*self.open.get(), strict=True)) if self.open.exists() else []
        rows = rows or [()] * (1 + len(self.NUMBERS) + len(self.PRICES))
        kinds = [object, *[np.int64] * len(self.NUMBERS), *[np.float64] * len(self.PRICES)]
        return {c: np.array(x, k) for c, x, k in zip(("ticker", *self.NUMBERS, *self.PRICES), rows, kinds, strict=True)}

    def handleInputRows(self, key, rows, timerValues):
        held, ticks = self._held(), []
        known = set(held["id"].tolist())
        for b in rows:
            kind = b["kind"].to_numpy()
            p, t = b[kind == PREDICTION], b[kind == TICK]
            if len(p):
                p = p[~p["id"].isin(known)].drop_duplicates("id")
                known.update(p["id"].astype(np.int64).tolist())
                n, far = len(p), np.full(len(p), FAR)
                new = {"ticker": p["ticker"].to_numpy(object), "id": p["id"].to_numpy(np.int64), "created": _micros(p["created_at"]), "due": np.where(p["due_at"].isna(), FAR, _micros(p["due_at"])),
                       "low": p["low"].to_numpy(float), "high": p["high"].to_numpy(float), "hit": far, "last": -far, "next": far}
                held = {c: np.concatenate([x, new.get(c, np.full(n, -1, x.dtype))]) for c, x in held.items()}
            ticks.append((t["ticker"].to_numpy(object), _micros(t["ts"]), t["event_id"].to_numpy(np.int64), t["price"].to_numpy(float)))
        ticker, ts, event, price = (np.concatenate(x) for x in zip(*ticks, strict=True))
        if len(held["id"]) and len(ts):
            code = pd.factorize(np.concatenate([held["ticker"], ticker]))[0]
            mine, code = code[:len(held["id"])], code[len(held["id"]):]
            order = np.lexsort((event, ts, code))
            ts, event, price, code = ts[order], event[order], price[order], code[order]
            a, z, end = (np.zeros(len(mine), np.int64) for _ in range(3))
            by = np.argsort(mine, kind="stable")
            for group in np.split(by, np.flatnonzero(np.diff(mine[by])) + 1):
                lo, hi = np.searchsorted(code, mine[group[0]], "left"), np.searchsorted(code, mine[group[0]], "right")
                a[group] = lo + np.searchsorted(ts[lo:hi], held["created"][group])
                z[group] = lo + np.searchsorted(ts[lo:hi], np.maximum(held["due"][group], held["created"][group]))
                end[group] = hi
            at = first_passage(price, price, a, z, held["low"], held["high"])
            for name, k, is_new, sign in (("hit", at, at < z, 1), ("last", z - 1, z > a, -1), ("next", z, z < end, 1)):
                k = np.clip(k, 0, len(ts) - 1)
                now, seen = held[name], held[f"{name}_event"]
                better = is_new & ((sign * ts[k] < sign * now) | ((ts[k] == now) & (sign * event[k] < sign * seen)))
                for c, x in ((name, ts), (f"{name}_event", event), (f"{name}_price", price)):
                    held[c] = np.where(better, x[k], held[c])
        yield self._settle(held, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield self._settle(self._held(), timerValues.getCurrentWatermarkInMs())

    def _settle(self, held: dict[str, np.ndarray], watermark_ms: int) -> pd.DataFrame:
        """Close what is decided at the watermark, keep the rest and wake up at the next decision."""
        hit, due, last = held["hit"], held["due"], held["last"]
        when = np.where(hit < FAR, hit, np.where(last > -FAR, due, held["next"]))
        wake = -(-when // 1000)
        final = wake <= watermark_ms
        price = np.where(hit < FAR, held["hit_price"], np.where(last > -FAR, held["last_price"], held["next_price"]))
        out = pd.DataFrame({"id": held["id"][final], "ts": pd.Series(when[final].astype("datetime64[us]")).dt.tz_localize("UTC"), "price": price[final]})
        if final.all():
            self.open.clear()
        else:
            self.open.put(list(zip(*[x[~final].tolist() for x in held.values()], strict=True)))
        times = wake[~final & (when < FAR)]
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if len(times):
            self.handle.registerTimer(int(times.min()))
        return out

    def close(self) -> None:
        pass


class ThresholdOnce(StatefulProcessor):
    """Emit a key once, when its running count first reaches the threshold."""

    def __init__(self, threshold: int):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n bigint, fired boolean")

    def handleInputRows(self, key, rows, timerValues):
        n, fired = self.count.get() if self.count.exists() else (0, False)
        n += sum(len(b) for b in rows)
        out = pd.DataFrame(columns=["key", "threshold"])
        if n >= self.threshold and not fired:
            fired = True
            out = pd.DataFrame([(key[0], self.threshold)], columns=out.columns)
        self.count.update((n, fired))
        yield out

    def close(self) -> None:
        pass
