"""Keyed state of the live jobs, kept by the engine (RocksDB).

A processor sees one key's new rows of a micro-batch and the key's state. Rows
reach it already reduced by the task that read them, so a busy key costs a few
short rows a task. Times are microseconds, whatever the session's time zone.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor

DAY = 86_400_000_000  # microseconds
POLL = np.dtype([("poll", "<i8"), ("ts", "<i8"), ("price", "<f8"), ("id", "<i8")])
POLLED = "poll long, ts long, price double, id long, before double, was double, revision long"


def latest_of_polls(rows: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """Of each key and poll the row with the latest time, then largest price, then id."""
    ordered = rows.sort_values([*keys, "poll", "ts", "price", "id"])
    return ordered.drop_duplicates([*keys, "poll"], keep="last")


class PollState(StatefulProcessor):
    """The latest row of every poll interval of a market.

    Gives a row for each poll that is new or has changed, and for the poll after
    it: its latest row, the price of the poll before, the price it had itself
    until now, and a number that grows with every revision. Polls lie in the
    state by day, sorted, so a batch touches the days it has rows for and the
    ones next to them, however long the history is.
    """

    def __init__(self, keys: list[str]):
        self.keys = keys

    def init(self, handle) -> None:
        self.days = handle.getMapState("days", "day long", "polls binary")
        self.index = handle.getValueState("index", "days array<long>, revision long")

    def _day(self, day: int) -> np.ndarray:
        return np.frombuffer(self.days.getValue((day,))[0], POLL)

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
        new = latest_of_polls(pd.concat(list(rows)), self.keys)
        found = np.zeros(len(new), POLL)
        for name in POLL.names:
            found[name] = new[name]
        days, revision = (list(x) if i == 0 else x for i, x in enumerate(self.index.get())) if self.index.exists() else ([], 0)
        revision += 1
        held: dict[int, np.ndarray] = {}
        touched: dict[int, float | None] = {}  # poll -> price until now
        for day in np.unique(found["poll"] // DAY).tolist():
            mine = found[found["poll"] // DAY == day]
            if day in days:
                old = self._day(day)
                kept = {r["poll"]: r for r in old}
            else:
                kept = {}
                insort(days, day)
            for r in mine:
                before = kept.get(r["poll"])
                if before is None or (r["ts"], r["price"], r["id"]) > (before["ts"], before["price"], before["id"]):
                    touched[int(r["poll"])] = None if before is None else float(before["price"])
                    kept[r["poll"]] = r
            held[day] = np.array([tuple(kept[p]) for p in sorted(kept)], POLL)
            self.days.updateValue((day,), (held[day].tobytes(),))
        self.index.update((days, revision))

        def polls(day: int) -> np.ndarray:
            if day not in held:
                held[day] = self._day(day)
            return held[day]

        out = {}
        for poll in touched:
            place = bisect_left(days, poll // DAY)
            at = int(np.searchsorted(polls(days[place])["poll"], poll))
            for at_day, i in ((place, at), self._next(days, polls, place, at)):
                if at_day < len(days):
                    row = polls(days[at_day])[i]
                    out[int(row["poll"])] = (row, self._price_before(days, polls, at_day, i))
        if out:
            order = sorted(out)
            frame = {
                **{k: [v] * len(out) for k, v in zip(self.keys, key)},
                "poll": order, "ts": [int(out[p][0]["ts"]) for p in order],
                "price": [float(out[p][0]["price"]) for p in order], "id": [int(out[p][0]["id"]) for p in order],
                "before": np.array([out[p][1] for p in order], float),
                "was": np.array([touched[p] if p in touched else float(out[p][0]["price"]) for p in order], float),
                "revision": [revision] * len(out),
            }
            yield pd.DataFrame(frame)

    @staticmethod
    def _next(days, polls, place: int, at: int) -> tuple[int, int]:
        return (place, at + 1) if at + 1 < len(polls(days[place])) else (place + 1, 0)

    @staticmethod
    def _price_before(days, polls, place: int, at: int) -> float | None:
        if at:
            return float(polls(days[place])[at - 1]["price"])
        return float(polls(days[place - 1])[-1]["price"]) if place else None

    def close(self) -> None:
        pass


class SessionState(StatefulProcessor):
    """Last language and last market of a sender; gone ``days`` after the last one was written."""

    def __init__(self, life_ms: int):
        self.life_ms = life_ms

    def init(self, handle) -> None:
        schema = "lang_seq long, lang string, market_seq long, crop string, mandi string"
        self.session = handle.getValueState("session", schema, self.life_ms)

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
        lang_seq, lang, market_seq, crop, mandi = self.session.get() if self.session.exists() else (None, None, None, None, None)
        for said in pd.concat(list(rows)).sort_values("seq").itertuples():
            if said.kind == "language" and (lang_seq is None or said.seq >= lang_seq):
                lang_seq, lang = int(said.seq), said.lang
            if said.kind == "market" and (market_seq is None or said.seq >= market_seq):
                market_seq, crop, mandi = int(said.seq), said.crop, said.mandi
        self.session.update((lang_seq, lang, market_seq, crop, mandi))
        yield pd.DataFrame({"sender": [key[0]], "lang": [lang], "crop": [crop], "mandi": [mandi]})

    def close(self) -> None:
        pass


class WindowState(StatefulProcessor):
    """Open windows of a label as counters.

    A window that ends ``delay`` or more before the newest end seen is finished:
    it is given once and leaves the state. Rows that come for a finished window
    are given on as late counters, to be added to it.
    """

    def __init__(self, counters: list[str], width: int, delay: int):
        self.counters, self.width, self.delay = counters, width, delay

    def init(self, handle) -> None:
        self.open = handle.getMapState("open", "window_start long", ", ".join(f"{c} long" for c in self.counters))
        self.newest = handle.getValueState("newest", "window_end long")

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
        added = pd.concat(list(rows)).groupby("window_start")[self.counters].sum()
        newest = self.newest.get()[0] if self.newest.exists() else None
        out = []

        def row(start, counts, late):
            return {"window_start": start, "label": key[0], **dict(zip(self.counters, counts)), "late": late}

        for start, counts in zip(added.index, added.to_numpy().tolist()):
            end = int(start) + self.width
            if newest is not None and end <= newest - self.delay:
                out.append(row(start, counts, True))
                continue
            at = (int(start),)
            if self.open.containsKey(at):
                counts = [int(a) + int(b) for a, b in zip(counts, self.open.getValue(at))]
            self.open.updateValue(at, tuple(int(c) for c in counts))
        ends = [int(start) + self.width for start in added.index]
        newest = max(ends if newest is None else [newest, *ends])
        self.newest.update((newest,))
        for at, counts in list(self.open.iterator()):  # as many as ``delay`` has windows, and those just finished
            if at[0] + self.width <= newest - self.delay:
                out.append(row(at[0], [int(c) for c in counts], False))
                self.open.removeKey(at)
        if out:
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass
