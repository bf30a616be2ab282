"""Keyed event-time state for the login monitors.

A user's events wait in a map until the watermark has passed their second; then they are folded, in time order, into what the user's past
still decides (one open window, or the few logins whose run may grow) and removed. An entry of the map holds up to ``CHUNK`` events that came
in one micro-batch, in order of time, so a call to the state store moves many events. A micro-batch writes its own events and reads the entries
that the watermark has reached; nothing else of the user is read or written, however busy the user is, and arrival order inside the watermark
delay does not matter. An entry holds distinct (time, type) pairs with their number.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SLOT_MS = 1000

#: Events of an entry: one that is passed in parts is written again for each part.
CHUNK = 256


def _counts(held: tuple) -> dict[tuple[int, str | None], int]:
    """What a slot holds: the number of each (time, type)."""
    times, kinds, numbers = held
    return dict(zip(zip(times, kinds), numbers))


def _in_order(event: tuple[int, str | None]) -> tuple[int, bool, str]:
    """By time, then by type with NULL first, as Spark sorts them."""
    ms, kind = event
    return ms, kind is not None, kind or ""


class SlotMonitor(StatefulProcessor):
    """Entries of pending events by their first time and a running number, what is open of the settled events, and the one timer of a user.

    The timer stands at the end of the second of the earliest pending event, or where what is open ends without further events. When it
    fires, all events whose second the watermark has passed are folded in time order.
    """

    OPEN: str
    COLUMNS: list[str]

    def __init__(self, span: int):
        self.span = span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", "first bigint, number bigint", "ms array<bigint>, type array<string>, n array<bigint>")
        self.open = handle.getValueState("open", self.OPEN)
        self.mark = handle.getValueState("mark", "timer bigint, number bigint")

    def _keep(self, number: int, events: list[tuple[tuple[int, str | None], int]]) -> None:
        (times, kinds), numbers = zip(*(event for event, _ in events)), [n for _, n in events]
        self.slots.updateValue((times[0], number), (list(times), list(kinds), numbers))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fresh = Counter((row["ms"], row["eventType"]) for row in rows)
        if not fresh:
            return iter([])
        timer, number = self.mark.get() or (None, 0)
        events = sorted(fresh.items(), key=lambda event: _in_order(event[0]))
        for at in range(0, len(events), CHUNK):
            self._keep(number, events[at : at + CHUNK])
            number += 1
        end = (events[0][0][0] // SLOT_MS + 1) * SLOT_MS
        if timer is None or end < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(end)
            timer = end
        self.mark.update((timer, number))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() // SLOT_MS * SLOT_MS
        pending = sorted(self.slots.keys())
        reached = [entry for entry in pending if entry[0] < passed]
        due = [first for first, _ in pending[len(reached) :]]
        ripe: Counter = Counter()
        rest = []
        for entry in reached:
            counts = _counts(self.slots.getValue(entry))
            ripe.update({event: n for event, n in counts.items() if event[0] < passed})
            if later := [event for event in counts.items() if event[0][0] >= passed]:
                rest.append((entry[1], later))
                due.append(later[0][0][0])
        if not due:
            self.slots.clear()
        else:
            for entry in reached:
                self.slots.removeKey(entry)
            for number, later in rest:
                self._keep(number, later)
        before, found = self.open.get(), []
        after = before
        for ms, kind in sorted(ripe, key=_in_order):
            after = self.fold(after, ms, kind, ripe[ms, kind], found)
        after = self.settle(after, passed, found)
        if after is not None:
            self.open.update(after)
        elif before is not None:
            self.open.clear()
        ends = [(min(due) // SLOT_MS + 1) * SLOT_MS] if due else []
        if after is not None:
            ends.append((self.until(after) // SLOT_MS + 1) * SLOT_MS)
        if ends:
            self.handle.registerTimer(min(ends))
            self.mark.update((min(ends), max((number for _, number in pending), default=-1) + 1))
        else:
            self.mark.clear()
        return (Row(**dict(zip(self.COLUMNS, (key[0], *row)))) for row in found)

    def until(self, state: tuple) -> int:
        """Time after which :meth:`settle` leaves nothing of the state if no event comes."""
        raise NotImplementedError

    def fold(self, state: tuple | None, ms: int, kind: str | None, n: int, found: list[tuple]) -> tuple | None:
        """State after ``n`` equal events; rows that they decide are added to ``found``."""
        raise NotImplementedError

    def settle(self, state: tuple | None, end: int, found: list[tuple]) -> tuple | None:
        """State once every event before ``end`` is folded."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class BurstMonitor(SlotMonitor):
    """Windows anchored at a login; the open one is kept as its start and its count."""

    OPEN = "start bigint, n bigint"
    COLUMNS = ["userId", "windowStart", "loginNums", "msg"]

    def __init__(self, limit: int, span: int, message: str):
        super().__init__(span)
        self.limit, self.message = limit, message

    def until(self, state):
        return state[0] + self.span

    def fold(self, state, ms, kind, n, found):
        if state is not None and ms <= state[0] + self.span:
            return state[0], state[1] + n
        self.settle(state, ms, found)
        return ms, n

    def settle(self, state, end, found):
        if state is None or state[0] + self.span >= end:
            return state
        if state[1] >= self.limit:
            found.append((state[0], state[1], self.message))
        return None


class PatternMonitor(SlotMonitor):
    """Runs of logins: the latest event if it is a login, and the logins whose run may still grow with the logins that followed each.

    A login leaves when its longest run is found or the span is over, so at most as many wait as the longest run has followers.
    """

    OPEN = "last bigint, first array<bigint>, seen array<bigint>"
    COLUMNS = ["userId", "firstLogin", "loginNums", "msg"]

    def __init__(self, span: int, repeats: tuple[int, ...], login: str, message: str):
        super().__init__(span)
        self.repeats, self.login, self.message = repeats, login, message

    def until(self, state):
        last, first, _ = state
        return max([*first, *([] if last is None else [last])]) + self.span

    def fold(self, state, ms, kind, n, found):
        last, first, seen = (None, [], []) if state is None else state
        if kind != self.login:
            return None, list(first), list(seen)
        waiting = list(zip(first, seen))
        for _ in range(n):
            if last is not None:
                waiting.append((last, 0))
            waiting = [(start, later + 1) for start, later in waiting if ms - start < self.span]
            found.extend((start, later + 1, self.message) for start, later in waiting if later in self.repeats)
            waiting = [(start, later) for start, later in waiting if later < max(self.repeats)]
            last = ms
        return last, [start for start, _ in waiting], [later for _, later in waiting]

    def settle(self, state, end, found):
        if state is None:
            return None
        last, first, seen = state
        waiting = [(start, later) for start, later in zip(first, seen) if start + self.span > end]
        last = last if last is not None and last + self.span > end else None
        if last is None and not waiting:
            return None
        return last, [start for start, _ in waiting], [later for _, later in waiting]
