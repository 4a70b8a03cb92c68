"""Health of hosts while responses come in.

The same figures as ``crawl_log.crawl_health``, kept per host as streaming state: the last response
times, the error counter, and the responses that are not older than ``delay`` against the host's newest.
Responses are judged in the batch they arrive in, in the order of (ts, id).  One that lands late changes
what was said of those after it, so these are put out again; once a response is older than ``delay``, it is
folded into the ring and the counter and its figures are final.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import fixed_values as V
from ..operators.crawl_log import succeeded
from ..session import ship_package

TAKEN = ("_us", "id", "elapsed_s", "_step", "_failed")
CHUNK = 10_000   # rows held as Python objects at a time
RESULT = "host string, id long, mean_response double, error_pressure long, signal int, late boolean"


class HostHealth:
    """Ring of response times and leaky counter of one host, and the responses that may still move."""

    def __init__(self, stored: str | None = None):
        self.ring, self.pressure, self.upto, self.waiting = json.loads(stored) if stored else ([], 0, None, [])

    def stored(self) -> str:
        return json.dumps([self.ring, self.pressure, self.upto, self.waiting])

    @staticmethod
    def judged(ring: list, pressure: int, elapsed: float | None, step: int, failed: bool) -> tuple[list, int, float | None, int]:
        ring = [*ring, elapsed][-V.ROLLING_RESPONSES:]
        pressure = max(0, pressure + step)
        known = [x for x in ring if x is not None]
        mean = sum(known) / len(known) if known and len(ring) >= V.MIN_RESPONSES else None
        if failed:
            signal = -3 if pressure > V.TOLERATED_ERRORS else 0
        elif mean is not None and mean < V.FAST_MEAN and pressure == 0:
            signal = 2
        else:
            signal = -1 if mean is not None and mean > V.SLOW_MEAN else 0
        return ring, pressure, mean, signal

    def take(self, rows: list[list], delay_us: int) -> list[tuple]:
        """New rows [ts, id, elapsed, step, failed]; what is now said of them and of all after them."""
        return list(self.said(Responses.of(rows), delay_us))

    def said(self, fresh: Responses, delay_us: int) -> Iterator[tuple]:
        """The same one by one, so that a batch with very many rows of a host is never held as Python objects.

        The state is up to date once all has been taken.
        """
        if self.upto is not None:   # older than what is final: judged where the host stands, and marked
            late = fresh.upto(self.upto)
            behind, fresh = fresh[late], fresh[~late]
            for r in behind.ordered():
                self.ring, self.pressure, mean, signal = self.judged(self.ring, self.pressure, *r[2:])
                yield r[1], mean, self.pressure, signal, True
            first = self.waiting[0][:2] if len(behind) and self.waiting else None
        else:
            first = None
        if len(fresh):
            first = min(first, fresh.first()) if first else fresh.first()
        if not len(fresh) and not self.waiting:
            return
        together = fresh.with_rows(self.waiting)
        final = int(together.us.max()) - delay_us
        ring, pressure, waiting = self.ring, self.pressure, []
        for r in together.ordered():
            ring, pressure, mean, signal = self.judged(ring, pressure, *r[2:])
            if first is not None and r[:2] >= first:
                yield r[1], mean, pressure, signal, False
            if r[0] < final:
                self.ring, self.pressure, self.upto = ring, pressure, r[:2]
            else:
                waiting.append(r)
        self.waiting = waiting


class Responses:
    """Rows (ts, id, elapsed, step, failed) of a host as arrays, some tens of bytes each."""

    TYPES = ("int64", "int64", "float64", "int8", "bool")

    def __init__(self, arrays: Sequence[np.ndarray]):
        self.arrays = [np.asarray(a, t) for a, t in zip(arrays, self.TYPES)]
        self.us, self.id = self.arrays[:2]

    @classmethod
    def of(cls, rows: list[list]) -> Responses:
        return cls([[np.nan if r[k] is None else r[k] for r in rows] for k in range(5)])

    @classmethod
    def joined(cls, parts: list[Responses]) -> Responses:
        return cls([np.concatenate([p.arrays[k] for p in parts]) for k in range(5)]) if parts else cls.of([])

    def __len__(self) -> int:
        return len(self.us)

    def __getitem__(self, which: np.ndarray) -> Responses:
        return Responses([a[which] for a in self.arrays])

    def upto(self, place: list) -> np.ndarray:
        return (self.us < place[0]) | (self.us == place[0]) & (self.id <= place[1])

    def first(self) -> list:
        us = int(self.us.min())
        return [us, int(self.id[self.us == us].min())]

    def with_rows(self, rows: list[list]) -> Responses:
        return Responses.joined([self, Responses.of(rows)]) if rows else self

    def ordered(self) -> Iterator[list]:
        """The rows by time and id."""
        order = np.lexsort(self.arrays[::-1])
        for at in range(0, len(order), CHUNK):
            for us, i, elapsed, step, failed in zip(*[a[order[at:at + CHUNK]].tolist() for a in self.arrays]):
                yield [us, i, None if elapsed != elapsed else elapsed, step, failed]


def stream_health(log: DataFrame, delay_s: float) -> DataFrame:
    """Health of every response (host, id) of a streamed crawl log; for ``run_updates`` by host and id.

    A response that comes more than ``delay_s`` after younger ones of its host is judged where the host then
    stands and marked ``late``.  The state of a host is its ring, its counter and the responses of the last
    ``delay_s`` seconds.
    """
    ship_package(log.sparkSession)
    delay_us = round(delay_s * 1_000_000)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        health = HostHealth(state.get[0] if state.exists else None)
        fresh = Responses.joined([Responses([batch[c].to_numpy(t, copy=True) for c, t in zip(TAKEN, Responses.TYPES)]) for batch in batches])
        said = health.said(fresh, delay_us)
        del fresh
        while some := list(islice(said, CHUNK)):
            made = pd.DataFrame(some, columns=["id", "mean_response", "error_pressure", "signal", "late"])
            made.insert(0, "host", key[0])
            yield made
        state.update((health.stored(),))

    asked = log.select(
        "host", "id", "elapsed_s", F.unix_micros("ts").alias("_us"), F.when(succeeded(), -1).otherwise(1).alias("_step"),
        F.coalesce(~succeeded(), F.lit(False)).alias("_failed"))
    return asked.groupBy("host").applyInPandasWithState(update, RESULT, "stored string", "update", GroupStateTimeout.NoTimeout)
