"""Limits of requests and tokens a minute (D15, D16, P17): online for a driver, and as an audit of a log."""

from __future__ import annotations

import random
import re
import time
from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW_S, MARGIN_S = 60.0, 0.05


def retry_after(headers: dict[str, str], body: str = "") -> float | None:
    """Seconds to wait that an answer names: in a header, in milliseconds in another, or in its text."""
    low = {k.lower(): v for k, v in headers.items()}
    for name, unit in (("retry-after", 1.0), ("retry-after-ms", 0.001)):
        try:
            return float(low[name]) * unit
        except (KeyError, ValueError):
            pass
    found = re.search(r"try again in ([\d.]+)s", body, re.IGNORECASE)
    return float(found[1].rstrip(".")) if found else None


def backoff(attempt: int, named: float | None = None) -> float:
    return named + 0.2 if named is not None else min(60.0, 2**attempt + random.uniform(0.1, 0.5))


class Limiter:
    """Waits until a call keeps both limits over the last minute."""

    def __init__(self, requests: int, tokens: int, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.requests, self.tokens, self.clock, self.sleep = requests, tokens, clock, sleep
        self.calls: deque[tuple[float, int]] = deque()

    def wait_time(self, tokens: int) -> float:
        now = self.clock()
        while self.calls and self.calls[0][0] <= now - WINDOW_S:
            self.calls.popleft()
        used = sum(t for _, t in self.calls)
        until = now
        if len(self.calls) >= self.requests:
            until = max(until, self.calls[-self.requests][0] + WINDOW_S)
        for at, t in self.calls:
            if used + tokens <= self.tokens:
                break
            used -= t
            until = max(until, at + WINDOW_S)
        return until - now + MARGIN_S if until > now else 0.0

    def acquire(self, tokens: int, on_wait: Callable[[float], None] | None = None) -> None:
        while (wait := self.wait_time(tokens)) > 0:
            if on_wait:
                on_wait(wait)
            self.sleep(wait)
        self.calls.append((self.clock(), tokens))


def audit(calls: DataFrame, requests: int, tokens: int, by: str = "user_id") -> DataFrame:
    """calls(by, call_id, ts, tokens) with requests and tokens of the minute up to each call, and whether they keep the limits.

    Each call stands in its own minute and, as context, in the next one, and windows are per caller and minute; so no window holds
    more than two minutes of one caller.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    own = F.floor(micros / 60_000_000)
    rows = calls.withColumn("__micros", micros).withColumn("__own", own).withColumn("__minute", F.explode(F.array(own, own + 1)))
    minute = Window.partitionBy(by, "__minute").orderBy("__micros").rangeBetween(-60_000_000, 0)
    counted = rows.withColumn("in_minute", F.count(F.lit(1)).over(minute)).withColumn("tokens_in_minute", F.sum("tokens").over(minute)).where("__own = __minute")
    return counted.withColumn("kept", (F.col("in_minute") <= requests) & (F.col("tokens_in_minute") <= tokens)).drop("__micros", "__own", "__minute")
