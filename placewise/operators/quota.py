"""A token quota of a service, kept by all tasks together.

The quota is split over a fixed number of lanes, each one partition and so one task at a time. A task keeps a log of what it has
sent in the last window and waits until the next prompt fits its lane's part; so whatever the tasks' order, no window
holds more than the quota. A task that runs again waits for a whole window first, since what its predecessor sent isn't known.
Speculative copies would send twice and are refused.
"""

from __future__ import annotations

import time
from collections import deque
from dataclasses import dataclass, field

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a token, as estimates go.
CHARS_OF_TOKEN = 4


class Clock:
    """Time as it passes; tests have their own."""

    def now(self) -> float:
        return time.monotonic()

    def sleep(self, seconds: float) -> None:
        time.sleep(seconds)


@dataclass(frozen=True)
class Quota:
    tokens: int  # of prompts and answers in a window
    window: float = 60.0  # seconds
    lanes: int = 8
    answer: int = 4096  # tokens that an answer may have
    gap: float = 0.0  # seconds between calls of a lane
    clock: Clock = field(default_factory=Clock)


def estimated(prompt: Column, answer: int) -> Column:
    """Tokens of a prompt and its answer, at most."""
    return F.ceil(F.length(prompt) / CHARS_OF_TOKEN) + answer


def tokens_of(prompt: str, answer: int) -> int:
    return -(-len(prompt) // CHARS_OF_TOKEN) + answer


class Pace:
    """What one task may send. again: whether an earlier attempt of the task may have sent something."""

    def __init__(self, quota: Quota, part: int, again: bool):
        self.quota, self.part, self.clock = quota, part, quota.clock
        self.sent: deque[tuple[float, int]] = deque()
        self.total, self.last = 0, float("-inf")
        if again:
            self.clock.sleep(quota.window)

    def wait(self, tokens: int) -> None:
        """Returns when so many tokens may be sent, and counts them as sent."""
        if tokens > self.part:
            raise ValueError(f"a prompt of {tokens} tokens is more than a lane's {self.part}")
        while True:
            now = self.clock.now()
            while self.sent and self.sent[0][0] + self.quota.window <= now:
                self.total -= self.sent.popleft()[1]
            pause = self.last + self.quota.gap - now
            if self.total + tokens > self.part:
                pause = max(pause, self.sent[0][0] + self.quota.window - now)
            if pause <= 0:
                break
            self.clock.sleep(pause)
        self.sent.append((now, tokens))
        self.total += tokens
        self.last = now


def laned(prompts: DataFrame, quota: Quota) -> tuple[DataFrame, int]:
    """prompts (with a column prompt) dealt over the lanes, and the tokens of a lane: fewer lanes if the longest prompt needs it."""
    if prompts.sparkSession.sparkContext.getConf().get("spark.speculation", "false").lower() == "true":
        raise ValueError("speculative tasks would send prompts twice: set spark.speculation to false")
    most = prompts.agg(F.max(estimated(F.col("prompt"), quota.answer))).first()[0] or 0
    if most > quota.tokens:
        raise ValueError(f"a prompt of {most} tokens is more than the quota of {quota.tokens}")
    lanes = max(1, min(quota.lanes, quota.tokens // max(most, 1)))
    return prompts.repartition(lanes), quota.tokens // lanes


def pace(quota: Quota, part: int) -> Pace:
    """Of the task that calls."""
    context = TaskContext.get()
    return Pace(quota, part, again=context is not None and context.attemptNumber() > 0)
