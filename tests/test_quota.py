"""Quotas under a clock of the test's own: no window holds more than it may, whatever fails and runs again."""

from __future__ import annotations

import json
import os
import random

import pytest
from pyspark import TaskContext

from placewise.operators import annotate
from placewise.operators.quota import Clock, Pace, Quota, laned, tokens_of

PROMPTS = "place_id string, batch int, prompt string"


class Told(Clock):
    """Passes only when slept; a task begins where the folder says that the last one of its lane ended."""

    def __init__(self, start=0.0):
        self.time = start

    def now(self):
        return self.time

    def sleep(self, seconds):
        self.time += max(seconds, 1e-9)


def most_in_a_window(calls, window):
    return max((sum(n for t, n in calls if start <= t < start + window) for start, _ in calls), default=0)


def test_pace_keeps_to_its_part():
    rng, clock = random.Random(1), Told()
    own, calls = Pace(Quota(100, window=60, gap=1.2, clock=clock), 100, again=False), []
    for _ in range(300):
        n = rng.randint(1, 60)
        own.wait(n)
        calls.append((clock.now(), n))
        clock.sleep(rng.random() * 3)
    assert 80 < most_in_a_window(calls, 60) <= 100
    assert min(b[0] - a[0] for a, b in zip(calls, calls[1:], strict=False)) >= 1.2 - 1e-6
    with pytest.raises(ValueError, match="more than a lane"):
        own.wait(101)


def test_a_task_that_runs_again_waits_a_window():
    quota = Quota(100, window=60, clock=Told(5.0))
    first = Pace(quota, 100, again=False)
    first.wait(90)
    again = Pace(quota, 100, again=True)
    again.wait(90)
    assert quota.clock.now() >= 65


def test_lanes_share_the_quota(spark):
    df = spark.createDataFrame([("p", i, "x" * 400) for i in range(50)], PROMPTS)
    dealt, part = laned(df, Quota(1000, lanes=8, answer=100))
    assert (dealt.rdd.getNumPartitions(), part) == (5, 200)  # five prompts of 200 fit a window, so there are no more lanes
    with pytest.raises(ValueError, match="more than the quota"):
        laned(df, Quota(150, answer=100))


class Service:
    """Writes down when each lane's calls come, and fails or answers badly now and then; dies once in a lane's first attempt."""

    def __init__(self, folder, clock):
        self.folder, self.clock = folder, clock

    def __call__(self, prompt):
        context = TaskContext.get()
        lane = context.partitionId()
        with open(f"{self.folder}/{lane}-{context.attemptNumber()}", "a") as f:
            f.write(json.dumps([self.clock.now(), tokens_of(prompt, 50)]) + "\n")
        k = int(prompt.split()[0])
        if k % 5 == 0:
            raise ConnectionError("busy")
        return "no object" if k % 7 == 0 else json.dumps({"n": k})


def test_annotate_within_a_quota(spark, tmp_path):
    clock = Told()
    quota = Quota(600, window=60, lanes=3, answer=50, clock=clock)
    df = spark.createDataFrame([("p", i, f"{i} " + "word " * (i % 40)) for i in range(60)], PROMPTS)
    rows = annotate.annotate(df, Service(str(tmp_path), clock), "n int", attempts=2, quota=quota).collect()
    assert {r.batch: r.answer and r.answer.n for r in rows} == {i: None if i % 5 == 0 or i % 7 == 0 else i for i in range(60)}
    lanes = {}
    for name in os.listdir(tmp_path):
        lanes[name] = [tuple(json.loads(x)) for x in open(tmp_path / name)]
    assert len(lanes) == 3 and sum(map(len, lanes.values())) == 60 + sum(i % 5 == 0 or i % 7 == 0 for i in range(60))
    # every lane begins at the same time here, so all calls together are the worst case
    assert most_in_a_window([c for calls in lanes.values() for c in calls], 60) <= 600
    for calls in lanes.values():
        assert most_in_a_window(calls, 60) <= 200
