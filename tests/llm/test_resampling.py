"""Importance resampling against brute force over plain dictionaries."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from placewise.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string"


def brute_features(text, n_buckets=10_000):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    runs = words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    return Counter(zlib.crc32(r.encode()) % n_buckets for r in runs)


def brute(docs, target, percent=25, n_buckets=10_000):
    raw, want = Counter(), Counter()
    for _, text in docs:
        raw += brute_features(text, n_buckets)
    for text in target:
        want += brute_features(text, n_buckets)
    s, t = sum(raw.values()), sum(want.values())
    gain = lambda b: math.floor(1000 * math.log((want[b] + 1) * (s + n_buckets) / ((raw[b] + 1) * (t + n_buckets))))
    rows = []
    for doc_id, text in docs:
        found = brute_features(text, n_buckets)
        n = sum(found.values())
        weight = sum(gain(b) * c for b, c in found.items()) // n if n else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= 39), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = percent * len(able) // 100
    ranks = {id(r): k + 1 for k, r in enumerate(able[:drawn])}
    return Counter((*r, ranks.get(id(r))) for r in rows)


def texts(rng, n):
    words = "The river Stone é漢 x1 9 house-light can't PAPER under_score ünder garden winter ÀB".split()
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) + rng.choice([".", "\n", "\x00", " \x7f"]) for _ in range(n)]


def test_against_brute_force(spark):
    rng = random.Random(1)
    docs = list(enumerate(texts(rng, 300)))
    docs += [docs[7], docs[8], docs[8], (900, None), (901, ""), (902, "  \n.,"), (None, docs[3][1]), (903, "w " * 50_000), (904, "x" * 100_000), (905, docs[5][1])]
    target = [*texts(rng, 20), None, "", "river stone " * 30]
    df = spark.createDataFrame([(*d, 1, "y") for d in docs], DOCS + ", Weight int, stream string").repartition(5)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    assert Counter(map(tuple, resampling.resample(df, wanted).collect())) == brute(docs, target)
    got = resampling.resample(df, wanted, percent=60, n_buckets=97).collect()
    assert Counter(map(tuple, got)) == brute(docs, target, 60, 97)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame(list(enumerate(texts(random.Random(2), 30))), DOCS)
    assert resampling.resample(none, some).count() == 0
    rows = [(r.doc_id, r.text) for r in some.collect()]
    assert Counter(map(tuple, resampling.resample(some, none).collect())) == brute(rows, [])


def test_streams_close_between_documents(spark, monkeypatch):
    monkeypatch.setattr(resampling, "_CHUNK", 10)
    rng = random.Random(3)
    batches = [(i, t) for i, t in enumerate(texts(rng, 40))]
    import pyarrow as pa

    found = list(resampling._packed([pa.RecordBatch.from_arrays([pa.array([i for i, _ in batches]), pa.array([t.encode() for _, t in batches])], ["doc_id", "text"])], 10_000))
    assert len(found) > 5 and sum(len(b.column(0)[0]) for b in found) == 40
    for b in found:
        assert sum(b.column(1)[0].as_py()) * 2 == len(b.column(2)[0].as_py())
    counts = next(resampling._run_lengths([pa.RecordBatch.from_arrays([b.column(2)], ["stream"]) for b in found], 10_000))
    want = sum((brute_features(t) for _, t in batches), Counter())
    assert dict(zip(counts.column(0).to_pylist(), counts.column(1).to_pylist(), strict=True)) == want


def test_features_of_every_byte():
    for text in ("".join(map(chr, range(1, 300))), "a  B\tc", "ß ẞ İ", "0a_9Z", ""):
        assert Counter(resampling.features(text.encode()).tolist()) == brute_features(text)


def test_draw_favours_the_target(spark):
    rng = random.Random(4)
    near, far = ["river stone water bank".split(), "paper ink book page".split()]
    docs = [(i, " ".join(rng.choice(near if i % 4 == 0 else far) for _ in range(40))) for i in range(400)]
    wanted = spark.createDataFrame([(" ".join(rng.choice(near) for _ in range(40)),) for _ in range(50)], "text string")
    rows = resampling.resample(spark.createDataFrame(docs, DOCS), wanted).collect()
    drawn = [r.doc_id for r in rows if r["rank"] is not None]
    assert len(drawn) == 100 and np.mean([d % 4 == 0 for d in drawn]) > 0.7
