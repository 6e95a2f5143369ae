"""Nearest neighbours by learned partitions against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from placewise.llm import neighbours
from placewise.llm.queries import QUERIES


def brute(rows, k, is_query):
    """{query row: its k nearest (rank, vec_id, score)} of distinct usable (vec_id, vector)."""
    good = lambda i, v: i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    rows = sorted({(i, tuple(v)) for i, v in rows if v is not None and good(i, v)})
    out = {}
    for i, v in rows:
        if is_query(i):
            scored = []
            for j, w in rows:
                if (j, w) != (i, v) and len(w) == len(v):
                    a, b = np.array(v, float), np.array(w, float)
                    a, b = a / np.abs(a).max(), b / np.abs(b).max()
                    scored.append((-float(a @ b / np.sqrt((a @ a) * (b @ b))), j))
            out.setdefault(i, []).append([(j, -s) for s, j in sorted((round(s, 12), j) for s, j in scored)[:k]])
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: [(i, s) for _, i, s in sorted(v)] for q, v in out.items()}


def recall(got, want):
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in w[0]}) for q, w in want.items())
    return hits / sum(len(w[0]) for w in want.values())


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")


def test_op11(spark, table):
    df = QUERIES["op11_nearest_neighbours"](spark, "/root/testdata/sf0.1")
    assert df.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    want = brute([(r.vec_id, r.embedding) for r in table.collect()], 5, lambda i: i % 50 == 0)
    got = found(df)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert recall(got, want) >= 0.9
    scores = {(q, i): s for q, w in brute([(r.vec_id, r.embedding) for r in table.collect()], 2000, lambda i: i % 50 == 0).items() for i, s in w[0]}
    assert all(abs(s - scores[q, i]) < 1e-11 for q, v in got.items() for i, s in v)


def test_many_small_parts_and_blocks(spark, table):
    want = brute([(r.vec_id, r.embedding) for r in table.collect()], 3, lambda i: i % 40 == 0)
    got = found(neighbours.search(table, F.col("vec_id") % 40 == 0, k=3, rows_per_part=128, block=50))
    assert recall(got, want) >= 0.9


def test_clusters_are_found_in_few_parts(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(16, 32))
    rows = [(i, (centres[i % 16] + 0.2 * rng.normal(size=32)).tolist()) for i in range(3200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors, dtype = neighbours.usable(df)
    router = neighbours.fit(vectors, 3200, dtype, rows_per_part=200)
    assert len(router.b2) == 16 and router.probes <= 3
    want = brute(rows, 5, lambda i: i % 100 == 0)
    assert recall(found(neighbours.search(df, F.col("vec_id") % 100 == 0, rows_per_part=200)), want) >= 0.9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [2.0, 0.0]), (4, [0.0, 1.0]), (50, [0.0, 3.0]), (50, [0.0, 3.0]), (100, None), (150, []), (200, [0.0, 0.0]), (250, [nan, 1.0]), (300, [inf, 1.0])]
    rows += [(350, [1.0, None]), (None, [1.0, 1.0]), (400, [1.0, 2.0, 3.0]), (5, [1.0, 2.0, 4.0]), (450, [5.0]), (500, [2.0**1000, 2.0**1000]), (6, [2.0**-1000, 2.0**-1000]), (-50, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "vec_id long, embedding array<double>, label int, Size string")
    rows_found = neighbours.search(df, F.col("vec_id") % 50 == 0).collect()
    want = brute(rows, 5, lambda i: i % 50 == 0)
    for q, answers in want.items():
        got = sorted((r["rank"], r.vec_id, round(r.score, 12)) for r in rows_found if r.query_id == q)
        assert got == sorted((n, i, s) for answer in answers for n, (i, s) in enumerate(answer, 1))
    assert {r.query_id for r in rows_found} == {q for q, a in want.items() if any(a)}
    assert 450 not in {r.query_id for r in rows_found}  # no other vector of its length
    assert neighbours.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_equal_vectors_in_crowds(spark):
    rng = np.random.default_rng(4)
    hot = [1.0] + [0.5] * 7
    rows = [(i, hot if i % 3 == 0 else rng.normal(size=8).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = found(neighbours.search(df, F.col("vec_id") % 50 == 0, rows_per_part=100))
    for q in range(0, 1500, 150):  # hot queries: the other hot rows of least ids, at 1
        assert [i for i, _ in got[q]] == [i for i in range(0, 21, 3) if i != q][:5]
        assert all(abs(s - 1) < 1e-12 for _, s in got[q])


def test_parts_are_balanced_and_cut_few_edges():
    rng = np.random.default_rng(5)
    blobs = np.repeat(rng.normal(size=(4, 16)) * 3, 100, axis=0) + rng.normal(size=(400, 16))
    blobs = neighbours.unit(blobs)
    near = neighbours._nearest(blobs, blobs, 8, np.arange(400))
    label = neighbours.balanced_parts(near, 4)
    assert sorted(np.bincount(label)) == [100] * 4
    assert (label[near] != label[:, None]).mean() < 0.05
