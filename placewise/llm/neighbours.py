"""Approximate nearest neighbours by learned partitions (after Dong et al., 2020).

On a sample of vectors, Spark's tasks find each one's nearest others; the graph of them is cut into parts of equal size by
recursive spectral bisection with exchanges that lower the cut. A small network of one hidden layer learns, from the parts
of a vector's neighbours, in which parts neighbours of a vector are. Then every vector of the table is put into its most
probable part, and a query goes to its most probable parts only, whose vectors are ranked by exact cosine in double
precision. How many parts a query visits follows from the recall on sample vectors that neither the graph nor
the network has seen.

Bounds: the sample has about SAMPLE_PER_PART vectors a part, LEAST_SAMPLE at least, and there are MAX_PARTS parts at most; beyond
that parts grow with the table, and all their vectors are searched. A part is dealt out in blocks of BLOCK vectors, its
queries likewise, so that no task has more than a block of either. Of equal vectors only the k + 1 of the least ids can be
among the k nearest of anything, so others don't enter the index; equal queries are searched once.

Defined results: vectors that are null, empty, zero or have null or non-finite components take no part, nor do null ids;
vectors are compared with those of their length only (lengths other than the most common one are parts of their own,
searched whole); equal scores go to the smaller id; a repeated row (id and vector) counts once, a query row is not
its own neighbour, another vector of its id is one like any other; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewise.llm._common import cut

K = 5
ROWS_PER_PART = 1024
MAX_PARTS = 512
SAMPLE_PER_PART = 256
LEAST_SAMPLE = 8192
#: Neighbours of a sample vector in the graph.
DEGREE = 16
HIDDEN = 128
#: Recall on vectors held out that the number of visited parts has to reach.
RECALL = 0.95
BLOCK = 32_768
_HELD_OUT = 5  # one in so many sample vectors
_SEED = 17
_NEAR = 1e-9  # scores of products this close are compared exactly


# vectors


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled by powers of two first, so that squares neither overflow nor vanish."""
    x = vectors.astype(np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows with rows, each summed in the same order wherever it is computed."""
    x, y = (np.ldexp(v.astype(np.float64), -np.frexp(np.abs(v.astype(np.float64)).max(axis=1, keepdims=True))[1]) for v in (a, b))
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def _rows(column: pa.Array, dtype: str) -> np.ndarray:
    return np.stack([np.frombuffer(v.as_py(), dtype) for v in column])


def usable(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, str]:
    """(vec_id, vec, size) of the rows that take part, each once; vec: the components' bytes, of the type that is returned."""
    kind = dict(rows.dtypes)[vector]
    dtype, cast = ("<f4", "array<float>") if kind == "array<float>" else ("<f8", "array<double>")
    v, x = F.col("v"), rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast(cast).alias("v"))
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    fine = x.where(F.col("vec_id").isNotNull() & v.isNotNull()).where(finite & F.exists("v", lambda e: e != 0))

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(dtype)
            ends = np.cumsum(np.diff(lists.offsets.to_numpy()))
            vecs = [flat[e - n : e].tobytes() for e, n in zip(ends.tolist(), np.diff(lists.offsets.to_numpy()).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vecs, pa.binary()), pa.array(np.diff(lists.offsets.to_numpy()), pa.int32())], ["vec_id", "vec", "size"])

    return fine.mapInArrow(packed, "vec_id long, vec binary, size int"), dtype


# the graph and its parts


def _nearest(vectors: np.ndarray, among: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    """For each unit vector the k nearest of among (in no order), its own number left out."""
    out = np.empty((len(vectors), k), np.int64)
    for i in range(0, len(vectors), 256):
        near = vectors[i : i + 256] @ among.T
        if own is not None:
            near[np.arange(len(near)), own[i : i + 256]] = -np.inf
        out[i : i + 256] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def bisect(neighbours: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of nodes with few edges between them: by the sign of a slow eigenvector, then by exchanges."""
    local = np.full(len(neighbours), -1)
    local[nodes] = np.arange(len(nodes))
    to = local[neighbours[nodes]]
    source, target = np.repeat(np.arange(len(nodes)), to.shape[1])[to.ravel() >= 0], to.ravel()[to.ravel() >= 0]
    a, b, n = np.concatenate([source, target]), np.concatenate([target, source]), len(nodes)
    degree = np.maximum(np.bincount(a, minlength=n), 1)
    scale = 1 / np.sqrt(degree)
    flat = np.sqrt(degree / degree.sum())
    x = np.random.default_rng(_SEED).normal(size=n)
    for _ in range(60):  # power iteration, the constant vector taken out
        x = x + scale * np.bincount(a, weights=(scale * x)[b], minlength=n)
        x -= flat * (flat @ x)
        x /= np.linalg.norm(x)
    second = np.zeros(n, bool)
    second[np.argsort(x * scale, kind="stable")[n // 2 :]] = True
    for _ in range(20):
        gain = 2 * np.bincount(a, weights=second[a] != second[b], minlength=n) - degree
        here, there = (s[np.argsort(-gain[s], kind="stable")] for s in (np.flatnonzero(~second), np.flatnonzero(second)))
        pairs = min(len(here), len(there))
        swapped = int((gain[here[:pairs]] + gain[there[:pairs]] > 0).sum()) // 2  # half of them: neighbours shouldn't swap at once
        if not swapped:
            break
        second[here[:swapped]], second[there[:swapped]] = True, False
    return nodes[~second], nodes[second]


def balanced_parts(neighbours: np.ndarray, n_parts: int) -> np.ndarray:
    """The part of each node; n_parts is a power of two, and sizes differ by one at most."""
    parts = [np.arange(len(neighbours))]
    while len(parts) < n_parts:
        parts = [half for part in parts for half in bisect(neighbours, part)]
    label = np.empty(len(neighbours), np.int64)
    for i, part in enumerate(parts):
        label[part] = i
    return label


# the router


@dataclass(frozen=True)
class Router:
    """A network from unit vectors to parts. probes: how many parts a query visits."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        return np.maximum(vectors @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def order(self, vectors: np.ndarray) -> np.ndarray:
        """Parts of each vector, most probable first."""
        return np.argsort(-self.scores(vectors), axis=1, kind="stable")


def train(vectors: np.ndarray, wanted: np.ndarray, epochs: int = 30, hidden: int = HIDDEN) -> Router:
    """By Adam on the cross entropy with wanted: for each vector a distribution over parts."""
    rng = np.random.default_rng(_SEED)
    d, m = vectors.shape[1], wanted.shape[1]
    net = [rng.normal(size=(d, hidden)), np.zeros(hidden), rng.normal(size=(hidden, m)) / math.sqrt(hidden), np.zeros(m)]
    mean, square = [np.zeros_like(p) for p in net], [np.zeros_like(p) for p in net]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(vectors))
        for i in range(0, len(order), 256):
            x, y = vectors[order[i : i + 256]], wanted[order[i : i + 256]]
            h = np.maximum(x @ net[0] + net[1], 0)
            z = h @ net[2] + net[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            g = (p / p.sum(axis=1, keepdims=True) - y) / len(x)
            back = (g @ net[2].T) * (h > 0)
            step += 1
            for k, grad in enumerate((x.T @ back, back.sum(axis=0), h.T @ g, g.sum(axis=0))):
                mean[k] = 0.9 * mean[k] + 0.1 * grad
                square[k] = 0.999 * square[k] + 0.001 * grad**2
                net[k] -= 4e-3 * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    return Router(*net)


def probes_for(router: Router, vectors: np.ndarray, k: int, recall: float = RECALL) -> int:
    """The fewest parts with which vectors find that share of their nearest among themselves."""
    k = min(k, len(vectors) - 1)
    if k < 1:
        return len(router.b2)
    some = np.arange(min(len(vectors), 2048))
    near = _nearest(vectors[some], vectors, k, some)
    order = router.order(vectors)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
    ranks = np.sort(np.take_along_axis(place[some], order[:, 0][near], axis=1).ravel())
    return int(ranks[min(math.ceil(recall * len(ranks)), len(ranks)) - 1]) + 1


def fit(index: DataFrame, n: int, dtype: str, k: int = K, rows_per_part: int = ROWS_PER_PART) -> Router | None:
    """A router from a sample of index (vec), n vectors of equal length; None: one part is enough."""
    n_parts = min(1 << max(0, math.ceil(math.log2(max(n, 1) / rows_per_part))), MAX_PARTS)
    if n_parts == 1:
        return None
    size = max(LEAST_SAMPLE, SAMPLE_PER_PART * n_parts)
    picked = index.where(F.pmod(F.xxhash64("vec", F.lit(_SEED)), F.lit(1 << 40)) < int(size / n * (1 << 40))) if size < n else index
    vecs = [bytes(r["vec"]) for r in picked.select("vec").collect()]  # bounded by size
    vecs.sort(key=lambda v: xxhash.xxh64_intdigest(v, _SEED))  # an order that partitions don't decide
    sample = unit(np.stack([np.frombuffer(v, dtype) for v in vecs]))
    held = np.arange(len(sample)) % _HELD_OUT == 0
    seen = sample[~held]
    degree = min(DEGREE, len(seen) - 1)
    shared = index.sparkSession.sparkContext.broadcast(seen.astype(np.float32))

    def graph(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy()
            near = _nearest(shared.value[at], shared.value, degree, at)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near.tolist(), pa.list_(pa.int64()))], ["id", "near"])

    found = index.sparkSession.range(0, len(seen), 1, max(1, len(seen) // 1024)).mapInArrow(graph, "id long, near array<long>").collect()
    shared.unpersist()
    neighbours = np.array([r["near"] for r in sorted(found, key=lambda r: r["id"])], np.int64)
    part = balanced_parts(neighbours, n_parts)
    wanted = np.zeros((len(seen), n_parts))
    at = np.arange(len(seen))
    wanted[at, part] = degree / 4
    for j in range(degree):
        np.add.at(wanted, (at, part[neighbours[:, j]]), 1)
    router = train(seen, wanted / wanted.sum(axis=1, keepdims=True))
    return Router(router.w1, router.b1, router.w2, router.b2, probes_for(router, sample[held], k))


# index and search


def routed(vectors: DataFrame, router: Router | None, size: int | None, dtype: str, probes: int) -> DataFrame:
    """vectors with parts: the most probable ones; vectors of other lengths than size have their length's own part, below 0."""

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(batch.schema.get_field_index("size")).to_numpy()
            parts: list[list[int]] = [[-s] if s != size else [0] for s in sizes.tolist()]
            own = np.flatnonzero(sizes == size)
            if router is not None and len(own):
                vecs = unit(_rows(batch.column(batch.schema.get_field_index("vec")).take(pa.array(own)), dtype))
                for i, found in zip(own.tolist(), router.order(vecs)[:, :probes].tolist(), strict=True):
                    parts[i] = found
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.list_(pa.int32()))], [*batch.schema.names, "parts"])

    return vectors.mapInArrow(route, f"{', '.join(f'{c} {t}' for c, t in vectors.dtypes)}, parts array<int>")


def _ranked(candidates: pd.DataFrame, queries: pd.DataFrame, k: int, dtype: str) -> pd.DataFrame:
    """The k best of a block of candidates for each of a block of queries."""
    if candidates.empty or queries.empty:
        return pd.DataFrame({"key": pd.Series(dtype=object), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64"), "same": pd.Series(dtype=bool)})
    ids = candidates["vec_id"].to_numpy()
    c, q = (np.stack([np.frombuffer(v, dtype) for v in t["vec"]]) for t in (candidates, queries))
    units = unit(c)
    keys, found, scores, same = [], [], [], []
    take = min(k, len(ids))
    for i in range(0, len(q), 64):
        near = unit(q[i : i + 64]) @ units.T
        least = -np.partition(-near, take - 1, axis=1)[:, take - 1] - _NEAR
        for row, line in enumerate(near):
            at = np.flatnonzero(line >= least[row])
            exact = cosines(np.broadcast_to(q[i + row], (len(at), q.shape[1])), c[at])
            best = np.lexsort((ids[at], -exact))[:take]
            keys += [queries["key"].iloc[i + row]] * len(best)
            found.append(ids[at][best])
            scores.append(exact[best])
            same.append((c[at[best]] == q[i + row]).all(axis=1))
    return pd.DataFrame({"key": keys, "vec_id": np.concatenate(found), "score": np.concatenate(scores), "same": np.concatenate(same)})


def _block(key: Column, n: Column) -> Column:
    return F.pmod(F.xxhash64(key), n).cast("int")


def search(rows: DataFrame, is_query: Column, k: int = K, vec_id: str = "vec_id", vector: str = "embedding", rows_per_part: int = ROWS_PER_PART, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row where is_query, a condition on vec_id, holds."""
    vectors, dtype = usable(rows, vec_id, vector)
    vectors = cut(vectors)
    least = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    index = cut(vectors.distinct().withColumn("nth", least).where(F.col("nth") <= k + 1).drop("nth"))
    asked = vectors.where(is_query).distinct().withColumn("key", F.md5("vec"))
    once = cut(asked.groupBy("key").agg(F.first("vec").alias("vec"), F.first("size").alias("size")))
    lengths = index.groupBy("size").count().orderBy(F.desc("count"), "size").limit(1).collect()
    size, n = lengths[0] if lengths else (None, 0)
    router = fit(index.where(F.col("size") == size), n, dtype, k, rows_per_part) if lengths else None

    placed = cut(routed(index, router, size, dtype, 1).withColumn("part", F.col("parts")[0]).drop("parts"))
    going = cut(routed(once, router, size, dtype, router.probes if router else 1).withColumn("part", F.explode("parts")).drop("parts"))
    blocks = placed.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    q_blocks = going.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / block).alias("q_blocks"))
    grid = cut(blocks.join(q_blocks, "part"))  # a row for each part, of MAX_PARTS and one for each other length
    group = ["part", "block", "q_block"]
    held = placed.join(grid, "part").withColumn("block", _block(F.col("vec_id"), F.col("blocks")))
    held = held.withColumn("q_block", F.explode(F.sequence(F.lit(0), (F.col("q_blocks") - 1).cast("int")))).select(*group, "vec_id", "vec")
    sent = going.join(grid, "part").withColumn("q_block", _block(F.col("key"), F.col("q_blocks")))
    sent = sent.withColumn("block", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")))).select(*group, "key", "vec")
    best = held.groupBy(*group).cogroup(sent.groupBy(*group)).applyInPandas(lambda c, q: _ranked(c, q, k + 1, dtype), "key string, vec_id long, score double, same boolean")
    nearest = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    per_key = best.withColumn("nth", F.row_number().over(nearest)).where(F.col("nth") <= k + 1)
    # one of them may be the query's own row; without it k are left
    answers = per_key.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("nth", "vec_id", "score", "same"))).alias("found"))
    own = asked.select(F.col("vec_id").alias("query_id"), "key").join(answers, "key")
    left = F.slice(F.filter("found", lambda x: (x["vec_id"] != F.col("query_id")) | ~x["same"]), 1, k)
    return own.select("query_id", F.posexplode(left).alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")
