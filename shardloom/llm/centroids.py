"""Exact k-means that skips most distances by ns-bounds.

Every vector keeps its cluster, an upper bound on the distance to its own centroid and a lower bound
on the distance to all others, each with the round in which it was worked out. All centroids of all
rounds are kept (rounds * k * dimensions numbers). In a later round a bound is loosened by how far
centroids lie from where they were in the bound's own round: the norm of the whole displacement,
which is never more than the sum of the moves in between. A vector whose bounds still hold apart
keeps its cluster unseen; otherwise the own distance is renewed, and only if that fails as well
are all centroids compared, exactly, in whole numbers.

Vectors travel with their bounds from round to round as written tables, so a lost executor costs its
tasks only. Between rounds the driver holds k sums, updated by the vectors that changed cluster.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.session import materialize, ship_package

SCALE = 64
# Doubles count whole numbers exactly up to here, products and sums of a distance included.
EXACT = 1 << 52
STATE = "cluster int, previous int, upper double, upper_round int, lower double, lower_round int, scans int"


def largest_component(dims: int) -> int:
    """Below it, squared distances of ``dims`` components fit a long."""
    return math.isqrt((1 << 62) // max(dims, 1)) // 2


def quantized(vectors: DataFrame, dims: int, scale: int = SCALE, name: str = "embedding") -> DataFrame:
    """vec_id and q (floor(scale * component), whole numbers) of vectors with ``dims`` finite components.

    Others (null, shorter, longer, with a null, NaN or infinite component) are left out. A component
    so large that distances would not fit a long is an error.
    """
    infinite = F.lit(float("inf"))
    vector = F.transform(name, lambda x: x.cast("double"))
    whole = (F.size(vector) == dims) & F.forall(vector, lambda x: F.coalesce(F.abs(x) < infinite, F.lit(False)))
    limit = F.lit(float(largest_component(dims)))
    message = F.lit(f"a component times {scale} reaches {largest_component(dims)}")
    q = F.transform(
        vector, lambda x: F.when(F.abs(x * scale) < limit, F.floor(x * scale).cast("int")).otherwise(F.raise_error(message).cast("int"))
    )
    return vectors.where(F.coalesce(whole, F.lit(False))).select("vec_id", q.alias("q"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest sha256 of "seed:vec_id"; of equal ids the smaller vector first.
    A null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [list(r["q"]) for r in rows.select("q", digest.alias("_h")).orderBy("_h", "q").limit(k).collect()]


def squared(q: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, a column per centroid."""
    largest = max(int(np.abs(q).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * q.shape[1] * largest * largest < EXACT:
        a, b = q.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return np.stack([((q - c) ** 2).sum(1) for c in centroids], axis=1)


def own_squared(q: np.ndarray, centroids: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    return ((q - centroids[cluster]) ** 2).sum(1)


def assign(q: np.ndarray, state: dict[str, np.ndarray], history: np.ndarray) -> dict[str, np.ndarray]:
    """New state of vectors ``q`` under the last centroids of ``history`` (rounds, k, dims)."""
    now, (k, _) = len(history) - 1, history[-1].shape
    state = {name: values.copy() for name, values in state.items()}
    cluster = state["previous"] = state["cluster"].copy()
    moved = np.sqrt(((history[-1][None] - history).astype(np.float64) ** 2).sum(2))  # (round, centroid)
    # The farthest of the other centroids: the farthest of all, or the second where that is the own one.
    order = np.argsort(moved, axis=1)
    farthest, far = order[:, -1], np.take_along_axis(moved, order[:, -1:], 1)[:, 0]
    second = np.take_along_axis(moved, order[:, -2:-1], 1)[:, 0] if k > 1 else np.zeros(len(history))
    known = np.flatnonzero(cluster >= 0)
    since = state["lower_round"][known]
    lower = state["lower"][known] - np.where(farthest[since] == cluster[known], second[since], far[since])
    upper = state["upper"][known] + moved[state["upper_round"][known], cluster[known]]
    # Strictly apart, beyond what rounding of roots could hide: a tie is always rescanned.
    apart = lambda low, high: low > high * (1 + 1e-9) + 1e-9
    doubtful = np.flatnonzero(~apart(lower, upper))
    at = known[doubtful]
    state["upper"][at] = np.sqrt(own_squared(q[at], history[-1], cluster[at]).astype(np.float64))
    state["upper_round"][at] = now
    failed = at[~apart(lower[doubtful], state["upper"][at])]
    scan = np.concatenate([np.flatnonzero(cluster < 0), failed])
    if len(scan):
        distances = squared(q[scan], history[-1])
        nearest = np.argmin(distances, axis=1)  # of ties the smaller number
        state["cluster"][scan] = nearest
        state["upper"][scan] = np.sqrt(distances[np.arange(len(scan)), nearest].astype(np.float64))
        distances[np.arange(len(scan)), nearest] = np.iinfo(np.int64).max
        rest = distances.min(axis=1).astype(np.float64)
        state["lower"][scan] = np.sqrt(rest) if k > 1 else np.inf
        state["upper_round"][scan] = state["lower_round"][scan] = now
        state["scans"][scan] += 1
    return state


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def assigned(rows: DataFrame, history: np.ndarray, last: bool) -> DataFrame:
    """One pass over all vectors; the last one adds their exact ``distance``."""
    dims = history.shape[2]
    columns = [part.split() for part in STATE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = matrix(batch.column("q"), dims)
            state = assign(q, {name: batch.column(name).to_numpy() for name, _ in columns}, history)
            kinds = {"int": pa.int32(), "double": pa.float64()}
            out = [batch.column("vec_id"), batch.column("q"), *[pa.array(state[n], kinds[t]) for n, t in columns]]
            names = ["vec_id", "q", *[n for n, _ in columns]]
            if last:
                out.append(pa.array(own_squared(q, history[-1], state["cluster"]), pa.int64()))
                names.append("distance")
            yield pa.RecordBatch.from_arrays(out, names)

    id_type = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {id_type}, q array<int>, {STATE}" + (", distance bigint" if last else ""))


def add_moves(rows: DataFrame, sums: list[list[int]], counts: list[int]) -> None:
    """Update the clusters' sums and counts by the vectors that changed cluster, k rows at most."""
    dims = len(sums[0])
    sides = F.array(
        F.struct(F.col("cluster").alias("c"), F.lit(1).alias("sign")), F.struct(F.col("previous").alias("c"), F.lit(-1).alias("sign"))
    )
    moves = rows.where("cluster <> previous").select("q", F.inline(sides)).where("c >= 0")
    parts = [F.sum(F.col("q")[i].cast("bigint") * F.col("sign")).alias(f"s{i}") for i in range(dims)]
    for row in moves.groupBy("c").agg(F.sum("sign").alias("n"), *parts).collect():
        counts[row["c"]] += row["n"]
        sums[row["c"]] = [a + row[f"s{i}"] for i, a in enumerate(sums[row["c"]])]


def clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, seed: int = 1, scale: int = SCALE) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance, scans) of every usable vector, and the final centroids.

    Each round assigns every vector to its nearest centroid (squared distance in whole numbers, of
    ties the smaller number) and moves every centroid that has vectors to the floor of their mean;
    after the last one vectors are assigned once more. ``scans`` counts the passes in which a vector
    was compared with all centroids. Repeated rows are vectors of their own. With fewer vectors than
    ``k`` there are as many centroids; without any there are no rows. Other columns are left out.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    start = {"cluster": "-1", "previous": "-1", "upper": "0d", "upper_round": "0", "lower": "0d", "lower_round": "0", "scans": "0"}
    rows = quantized(vectors, dims, scale)
    rows = materialize(rows.select("*", *[F.expr(v).alias(n) for n, v in start.items()]), "vectors")
    centroids = first_centroids(rows, k, seed)
    if not centroids:
        return rows.select("vec_id", "cluster", F.lit(0).cast("bigint").alias("distance"), "scans"), []
    history = np.array([centroids], dtype=np.int64)
    sums, counts = [[0] * dims for _ in centroids], [0] * len(centroids)
    for _ in range(rounds):
        rows = materialize(assigned(rows, history, False), "vectors")
        add_moves(rows, sums, counts)
        centroids = [[s // n for s in total] if n else old for total, n, old in zip(sums, counts, centroids)]
        history = np.concatenate([history, np.array([centroids], dtype=np.int64)])
    rows = assigned(rows, history, True).select("vec_id", "cluster", "distance", "scans")
    return materialize(rows, "clusters"), centroids


def with_inertia(found: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Adds cluster_inertia, inertia (sums of distances) and centroid_sha256."""
    spark = found.sparkSession
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    sha = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    per_cluster = [(c, sums[c], sum(sums.values()), sha(centroids[c])) for c in sorted(sums)]
    table = spark.createDataFrame(per_cluster, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster")  # k rows
