import hashlib
import math
import random

import numpy as np
import pytest

from shardloom.llm import centroids
from shardloom.llm.common import table
from shardloom.llm.queries import QUERIES, SQL
from tests.compare import connect, difference


def brute(rows, k, rounds, dims):
    """Clusters, distances and final centroids by comparing everything with everything."""
    good = lambda v: v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    kept = [(i, tuple(math.floor(64 * x) for x in v)) for i, v in rows if good(v)]
    key = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centers = [q for _, q in sorted(kept, key=key)[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda q: min((apart(q, c), j) for j, c in enumerate(centers))
    for _ in range(rounds):
        members = [[] for _ in centers]
        for _, q in kept:
            members[nearest(q)[1]].append(q)
        centers = [tuple(sum(x) // len(m) for x in zip(*m)) if m else c for m, c in zip(members, centers)]
    return [(i, *nearest(q)[::-1]) for i, q in kept], centers


def check(spark, rows, k, rounds, dims):
    docs = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, cluster int")
    got, centers = centroids.clusters(docs.repartition(4), k, rounds, dims)
    wanted, final = brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], k, rounds, dims)
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted([tuple(r)[:3] for r in got.collect()], key=key) == sorted(wanted, key=key)
    assert [tuple(c) for c in centers] == final
    return got


@pytest.mark.parametrize("rounds", [0, 1, 6])
def test_equals_brute_force(spark, rounds):
    random.seed(rounds)
    spots = [[random.uniform(-2, 2) for _ in range(3)] for _ in range(5)]
    rows = [(i, [x + random.gauss(0, 0.2) for x in random.choice(spots)]) for i in range(400)]
    rows += [(i, [0.5, 0.5, 0.5]) for i in range(400, 460)] + [(7, [0.5, 0.5, 0.5])] * 3 + [(None, [1.0, 2.0, 3.0])]
    rows += [(900, None), (901, []), (902, [1.0, 2.0]), (903, [1.0, None, 2.0]), (904, [1.0, math.nan, 0.0])]
    rows += [(905, [1.0, math.inf, 0.0]), (906, [1.0] * 4)]
    got = check(spark, rows, 5, rounds, 3)
    if rounds == 6:  # bounds must save most of the comparisons
        scans = [r["scans"] for r in got.collect()]
        assert sum(scans) < 0.6 * len(scans) * (rounds + 1)


def test_ties_large_numbers_and_few_vectors(spark):
    grid = [(i, [float(i % 4), float(i // 4 % 4)]) for i in range(64)]
    check(spark, grid, 6, 4, 2)
    check(spark, [(i, [x * 3e5 for x in v]) for i, v in grid], 6, 4, 2)
    check(spark, grid[:3], 16, 2, 2)
    check(spark, grid[:1], 1, 2, 2)
    none, centers = centroids.clusters(spark.createDataFrame([], "vec_id long, embedding array<float>"), 4, 2, 2)
    assert none.collect() == [] and centers == [] and centroids.with_inertia(none, centers).count() == 0


def test_components_beyond_longs_are_an_error(spark):
    rows = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="a component times 64"):
        centroids.clusters(rows, 2, 1, 2)


def test_whole_displacement_is_the_loosening():
    """A centroid that comes back loosens nothing, though its moves add up."""
    q = np.array([[0, 0]])
    history = np.array([[[1, 0], [9, 0]], [[8, 0], [9, 0]], [[1, 0], [9, 0]]])
    state = {"cluster": np.array([-1]), "previous": np.array([-1]), "upper": np.zeros(1), "upper_round": np.array([0])}
    state |= {"lower": np.zeros(1), "lower_round": np.array([0]), "scans": np.array([0])}
    first = centroids.assign(q, state, history[:1])
    back = centroids.assign(q, first, history)
    assert first["scans"][0] == back["scans"][0] == 1 and back["upper_round"][0] == 0


def test_query(spark, sf_dir):
    got = QUERIES["op11_centroids"](spark, sf_dir)
    assert difference(got, SQL["op11_centroids"], connect(sf_dir)) is None
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, sf_dir, "embeddings").collect()]
    wanted, final = brute(rows, 16, 3, 64)
    assert {(r["vec_id"], r["cluster"], r["distance"]) for r in got.collect()} == set(wanted)
    sha = {j: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for j, c in enumerate(final)}
    assert all(r["centroid_sha256"] == sha[r["cluster"]] for r in got.collect())
