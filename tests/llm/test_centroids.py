import hashlib
import random

import numpy as np
import pytest

from presswork.llm import centroids

SMALL = "/root/testdata/sf0.001"
SPEC = "vec_id long, embedding array<double>, cluster string, v int, distance int"


def plain(rows, clusters, rounds, dims):
    """(id, vector) rows -> sorted result rows, by all distances of Python's whole numbers."""
    kept = [(i, [max(-(1 << 63), min((1 << 63) - 1, int(np.floor(256 * x)))) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    def mark(row):
        return (row[0] is None, hashlib.sha256(f"2:{row[0]}".encode()).hexdigest(), row[1])

    places = [v for _, v in sorted(kept, key=mark)[:clusters]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(places))
                for _, v in kept]

    for _ in range(rounds):
        given = assign()
        for n in range(len(places)):
            own = [v for (_, of), (_, v) in zip(given, kept) if of == n]
            if own:
                places[n] = [sum(column) // len(own) for column in zip(*own)]
    given, top = assign(), (1 << 63) - 1
    own = [min(top, sum(d for d, of in given if of == n)) for n in range(len(places))]
    return sorted(((i, of, min(top, d), own[of], min(top, sum(d for d, _ in given)),
                    hashlib.sha256(",".join(map(str, places[of])).encode()).hexdigest())
                   for (d, of), (i, _) in zip(given, kept)), key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], SPEC)
    return sorted((tuple(r) for r in centroids.cluster_vectors(df, **more).collect()), key=str)


def test_transform_keeps_distances_and_goes_from_coarse_to_fine():
    rng = np.random.default_rng(1)
    x, y = rng.integers(-999, 999, (2, 5, 64))
    far = (centroids.transformed(x) - centroids.transformed(y)) ** 2
    assert (far.sum(axis=1) == 64 * ((x - y) ** 2).sum(axis=1)).all()
    blocks = np.repeat(rng.integers(-9, 9, (5, 4)), 16, axis=1)
    assert not centroids.transformed(blocks)[:, 4:].any()
    assert centroids.transformed(x)[:, 0].tolist() == x.sum(axis=1).tolist()
    assert centroids.transformed(x[:, :1]).tolist() == x[:, :1].tolist()


@pytest.mark.parametrize("scale", [2, 300, 1 << 20, 1 << 50])
def test_search_finds_the_first_of_the_nearest(scale):
    rng = np.random.default_rng(scale)
    x, c = rng.integers(-scale, scale, (300, 64)), rng.integers(-scale, scale, (40, 64))
    c[7] = c[3]
    x[:4] = c[3]
    of, far, alive = centroids.nearest(x, c)
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)), n) for n, q in enumerate(c)) for p in x]
    assert [(int(d), int(n)) for d, n in zip(far, of)] == want
    assert alive[0] == 300 * 40


def test_far_centroids_are_out_early():
    rng = np.random.default_rng(5)
    c = np.repeat(rng.integers(-1000, 1000, (40, 4)), 16, axis=1)
    x = c[rng.integers(0, 40, 200)] + rng.integers(-2, 2, (200, 64))
    _, _, alive = centroids.nearest(x, c)
    assert alive[1] < alive[0] // 10


@pytest.mark.parametrize("dims, clusters, rounds", [(64, 6, 3), (4, 3, 2), (1, 2, 1), (8, 40, 5), (8, 5, 0)])
def test_against_all_distances(spark, monkeypatch, dims, clusters, rounds):
    monkeypatch.setattr(centroids, "ROWS", 16)
    rng = random.Random(dims)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.01, 1.0, rng.gauss(0, 1)]) for _ in range(dims)]) for i in range(60)]
    rows += rows[:7]
    assert run(spark, rows, clusters=clusters, rounds=rounds, dims=dims) == plain(rows, clusters, rounds, dims)


def test_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [9.0, 2.0]), (None, [1.0, 1.0]), (None, [5.0, 5.0]),
            (2, None), (3, []), (4, [1.0]), (5, [1.0, 2.0, 3.0]), (6, [None, 1.0]), (7, [nan, 1.0]),
            (8, [1.0, -inf]), (9, [-0.001, 0.0]), (10, [1e300, -1e300]), (11, [3e9, 0.0]), (12, [-1e300, 1e300])]
    for clusters in (1, 4, 99):
        assert run(spark, rows, clusters=clusters, dims=2) == plain(rows, clusters, 5, 2)
    assert run(spark, rows[5:9]) == [] and run(spark, []) == []
    with pytest.raises(ValueError, match="power of two"):
        run(spark, rows, dims=3)


def test_a_hot_vector_meets_in_sums_only(spark):
    rows = [(i, [1.0, 0.0] if i % 3 else [i / 100, 1.0]) for i in range(600)]
    assert run(spark, rows, clusters=3, dims=2) == plain(rows, 3, 5, 2)
