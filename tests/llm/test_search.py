import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from presswork.llm import queries, search


def plain(rows, top=5, every=50):
    """(id, vector) rows -> (query, rank, id, score), by all pairs of whole numbers."""
    fine = {(i, tuple(int(np.floor(np.float64(x) * 256)) for x in v)) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    found = {}
    for i, v in fine:
        if i % every == 0:
            scores = {(-sum(a * b for a, b in zip(v, w)), j) for j, w in fine
                      if j != i and len(w) == len(v)}
            found.setdefault(i, set()).update(scores)
    return sorted((i, r + 1, j, -s) for i, scores in found.items()
                  for r, (s, j) in enumerate(sorted(scores)[:top]))


def vectors(rng, count, dims, copies):
    made = []
    for i in range(count):
        v = rng.choice(made)[1] if made and rng.random() < copies else [
            float(np.float32(rng.gauss(0, 0.2))) for _ in range(dims)]
        made.append((i * 5, v))
    return made


SPEC = "vec_id long, embedding array<float>, score string, v int"


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SPEC)
    return sorted(tuple(r) for r in search.top_inner_products(df, **more).collect())


@pytest.mark.parametrize("dims, copies, shard, block", [
    (3, 0.0, 50, 7), (3, 0.8, 4096, 512), (8, 0.5, 30, 3), (64, 0.3, 100, 10)])
def test_against_all_pairs(spark, monkeypatch, dims, copies, shard, block):
    monkeypatch.setattr(search, "LEAF_ROWS", 8)
    rows = vectors(random.Random(dims + shard), 400, dims, copies)
    assert run(spark, rows, shard_rows=shard, block_rows=block) == plain(rows)


def test_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [0.5, -2.0]), (50, [1.0]), (100, []), (150, None),
            (200, [nan, 1.0]), (250, [inf, 1.0]), (300, [None, 1.0]), (None, [1.0, 2.0]), (3, [1.0, 2.0]),
            (4, [1.0, 2.0]), (7, [-1.0, 0.25]), (8, [1.0, 2.0]), (9, [1.0, 2.0]), (11, [1.0, 2.0]),
            (13, [2.5]), (14, []), (-50, [1.0, 2.0])]
    assert run(spark, rows) == plain(rows)
    assert run(spark, []) == []


def test_scores_beyond_floats_and_longs(spark):
    big = [(0, [3e9, 1.0]), (1, [3e9, 1.0]), (2, [3e9, 1.00390625]), (3, [1e30, 0.0]), (4, [-1e30, 0.0])]
    got = run(spark, big)
    assert [(r[2], r[3]) for r in got] == [(1, search.LARGEST), (2, search.LARGEST),
                                           (3, search.LARGEST), (4, search.LEAST)]
    exact = [(0, [3e6, 1.0]), (1, [3e6, 1.0]), (2, [3e6, 1.00390625]), (3, [3e6, 0.99609375])]
    assert run(spark, exact) == plain(exact) and run(spark, exact)[0][2] == 2


def test_leaves_with_equal_points_stay_small():
    tree = search.build_tree(np.arange(1000), np.ones((1000, 4), np.int64))
    assert len(tree["ids"]) == 6


def test_far_nodes_are_not_visited(monkeypatch):
    rng = np.random.default_rng(1)
    points = rng.integers(-500, 500, (4000, 2))
    tree = search.build_tree(np.arange(4000), points, 16)
    visited = []
    pop = search.heapq.heappop
    monkeypatch.setattr(search.heapq, "heappop", lambda h: visited.append(1) or pop(h))
    search.search_tree(tree, np.array([-1]), np.array([[300, 400]]), np.array([search.LEAST]))
    assert len(visited) < len(tree["left"]) / 5


def test_query_against_all_pairs(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = sorted(tuple(r) for r in queries.QUERIES["op3_top_k"](spark, folder).collect())
    assert got == plain(rows)


def test_queries_walk_a_tree_together(monkeypatch):
    """A node is opened once for all queries of a block, also where no box can be left out."""
    rng = np.random.default_rng(2)
    points, asked = rng.integers(-150, 150, (3000, 32)), rng.integers(-150, 150, (200, 32))
    tree = search.build_tree(np.arange(3000), points, 16)
    visited = []
    pop = search.heapq.heappop
    monkeypatch.setattr(search.heapq, "heappop", lambda h: visited.append(1) or pop(h))
    got = search.search_tree(tree, np.arange(200), asked, np.full(200, search.LEAST))
    scores = asked @ points.T
    assert got == [sorted(((int(s), i) for i, s in enumerate(row) if i != q), key=lambda x: (-x[0], x[1]))[:5]
                   for q, row in enumerate(scores)]
    assert len(visited) <= len(tree["left"])


@pytest.mark.parametrize("size, kind", [(3, np.int8), (150, np.int16), (30_000, np.int16), (1 << 29, np.int32),
                                        (1 << 32, np.int64)])
def test_trees_one_after_the_other(size, kind):
    """Floors rise from tree to tree, and numbers of any size are summed exactly."""
    rng = np.random.default_rng(3)
    points, ids = rng.integers(-size, size, (600, 8)), rng.permutation(600)
    points[:, 0] = np.where(points[:, 0] > 0, size - 1, -size)
    trees = [search.build_tree(ids[a::3], points[a::3], 16) for a in range(3)]
    trees = [t | {c: search._narrow(t[c]) for c in ("points", "low", "high")} for t in trees]
    assert trees[0]["points"].dtype == kind
    asked, names = points[:60], ids[:60]
    (query, scores, found), need = search.search_trees(
        trees, names, search._narrow(asked), np.full(60, search.LEAST))
    sums = lambda v, w: sum(int(a) * int(b) for a, b in zip(v, w))
    want = [sorted(((max(search.LEAST, min(search.LARGEST, sums(v, w))), int(j)) for w, j in zip(points, ids) if j != i),
                   key=lambda x: (-x[0], x[1]))[:5] for v, i in zip(asked, names)]
    assert [(int(s), int(i)) for s, i in zip(scores, found)] == [pair for row in want for pair in row]
    assert need.tolist() == [row[-1][0] for row in want] and query.tolist() == [q for q in range(60) for _ in range(5)]


def test_equal_scores_of_one_id_leave_room_for_others(spark):
    rows = [(0, [1.0, 0.0])] + [(7, [1.0, float(k)]) for k in range(9)] + [(k, [0.5, float(k)]) for k in range(1, 6)]
    assert run(spark, rows) == plain(rows) and len(plain(rows)) == 5


def test_trees_are_sent_once(spark, monkeypatch):
    """What goes to the tasks that search is each tree once and each block once a task, in small numbers."""
    sent = []
    real = type(spark.range(0)).repartitionById

    def dealt(df, parts, by):
        sent.append((parts, df.groupBy("asks").agg(F.count("*"), F.max(F.length("data"))).collect()))
        return real(df, parts, by)

    monkeypatch.setattr(type(spark.range(0)), "repartitionById", dealt)
    rows = vectors(random.Random(6), 600, 16, 0.0)
    assert run(spark, rows, shard_rows=10, block_rows=20) == plain(rows)
    (parts, counts), = sent
    counts = {asks: (n, size) for asks, n, size in counts}
    assert parts < counts[False][0] <= 60 and counts[True][0] <= parts * 3
    assert counts[True][1] < 20 * 16 * 8
