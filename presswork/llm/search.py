"""Exact search for the largest inner products, by KD-trees over shards of the vectors."""

import heapq
import io
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

TOP = 5
SHARD_ROWS = 4096
BLOCK_ROWS = 512
LEAF_ROWS = 128
#: Sums up to here are exact as floating-point numbers of 32 and of 64 bits.
SMALL, EXACT = 1 << 24, 1 << 53
#: Trees that one task holds at most.
TREES = 16
LARGEST, LEAST = (1 << 63) - 1, -(1 << 63)


def _narrow(numbers: np.ndarray) -> np.ndarray:
    """The whole numbers in as few bytes each as all of them fit in."""
    low, high = numbers.min(initial=0), numbers.max(initial=0)
    fits = (t for t in (np.int8, np.int16, np.int32) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return numbers.astype(next(fits, np.int64))


def _packed(**arrays: np.ndarray) -> bytes:
    file = io.BytesIO()
    np.savez(file, **arrays)
    return file.getvalue()


def _opened(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as file:
        return dict(file)


def build_tree(ids: np.ndarray, points: np.ndarray, leaf_rows: int = LEAF_ROWS,
               top: int = TOP) -> dict[str, np.ndarray]:
    """A KD-tree: each node is split at the median of its widest dimension, with a tight box.

    ``left`` and ``right`` are child nodes (-1: a leaf), ``begin`` and ``end``
    the node's rows of ``ids`` and ``points``. Of equal points only the
    ``top`` + 1 smallest ids stay: no query can have others among its results.
    """
    order = np.argsort(ids, kind="stable")
    ids, points = ids[order], points[order]
    rows, low, high, left, right, begin, end = [], [], [], [], [], [], []
    count = 0

    def add(members: np.ndarray) -> int:
        nonlocal count
        node, part = len(low), points[members]
        low.append(part.min(axis=0))
        high.append(part.max(axis=0))
        for column in (left, right, begin, end):
            column.append(-1)
        wide = high[node] - low[node] if part.shape[1] else np.zeros(1)
        same = not wide.any()
        begin[node] = count
        if same or len(members) <= leaf_rows:
            members = np.sort(members)[:top + 1] if same else members
            rows.append(members)
            count += len(members)
        else:
            values = part[:, int(np.argmax(wide))]
            middle = np.median(values)
            below = values < middle if (values < middle).any() else values <= middle
            left[node] = add(members[below])
            right[node] = add(members[~below])
        end[node] = count
        return node

    if len(ids):
        add(np.arange(len(ids)))
    at = np.concatenate(rows) if rows else np.empty(0, np.int64)
    return {"ids": ids[at], "points": points[at], "low": np.array(low), "high": np.array(high),
            "left": np.array(left), "right": np.array(right), "begin": np.array(begin),
            "end": np.array(end)}


def _best(query: np.ndarray, scores: np.ndarray, ids: np.ndarray, top: int) -> tuple[np.ndarray, ...]:
    """The ``top`` best of each query, in order: by falling score, then by id, equal ones once."""
    order = np.lexsort((ids, ~scores, query))
    query, scores, ids = query[order], scores[order], ids[order]
    other = np.ones(len(query), bool)
    other[1:] = (query[1:] != query[:-1]) | (scores[1:] != scores[:-1]) | (ids[1:] != ids[:-1])
    query, scores, ids = query[other], scores[other], ids[other]
    some = np.arange(len(query)) - np.searchsorted(query, query) < top
    return query[some], scores[some], ids[some]


def _walk(tree: dict[str, np.ndarray], query_ids: np.ndarray, queries: np.ndarray, need: np.ndarray,
          found: tuple[np.ndarray, ...], top: int) -> tuple[np.ndarray, ...]:
    """``found`` with what the tree adds to it; raises the scores that the queries ``need``."""
    limits = [max(int(a.max(initial=0)), -int(a.min(initial=0))) for a in (queries, tree["low"], tree["high"])]
    most = limits[0] * max(limits[1:]) * max(queries.shape[1], 1)
    kind = np.float32 if most < SMALL else np.float64 if most < EXACT else object
    points, low, high, wanted = (a.astype(kind) for a in (tree["points"], tree["low"], tree["high"], queries))

    def within(sums: np.ndarray) -> np.ndarray:
        return np.clip(sums, LEAST, LARGEST) if kind is object else sums

    bounds = within(np.maximum(wanted, 0) @ high.T + np.minimum(wanted, 0) @ low.T)
    left, right = tree["left"].tolist(), tree["right"].tolist()
    begin, end, ids = tree["begin"].tolist(), tree["end"].tolist(), tree["ids"]
    floor, met, held = need.astype(kind), [], 0

    def visit(leaf: int, rows: np.ndarray) -> None:
        nonlocal held
        a, b = begin[leaf], end[leaf]
        scores = within((wanted if len(rows) == len(wanted) else wanted[rows]) @ points[a:b].T)
        row, place = np.nonzero(scores >= floor[rows, None])
        other = ids[a:b][place] != query_ids[rows[row]]
        row, place = row[other], place[other]
        met.append((rows[row], scores[row, place].astype(np.int64), ids[a:b][place]))
        held += len(row)

    def settle() -> None:
        nonlocal found, held
        found = _best(*map(np.concatenate, zip(found, *met)), top)
        count = np.bincount(found[0], minlength=len(need))
        full, last = count == top, count.cumsum() - 1
        need[full] = np.maximum(need[full], found[1][last[full]])
        floor[:] = need.astype(kind)
        met.clear()
        held = 0

    seen, new = np.full(len(need), -1), np.flatnonzero(need == LEAST)
    if len(new):
        leaves = np.flatnonzero(tree["left"] < 0)
        seen[new] = leaves[np.argmax(bounds[new][:, leaves], axis=1)]
        for leaf in np.unique(seen[new]).tolist():
            visit(leaf, new[seen[new] == leaf])
        settle()
    waiting = [(0, 0, np.arange(len(need)))]
    while waiting:
        _, node, rows = heapq.heappop(waiting)
        rows = rows[bounds[rows, node] >= floor[rows]]
        if not len(rows):
            continue
        if left[node] >= 0:
            for child in (left[node], right[node]):
                heapq.heappush(waiting, (-bounds[rows, child].max(), child, rows))
            continue
        visit(node, rows[seen[rows] != node])
        if held > top * len(need):
            settle()
    settle()
    return found


def search_trees(trees: Iterable[dict[str, np.ndarray]], query_ids: np.ndarray, queries: np.ndarray,
                 floors: np.ndarray, top: int = TOP) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """What may be among the ``top`` of each query in all trees together, and the score that each then needs.

    The former has the numbers of queries in order, scores and ids, best first.
    Nodes are visited by falling bound of their box's inner product with a query,
    all queries that are left at a node together. A query goes on only where that
    bound reaches the score that it needs: the ``top``-th found so far, in the trees
    before as well, or its entry of ``floors``, which other shards have brought, if
    that is more. One that has neither begins with the leaf of its largest bound.
    Equal bounds are followed, for smaller ids. An id equal to the query's is left
    out, and what has both score and id in common counts once.
    """
    need, found = floors.astype(np.int64), (np.empty(0, np.int64),) * 3
    for tree in trees:
        found = _walk(tree, query_ids, queries, need, found, top)
    return found, need


def search_tree(tree: dict[str, np.ndarray], query_ids: np.ndarray, queries: np.ndarray,
                floors: np.ndarray, top: int = TOP) -> list[list[tuple[int, int]]]:
    """For each query the (score, id) pairs of the tree that may be among its ``top``, best first."""
    (query, scores, ids), _ = search_trees([tree], query_ids, queries, floors, top)
    ends = np.searchsorted(query, np.arange(len(query_ids) + 1))
    pairs = list(zip(scores.tolist(), ids.tolist()))
    return [pairs[a:b] for a, b in zip(ends[:-1], ends[1:])]


def scaled(embedding: F.Column, factor: int = 256) -> F.Column:
    """floor(factor * x) of each component, null if the vector is null or has a null or non-finite one."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x)
                    & (F.abs(x.cast("double")) != float("inf")))
    return F.when(fine, F.transform(embedding, lambda x: F.floor(x.cast("double") * factor)))


def top_inner_products(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                       every: int = 50, top: int = TOP, shard_rows: int = SHARD_ROWS,
                       block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For each query its ``top`` largest scores: query_id, rank (from 1), vec_id, score.

    Queries are the rows whose id is divisible by ``every``, candidates all rows
    with another id. The score is the inner product of the components as whole
    numbers, floor(256 * x); ties go to the smaller id. Vectors that are null or
    hold null or non-finite components take no part, nor do rows with a null id.
    Vectors only meet others of their length. Rows repeated with id and vector
    count once; queries of one id with different vectors share one result. Scores
    beyond the range of a long stop at its ends.

    Vectors are dealt by a hash of the id into shards of about ``shard_rows``,
    each a KD-tree, and queries into blocks of about ``block_rows``. First each
    block searches one shard; the score that its queries then have at rank
    ``top`` is the floor that they bring to all shards. A task has a few shards,
    at most :data:`TREES`, which the blocks search one by one and raise their
    floors. So it holds these trees and one block, whatever the size of the table,
    and every block meets every tree: the query set against all rows. A tree is
    sent once, a block once per task.
    """
    rows = stored(
        vectors.select(F.col(id_col).cast("long").alias("id"), scaled(F.col(vector_col)).alias("v"))
        .where("id is not null and v is not null").distinct()
        .withColumn("dims", F.size("v")), "vectors")
    asked = rows.where(f"id % {every} = 0")
    shards = max(1, -(-rows.count() // shard_rows))
    blocks = max(1, -(-asked.count() // block_rows))
    home = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64(F.col("id") + 1), F.lit(blocks)).cast("int")

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = table["id"].to_numpy()
        flat = table["v"].combine_chunks().flatten().to_numpy()
        return ids, flat.reshape(len(ids), -1) if len(flat) else np.zeros((len(ids), 0), np.int64)

    def one_row(key, data: bytes) -> pa.Table:
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()),
                         "dims": pa.array([key[1].as_py()], pa.int32()),
                         "data": pa.array([data], pa.binary())})

    def plant(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        tree = build_tree(*matrix(table), top=top)
        return one_row(key, _packed(**tree | {c: _narrow(tree[c]) for c in ("points", "low", "high")}))

    def gather(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, points = matrix(table)
        return one_row(key, _packed(ids=ids, points=_narrow(points), floors=np.full(len(ids), LEAST)))

    def first(batches):
        for batch in batches:
            for row in batch.to_pylist():
                asking = _opened(row["data"])
                _, asking["floors"] = search_trees(
                    [_opened(row["tree"])], asking["ids"], asking["points"], asking["floors"], top)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]], pa.int32()), pa.array([row["dims"]], pa.int32()),
                     pa.array([_packed(**asking)], pa.binary())], ["part", "dims", "data"])

    def search(batches):
        """Rows in order: of each length the trees, then the blocks that search them."""
        dims, grown = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["dims"] != dims:
                    dims, grown = row["dims"], []
                data = _opened(row["data"])
                if not row["asks"]:
                    grown.append(data)
                    continue
                (query, scores, found), _ = search_trees(
                    grown, data["ids"], data["points"], data["floors"], top)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in (data["ids"][query], found, scores)], ["query_id", "vec_id", "score"])

    spec = "part int, dims int, data binary"
    trees = stored(rows.withColumn("part", home).groupBy("part", "dims").applyInArrow(plant, spec)
                   .select(F.col("part").alias("shard"), "dims", F.col("data").alias("tree")), "trees")
    packed = stored(asked.withColumn("part", block).groupBy("part", "dims").applyInArrow(gather, spec),
                    "query-blocks")
    # a block whose shard has no vector of its length keeps its lowest floors
    start = packed.withColumn("shard", F.pmod("part", F.lit(shards)).cast("int"))
    brought = stored(start.join(trees, ["shard", "dims"]).mapInArrow(first, spec), "floors")
    brought = brought.unionByName(packed.join(brought, ["part", "dims"], "left_anti"))
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    tasks = -(-shards // min(TREES, max(1, shards // (4 * cores))))
    dealt = trees.select(F.pmod("shard", F.lit(tasks)).alias("task"), "dims", F.lit(False).alias("asks"),
                         F.col("tree").alias("data")).unionByName(
        brought.select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), "dims",
                       F.lit(True).alias("asks"), "data"))
    found = (dealt.repartitionById(tasks, "task").sortWithinPartitions("dims", "asks")
             .mapInArrow(search, "query_id long, vec_id long, score long").distinct())
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("query_id", "rank", "vec_id", "score"))
