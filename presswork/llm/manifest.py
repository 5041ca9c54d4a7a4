"""A Merkle manifest of documents: leaf places by ranks in bitmaps, trees level by level in slot arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

#: A container has the ids that agree in all but their last 16 bits.
BITS = 16
#: Slots of an array; a round reduces a tree by that many times.
SLOTS = 1024
LEVELS = 10
#: Leaves of a container that one task ranks, on average.
SHARE = 1 << 13
#: Equal rows that are numbered in one go.
COPIES = 4096
#: Ids from which on a container is a bitmap and not a list of its low bits.
DENSE = 4096

#: Where rows without an id stand: before all containers of ids.
_NOWHERE = -(1 << 47) - 1


def digest(*parts: bytes) -> bytes:
    """SHA-256 of hex texts of digests, as raw bytes."""
    return hashlib.sha256(b"".join(p.hex().encode() for p in parts)).digest()


def framed(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The leaf of a row, as raw bytes."""
    return F.unhex(F.sha2(F.concat(*map(framed, values)), 256))


# --- ranks ---------------------------------------------------------------------------------------

def container(lows: np.ndarray, counts: np.ndarray) -> dict:
    """A compressed bitmap of ``lows`` (rising, each once) and what ``counts`` have over one.

    Few ids are a list of 16-bit numbers; many are 1,024 words of 64 bits. The
    ids with more than one row stand apart with their surplus rows.
    """
    if len(lows) < DENSE:
        bits = lows.astype("<u2").tobytes()
    else:
        marks = np.zeros(1 << BITS, np.uint8)
        marks[lows] = 1
        bits = np.packbits(marks, bitorder="little").tobytes()
    again = counts > 1
    return {"ids": len(lows), "rows": int(counts.sum()), "bits": bits,
            "again": lows[again].astype("<u2").tobytes(),
            "surplus": (counts[again] - 1).astype("<i8").tobytes()}


def members(bits: bytes, ids: int) -> np.ndarray:
    """The low bits of a container's ids, rising."""
    if ids < DENSE:
        return np.frombuffer(bits, "<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))


class Ranks:
    """Rows of a container before an id: a directory of popcounts, and sums of surplus rows."""

    def __init__(self, ids: int, bits: bytes, again: bytes, surplus: bytes):
        self.words = None
        if ids < DENSE:
            self.lows = np.frombuffer(bits, "<u2")
        else:
            self.words = np.frombuffer(bits, "<u8")
            self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])
        self.again = np.frombuffer(again, "<u2")
        self.surplus = np.concatenate([[0], np.cumsum(np.frombuffer(surplus, "<i8"))])

    def of(self, lows: np.ndarray) -> np.ndarray:
        if self.words is None:
            rank = np.searchsorted(self.lows, lows)
        else:
            word, bit = lows >> 6, (lows & 63).astype(np.uint64)
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            rank = self.before[word] + np.bitwise_count(below)
        return rank + self.surplus[np.searchsorted(self.again, lows)]


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place (exclusive) of each run of equal rows."""
    count = len(columns[0])
    new = np.ones(count, bool)
    if count:
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    first = np.flatnonzero(new)
    return first, np.append(first[1:], count)


def _part_bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One compressed bitmap per container that a batch has ids of."""
    for batch in batches:
        tree, place, low, n = (np.asarray(batch[c]) for c in ("tree", "container", "low", "n"))
        order = np.lexsort((low, place, tree))
        tree, place, low, n = tree[order], place[order], low[order], n[order]
        found = []
        for a, b in zip(*_runs(tree, place)):
            lows, at = np.unique(low[a:b], return_inverse=True)
            counts = np.zeros(len(lows), np.int64)
            np.add.at(counts, at, n[a:b])
            found.append({"tree": int(tree[a]), "container": int(place[a]), **container(lows, counts)})
        if found:
            yield pa.RecordBatch.from_pylist(found, schema=_CONTAINERS)


_CONTAINERS = pa.schema([("tree", pa.int64()), ("container", pa.int64()), ("ids", pa.int32()),
                         ("rows", pa.int64()), ("bits", pa.binary()), ("again", pa.binary()),
                         ("surplus", pa.binary())])
_CONTAINER_SPEC = "tree long, container long, ids int, rows long, bits binary, again binary, surplus binary"


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps sorted by container: one for each, the union of its parts. Holds one container's counts."""
    key, counts, alone, found = None, None, None, []

    def close():
        if alone is not None:
            found.append({"tree": key[0], "container": key[1], **alone})
        elif key is not None:
            lows = np.flatnonzero(counts)
            found.append({"tree": key[0], "container": key[1], **container(lows, counts[lows])})

    def add(row):
        lows = members(row["bits"], row["ids"])
        counts[lows] += 1
        again = np.frombuffer(row["again"], "<u2")
        counts[again] += np.frombuffer(row["surplus"], "<i8")

    for batch in batches:
        for row in batch.to_pylist():
            if key != (row["tree"], row["container"]):
                close()
                key, alone, counts = (row["tree"], row["container"]), row, None
                continue
            if counts is None:
                counts = np.zeros(1 << BITS, np.int64)
                add(alone)
                alone = None
            add(row)
        if len(found) > 256:
            yield pa.RecordBatch.from_pylist(found, schema=_CONTAINERS)
            found = []
    close()
    if found:
        yield pa.RecordBatch.from_pylist(found, schema=_CONTAINERS)


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves with their place; rows sorted so that each container comes before its leaves."""
    key, ranks, base, size = None, None, 0, 0
    for batch in batches:
        is_leaf = np.asarray(batch["is_leaf"].cast(pa.int8()))
        tree, place, low = (np.asarray(batch[c]) for c in ("tree", "container", "low"))
        position, total = np.zeros(len(tree), np.int64), np.zeros(len(tree), np.int64)
        for a, b in zip(*_runs(tree, place, is_leaf)):
            if not is_leaf[a]:
                row = batch.slice(a, 1).to_pylist()[0]
                key = (row["tree"], row["container"])
                ranks = Ranks(row["ids"], row["bits"], row["again"], row["surplus"])
                base, size = row["base"], row["size"]
                continue
            if key != (tree[a], place[a]):
                raise AssertionError("a leaf without the container of its id")
            position[a:b] = base + ranks.of(low[a:b])
            total[a:b] = size
        leaves = pa.array(np.flatnonzero(is_leaf))
        if len(leaves):
            out = [batch[c].take(leaves) for c in ("tree", "doc_id", "leaf", "altered", "n")]
            out += [pa.array(position).take(leaves), pa.array(total).take(leaves)]
            yield pa.RecordBatch.from_arrays(
                out, ["tree", "doc_id", "leaf", "altered", "n", "position", "size"])


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _directory(leaves: DataFrame) -> DataFrame:
    """The container of every tree's ids, with ``base``, its first place, and ``size``, the tree's leaves.

    Sums run over the containers of 2^32 ids, over these of 2^48 and over
    these of a tree: no window has more than 65,537 rows.
    """
    parts = leaves.select("tree", "container", "low", "n").mapInArrow(_part_bitmaps, _CONTAINER_SPEC)
    held = stored(parts.repartition(_partitions(leaves), "tree", "container")
                  .sortWithinPartitions("tree", "container").mapInArrow(_merged, _CONTAINER_SPEC),
                  "containers")

    def before(rows: DataFrame, group: list[str], by: str, name: str) -> DataFrame:
        running = Window.partitionBy(*group).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn(name, F.coalesce(F.sum("rows").over(running), F.lit(0)))

    narrow = held.select("tree", "container", "rows",
                         F.shiftright("container", 16).alias("middle"),
                         F.shiftright("container", 32).alias("top"))
    middles = narrow.groupBy("tree", "top", "middle").agg(F.sum("rows").alias("rows"))
    tops = middles.groupBy("tree", "top").agg(F.sum("rows").alias("rows"))
    sizes = F.sum("rows").over(Window.partitionBy("tree"))
    tops = before(tops.withColumn("size", sizes), ["tree"], "top", "above").drop("rows")
    middles = before(middles, ["tree", "top"], "middle", "beside").drop("rows")
    placed = (before(narrow, ["tree", "middle"], "container", "within")
              .join(middles, ["tree", "top", "middle"]).join(tops, ["tree", "top"])
              .select("tree", "container", F.expr("within + beside + above").alias("base"), "size"))
    return stored(held.join(placed, ["tree", "container"]), "directory")


def positions(leaves: DataFrame, share: int = SHARE) -> DataFrame:
    """``leaves`` with ``position`` in their tree and the tree's ``size``, copies as rows of their own.

    ``leaves`` has tree, doc_id, leaf, altered and ``n``, the number of such
    rows. Leaves rise by id within a tree, null ids first, and by leaf where ids
    are equal. A rank in the id's container is the place of the id's first leaf,
    so leaves are never sorted by id; only different leaves of one id are put in
    order, by the first two bytes of the leaf and then among those that agree.
    """
    container_ = F.coalesce(F.shiftright("doc_id", BITS), F.lit(_NOWHERE))
    low = F.coalesce(F.col("doc_id").bitwiseAND((1 << BITS) - 1), F.lit(0)).cast("int")
    leaves = leaves.withColumns({"container": container_, "low": low})
    directory = _directory(leaves)
    crowded = stored(
        leaves.groupBy("tree", "container").count().where(F.col("count") > share)
        .select("tree", "container", F.ceil(F.col("count") / share).cast("int").alias("shares")), "crowded")
    shares = F.coalesce("shares", F.lit(1))
    rows = (leaves.join(crowded, ["tree", "container"], "left")
            .withColumn("share", F.pmod(F.xxhash64("leaf"), shares).cast("int")))
    books = (directory.join(crowded, ["tree", "container"], "left")
             .withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1))))
    both = rows.select("tree", "container", "share", F.lit(True).alias("is_leaf"), "low", "doc_id", "leaf",
                       "altered", "n").unionByName(
        books.select("tree", "container", "share", F.lit(False).alias("is_leaf"), "ids", "bits", "again",
                     "surplus", "base", "size"), allowMissingColumns=True)
    both = both.withColumns({"low": F.coalesce("low", F.lit(0)), "n": F.coalesce("n", F.lit(0).cast("long"))})
    ranked = stored(
        both.repartition(_partitions(leaves), "tree", "container", "share")
        .sortWithinPartitions("tree", "container", "share", "is_leaf")
        .mapInArrow(_ranked, "tree long, doc_id long, leaf binary, altered binary, n long,"
                             " position long, size long"), "ranked")

    # the position names the id, since each id has its own first place
    several = stored(ranked.groupBy("tree", "position").count().where("count > 1").drop("count"), "several")
    bucket = F.substring(F.hex("leaf"), 1, 4).alias("bucket")
    tied = ranked.join(several, ["tree", "position"], "left_semi").select("*", bucket)
    sums = tied.groupBy("tree", "position", "bucket").agg(F.sum("n").alias("rows"))
    of_id = (Window.partitionBy("tree", "position").orderBy("bucket")
             .rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("tree", "position", "bucket", F.coalesce(F.sum("rows").over(of_id), F.lit(0)).alias("skip"))
    of_bucket = (Window.partitionBy("tree", "position", "bucket").orderBy("leaf")
                 .rowsBetween(Window.unboundedPreceding, -1))
    tied = (tied.withColumn("within", F.coalesce(F.sum("n").over(of_bucket), F.lit(0)))
            .join(sums, ["tree", "position", "bucket"])
            .withColumn("position", F.expr("position + skip + within")).select(ranked.columns))
    once = ranked
    if not several.isEmpty():
        once = ranked.join(several, ["tree", "position"], "left_anti").unionByName(tied)

    def numbered(rows: DataFrame) -> DataFrame:
        return (rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
                .withColumn("position", F.col("position") + F.col("copy")).drop("copy", "n"))

    few, many = numbered(once.where(F.col("n") <= COPIES)), once.where(F.col("n") > COPIES)
    if many.isEmpty():
        return few
    step = F.lit(COPIES).cast("long")
    cut = (many.withColumn("skip", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, step)))
           .withColumns({"position": F.col("position") + F.col("skip"),
                         "n": F.least(step, F.col("n") - F.col("skip"))}).drop("skip")
           .repartition(_partitions(leaves), "tree", "position"))
    return few.unionByName(numbered(cut))


# --- trees ---------------------------------------------------------------------------------------

def levels_of(size: int) -> int:
    """Levels over ``size`` leaves."""
    return (size - 1).bit_length()


def reduced(nodes: list[bytes], levels: int) -> tuple[bytes, list[list[bytes]]]:
    """The node over an array of slots after so many levels, and the nodes of each level below it."""
    below = []
    for _ in range(levels):
        below.append(nodes)
        nodes = [digest(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0], below


def siblings(below: list[list[bytes]], slot: int) -> list[tuple[int, bytes]]:
    """Level by level the sibling of a slot's node: 1 if it stands to the right, -1 to the left, 0 if none."""
    steps = []
    for nodes in below:
        other = slot ^ 1
        steps.append((other - slot, nodes[other]) if other < len(nodes) else (0, b""))
        slot >>= 1
    return steps


def folded(node: bytes, steps: list[tuple[int, bytes]]) -> bytes:
    """What a node leads to with its siblings."""
    for side, other in steps:
        node = digest(node, other) if side > 0 else digest(other, node) if side < 0 else digest(node)
    return node


_STEP = 33


def _path_bytes(steps: list[tuple[int, bytes]]) -> bytes:
    return b"".join(bytes([side + 1]) + other.ljust(32, b"\0") for side, other in steps)


def _path_steps(path: bytes) -> list[tuple[int, bytes]]:
    return [(path[at] - 1, path[at + 1:at + _STEP] if path[at] != 1 else b"")
            for at in range(0, len(path), _STEP)]


def _levels_here(size: int, number: int) -> int:
    """Levels that round ``number`` reduces in a tree of ``size`` leaves."""
    return max(0, min(LEVELS, levels_of(size) - number * LEVELS))


def _arrays(slots: DataFrame, number: int, carried: str = "") -> DataFrame:
    """Slots (tree, size, position, node) as one row per array: its nodes in order, and the node over it.

    ``carried`` are further columns of slots ("name type, ..."), kept as arrays.
    """
    names = [c.split()[0] for c in carried.split(", ")] if carried else []

    def gather(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("position").combine_chunks()
        nodes = [bytes(x) for x in table["node"].to_pylist()]
        size = table["size"][0].as_py()
        node, _ = reduced(nodes, _levels_here(size, number))
        kept = {n: pa.array([table[n].to_pylist()], pa.list_(table[n].type)) for n in names}
        return pa.table({"tree": pa.array([key[0].as_py()], pa.int64()),
                         "part": pa.array([key[1].as_py()], pa.int64()),
                         "size": pa.array([size], pa.int64()),
                         "nodes": pa.array([b"".join(nodes)], pa.binary()),
                         "node": pa.array([node], pa.binary()), **kept})

    spec = "tree long, part long, size long, nodes binary, node binary"
    spec += "".join(f", {c.split()[0]} array<{c.split()[1]}>" for c in (carried.split(", ") if carried else []))
    return stored(slots.withColumn("part", F.shiftright("position", LEVELS)).groupBy("tree", "part")
                  .applyInArrow(gather, spec), "slot-arrays")


def _raised(slots: DataFrame, carried: str = "") -> list[DataFrame]:
    """The arrays of all rounds over slots; the last round has one array a tree."""
    rounds = [_arrays(slots, 0, carried)]
    most = rounds[0].agg(F.max("size")).first()[0] or 1
    for number in range(1, -(-levels_of(most) // LEVELS)):
        above = rounds[-1].select("tree", "size", F.col("part").alias("position"), "node")
        rounds.append(_arrays(above, number))
    return rounds


def _nodes(row: dict) -> list[bytes]:
    data = row["nodes"]
    return [data[at:at + 32] for at in range(0, len(data), 32)]


def _lowered(arrays: DataFrame, paths: DataFrame, number: int, as_trees: bool) -> DataFrame:
    """The path of every slot from its array's path; ``as_trees``, slots are trees and their nodes subroots."""
    def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                nodes = _nodes(row)
                _, below = reduced(nodes, _levels_here(row["size"], number))
                path = [_path_bytes(siblings(below, s)) + row["path"] for s in range(len(nodes))]
                at = [row["part"] * SLOTS + s for s in range(len(nodes))]
                count = len(nodes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at if as_trees else [row["tree"]] * count, pa.int64()),
                     pa.array([0] * count if as_trees else at, pa.int64()),
                     pa.array(path, pa.binary()),
                     pa.array(nodes if as_trees else [row["subroot"]] * count, pa.binary()),
                     pa.array([row["root"]] * count, pa.binary())],
                    ["tree", "part", "path", "subroot", "root"])

    return stored(arrays.join(paths, ["tree", "part"]).mapInArrow(
        lower, "tree long, part long, path binary, subroot binary, root binary"), "paths")


def _proved(arrays: DataFrame, paths: DataFrame) -> DataFrame:
    """Each leaf with its proof, and the root that its altered (or own) leaf leads to."""
    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                nodes = _nodes(row)
                _, below = reduced(nodes, _levels_here(row["size"], 0))
                above = _path_steps(row["path"])
                tail = "".join(other.hex() for _, other in above)
                root, top = row["root"].hex(), {}
                found = {c: [] for c in ("leaf", "proof_sha256", "folded_root", "verified")}
                for slot, (own, altered) in enumerate(zip(nodes, row["altered"])):
                    steps = siblings(below, slot)
                    proof = "".join(other.hex() for _, other in steps) + tail
                    node = folded(own if altered is None else altered, steps)
                    if node not in top:
                        top[node] = folded(node, above).hex()
                    found["leaf"].append(own.hex())
                    found["proof_sha256"].append(hashlib.sha256(proof.encode()).hexdigest())
                    found["folded_root"].append(top[node])
                    found["verified"].append(top[node] == root)
                count = len(nodes)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(row["doc_id"], pa.int64()), "leaf": found["leaf"],
                    "subroot": [row["subroot"].hex()] * count, "root": [root] * count,
                    "proof_sha256": found["proof_sha256"], "folded_root": found["folded_root"],
                    "verified": pa.array(found["verified"], pa.bool_())})

    return arrays.join(paths, ["tree", "part"]).mapInArrow(
        prove, "doc_id long, leaf string, subroot string, root string, proof_sha256 string,"
               " folded_root string, verified boolean")


def _numbered_groups(groups: DataFrame) -> DataFrame:
    """Distinct values of column ``lang`` with ``tree``, their number in order, null first.

    The values are sorted over all tasks; the counts of the parts, as many as
    there are partitions, give each part its first number.
    """
    ordered = stored(groups.orderBy(F.asc_nulls_first("lang"))
                     .withColumn("at", F.monotonically_increasing_id()), "groups")
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    counts = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("count"))
    running = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("part", F.coalesce(F.sum("count").over(running), F.lit(0)).alias("first"))
    return (ordered.withColumns({"part": part, "within": within}).join(firsts, "part")
            .select("lang", (F.col("first") + F.col("within")).alias("tree")))


def verified_manifest(docs: DataFrame, tampered: Callable[[], Column] | None = None,
                      columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
                      ) -> DataFrame:
    """One row per row of ``docs``: its leaf, its proof and whether that still leads to the root.

    ``columns`` name the id (whole number), two texts of which the second is the
    group, a whole number and a text; others are not read. A leaf is the SHA-256
    of the row's framed values. Leaves of a group rise by id; two neighbours each
    become the SHA-256 of their hex digests, also one alone, until one is left,
    the group's subroot. Subroots, by group (null first, then by UTF-8 bytes),
    give the root in the same way. ``tampered`` makes a condition over the
    column ``doc_id``: such rows are folded with their number raised by one.

    Columns: doc_id, leaf, subroot, root, proof_sha256 (of the hex siblings from
    the leaf to the root), folded_root and verified (folded_root is the root).

    Rows with a null id come first in their group and are not tampered with where
    the condition is null. Leaves of one id rise by their digest, so repeated
    rows have places, and proofs, of their own. A null number stays null.
    Any text, id and group may hold any share of the rows; no group, or a group
    for every row, may be null. An empty table gives an empty result.

    Bitmaps of ids per group, merged over all tasks, give the places: the rank of
    an id is looked up, leaves are not sorted. Then places name arrays of 1,024
    slots, each reduced by one task to a node, which is a slot of the next round.
    Proofs are made on the way back: each array hands its slots the way up.
    """
    id_col, source_col, lang_col, number_col, text_col = columns
    named = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"),
        F.col(lang_col).cast("string").alias("lang"),
        F.col(number_col).cast("decimal(20,0)").alias("n_chars"), F.col(text_col).alias("text"))

    def of(number: Column) -> Column:
        return leaf(F.col("doc_id"), F.col("source"), F.col("lang"), number, F.col("text"))

    touched = F.lit(False) if tampered is None else F.coalesce(tampered(), F.lit(False))
    altered = F.when(touched & F.col("n_chars").isNotNull(), of(F.col("n_chars") + 1))
    hashed = named.select("lang", "doc_id", of(F.col("n_chars")).alias("leaf"), altered.alias("altered"))
    distinct = stored(hashed.groupBy("lang", "doc_id", "leaf", "altered").agg(F.count("*").alias("n")),
                      "leaves")
    trees = stored(_numbered_groups(distinct.select("lang").distinct()), "trees")
    leaves = (distinct.join(trees, distinct["lang"].eqNullSafe(trees["lang"]))
              .select("tree", "doc_id", "leaf", "altered", "n"))
    placed = positions(stored(leaves, "named-leaves"))
    slots = placed.select("tree", "size", "position", F.col("leaf").alias("node"), "doc_id", "altered")
    lower = _raised(slots, "doc_id long, altered binary")
    count = trees.count()
    roots = lower[-1].select(F.lit(0).cast("long").alias("tree"), F.lit(count).cast("long").alias("size"),
                             F.col("tree").alias("position"), "node")
    upper = _raised(roots)
    paths = upper[-1].select("tree", "part", F.lit(b"").alias("path"), F.lit(None).cast("binary").alias("subroot"),
                             F.col("node").alias("root"))
    for number in reversed(range(len(upper))):
        paths = _lowered(upper[number], paths, number, as_trees=number == 0)
    for number in reversed(range(1, len(lower))):
        paths = _lowered(lower[number], paths, number, as_trees=False)
    return _proved(lower[0], paths)
