"""Near duplicates by SimHash: fingerprints, anchors of a covering code, linked groups."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components, forest
from .shared import first_rows, per_process, place, plain, stored, text_uid, word_blocks

WIDTH = 4
THRESHOLD = 4
SEED = 42
#: Fingerprints at home at an anchor that one task compares at most, on average.
HOMES = 8192
#: Pairs, and rows of an anchor, that a task has in memory at once.
PAIRS = 1 << 21
ROWS = 1 << 18

#: The three parts of a fingerprint, as first bit and bits above the 15 of the code.
PARTS = ((0, 6), (21, 6), (42, 7))
CODE_BITS = 15


def fingerprint(data: bytes, width: int = WIDTH, seed: int = SEED) -> int:
    """SimHash of the shingles of ``width`` words of a UTF-8 text, A-Z in lower case; 0 without words."""
    from xxhash import xxh64_intdigest

    ones, total, last = np.zeros(64, np.int64), 0, []
    for words in word_blocks(data.lower()):
        words = last + words
        last = words[max(0, len(words) - width + 1):]
        if len(words) < width:
            continue
        text = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashes = np.array([xxh64_intdigest(text[a:b], seed) for a, b in
                           zip(starts[:len(words) - width + 1].tolist(), ends[width - 1:].tolist())],
                          dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    if not total:
        return xxh64_intdigest(b" ".join(last), seed) if last else 0
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(text: Column, width: int = WIDTH, seed: int = SEED) -> Column:
    """The fingerprint of each text as a long (the unsigned number's bits); null counts as empty."""
    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        found = [fingerprint(t.as_py(), width, seed) for t in texts]
        return pa.array(np.array(found, dtype=np.uint64).view(np.int64))

    return of(F.encode(plain(text), "utf-8"))


def code_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each word of 15 bits: the one Hamming codeword within distance 1, and those within 2.

    The code has covering radius 1: flipping the bit whose number is the
    syndrome leads to a codeword, and so does flipping two bits whose numbers
    differ by the syndrome. Words that are codewords have no other within 2;
    their places in the second table repeat the first.
    """
    words = np.arange(1 << CODE_BITS)
    syndrome = np.zeros_like(words)
    for bit in range(CODE_BITS):
        syndrome ^= np.where(words >> bit & 1, bit + 1, 0)
    home = words ^ np.where(syndrome, 1 << np.maximum(syndrome - 1, 0), 0)
    near = np.repeat(home[:, None], 8, axis=1)
    for s in range(1, CODE_BITS + 1):
        pairs = [(i, i ^ s) for i in range(1, CODE_BITS + 1) if i < i ^ s and i != s]
        for place, (i, j) in enumerate(pairs):
            near[syndrome == s, place + 1] = words[syndrome == s] ^ (1 << i - 1) ^ (1 << j - 1)
    return home, near


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of fingerprints: row number of the fingerprint, anchor, whether it is at home there.

    At most four differing bits leave at most one in one of the three parts. In
    that part a fingerprint x has its home at a codeword within distance 1 of 15
    bits with the other bits unchanged. One that differs from x by one bit there
    is within 2 of the codeword, or else differs in the other bits. So each
    fingerprint goes to all anchors within the covering radius plus one, and
    meets at x's home everything that x links to.
    """
    home, near = per_process("covering code", code_tables)
    row = np.arange(len(fps))
    rows, keys, homes = [], [], []

    def put(which, key, at_home):
        rows.append(which)
        keys.append(key)
        homes.append(np.full(len(which), at_home))

    for number, (first, above) in enumerate(PARTS):
        part = (fps >> np.uint64(first)).astype(np.int64) & ((1 << CODE_BITS + above) - 1)
        word, rest = part & ((1 << CODE_BITS) - 1), part >> CODE_BITS
        key = lambda code, bits: (number << 32) | (bits << CODE_BITS) | code  # noqa: B023, E731
        put(row, key(home[word], rest), True)
        put(row, key(home[word], rest), False)
        for place in range(1, near.shape[1]):
            other = near[word, place] != home[word]
            put(row[other], key(near[word, place], rest)[other], False)
        for bit in range(above):
            put(row, key(home[word], rest ^ (1 << bit)), False)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def _meet(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Links among rows sorted by anchor and share, homes first: a forest for each part that is read.

    Holds the homes of one anchor's share and a bounded number of other rows.
    """
    a = b = np.empty(0, np.uint64)

    def compare(key, fp, home):
        """Each home with the visitors of its anchor, a bounded number of pairs at a time."""
        nonlocal a, b
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        count = np.add.reduceat(home.astype(np.int64), start)
        visitors = np.flatnonzero(~home)
        each = count[group[visitors]]
        visitors, each = visitors[each > 0], each[each > 0]
        done = np.concatenate([[0], np.cumsum(each)])
        at = 0
        while at < len(visitors):
            to = max(at + 1, int(np.searchsorted(done, done[at] + PAIRS, "right")) - 1)
            n = each[at:to]
            v = np.repeat(visitors[at:to], n)
            h = start[group[v]] + np.arange(len(v)) - np.repeat(done[at:to] - done[at], n)
            x, y = fp[h], fp[v]
            close = (x < y) & (np.bitwise_count(x ^ y) <= threshold)
            a, b = np.concatenate([a, x[close]]), np.concatenate([b, y[close]])
            if len(a) > PAIRS:
                b, a = forest(a, b)
            at = to

    held = None
    for batch in batches:
        salted = np.stack([np.asarray(batch["anchor"]), np.asarray(batch["share"])], axis=1)
        new = (salted, np.asarray(batch["fp"]).view(np.uint64), ~np.asarray(batch["visits"]))
        if not len(salted):
            continue
        held = new if held is None else tuple(map(np.concatenate, zip(held, new)))
        if len(held[1]) < ROWS:
            continue
        same = (held[0] == held[0][-1]).all(axis=1)
        first = int(np.argmax(same))  # sorted, so the last anchor's rows are at the end
        if first:
            compare(_number(held[0][:first]), held[1][:first], held[2][:first])
            held = tuple(x[first:] for x in held)
        if len(held[1]) >= ROWS:
            compare(_number(held[0]), held[1], held[2])
            held = tuple(x[held[2]] for x in held)
    if held is not None and len(held[1]):
        compare(_number(held[0]), held[1], held[2])
    if len(a):
        b, a = forest(a, b)
        for at in range(0, len(a), 1 << 16):
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[at:at + (1 << 16)].view(np.int64)) for x in (a, b)], ["a", "b"])


def _number(salted: np.ndarray) -> np.ndarray:
    """One number per run of equal rows."""
    return np.cumsum(np.concatenate([[0], (salted[1:] != salted[:-1]).any(axis=1)]))


def fingerprint_links(distinct: DataFrame, threshold: int = THRESHOLD, homes: int = HOMES) -> DataFrame:
    """Links ``a``, ``b`` between the fingerprints of ``distinct`` (column ``fp``).

    They join the same fingerprints as all pairs with at most ``threshold``
    (4 or less) differing bits do. Every pair is compared at the anchors that
    both go to; a task returns a forest of the pairs that it finds. An anchor
    with more than ``homes`` fingerprints at home is cut into shares of about
    that many, each a task's, and its visitors go to every share.
    """
    if threshold > 4:
        raise ValueError("the anchors cover up to 4 differing bits")

    def spread(batches):
        for batch in batches:
            fps = np.asarray(batch["fp"])
            for at in range(0, len(fps), 4096):
                part = fps[at:at + 4096]
                row, key, home = anchors(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[row]), pa.array(key), pa.array(~home)], ["fp", "anchor", "visits"])

    def meet(batches):
        yield from _meet(batches, threshold)

    spec = "fp long, anchor long, visits boolean"
    rows = distinct.select("fp").mapInArrow(spread, spec)
    crowded = stored(
        rows.where("not visits").groupBy("anchor").count().where(F.col("count") > homes)
        .select(F.col("anchor"), F.ceil(F.col("count") / homes).cast("int").alias("shares")),
        "crowded")
    own = F.pmod(F.xxhash64("fp"), F.coalesce("shares", F.lit(1))).cast("int")
    dealt = (rows.join(crowded, "anchor", "left")
             .withColumn("share", F.explode(F.when(
                 F.col("visits"), F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1))
                 .otherwise(F.array(own))))
             .select("fp", "anchor", "visits", "share"))
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (dealt.repartition(parts, "anchor", "share")
            .sortWithinPartitions("anchor", "share", "visits").mapInArrow(meet, "a long, b long"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                threshold: int = THRESHOLD, width: int = WIDTH, seed: int = SEED,
                homes: int = HOMES) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (long) and component_id.

    Fingerprints link at ``threshold`` or fewer differing bits; ``component_id``
    is the smallest doc_id that is reachable over links, the own included.
    Texts without words, also null, have fingerprint 0 and link like others.
    Repeated rows are equal and so in one component. A null doc_id is never the
    smallest unless its component has no other. No document, an empty result.

    Only distinct fingerprints are compared; copies are joined back in the end,
    through a shuffle that Spark can split.
    """
    prints = stored(docs.select(F.col(id_col).alias("doc_id"),
                                fingerprints(F.col(text_col), width, seed).alias("fp")), "prints")
    return (_with_least(prints, F.col("doc_id"), threshold, homes)
            .select("doc_id", "fp", F.col("first").alias("component_id")))


def _with_least(prints: DataFrame, value: Column, threshold: int, homes: int) -> DataFrame:
    """``prints`` with ``first``, the least value in the component of its ``fp``."""
    distinct = stored(prints.groupBy("fp").agg(F.min(value).alias("least")), "distinct-prints")
    linked = components(fingerprint_links(distinct, threshold, homes))
    rooted = stored(
        distinct.join(linked, distinct["fp"] == linked["node"], "left")
        .select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    least = stored(rooted.groupBy("root").agg(F.min("least").alias("first")), "component")
    named = stored(rooted.join(least, "root").select("fp", "first"), "named")
    return prints.join(named, "fp")


def hex_digits(fp: Column) -> Column:
    """A fingerprint as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              null_ids_stay: bool = True) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, one of its smallest id; all columns stay.

    Rows go by id and text: texts of an id that are in other groups stay there.
    Rows with a null id all stay, or with ``null_ids_stay=False`` only one of a
    group without other ids.
    """
    prints = stored(docs.select(F.col(id_col).alias("doc_id"), text_uid(id_col, text_col).alias("uid"),
                                fingerprints(F.col(text_col)).alias("fp")), "prints")
    return first_rows(docs, _with_least(prints, place(), THRESHOLD, HOMES), id_col, text_col, null_ids_stay)
