import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from presswork.llm import manifest

SPEC = ("doc_id long, source string, lang string, n_chars long, text string, tree int, leaf string,"
        " position string, n int")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, more=0):
    i, source, lang, n, text = row
    return sha(*map(framed, (i, source, lang, n if n is None else n + more, text)))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def way(levels, at):
    for nodes in levels[:-1]:
        yield at ^ 1, nodes[at ^ 1] if at ^ 1 < len(nodes) else ""
        at >>= 1


def plain(rows, tampers=lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 0):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    grouped = [sorted((r for r in rows if r[2] == lang),
                      key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for lang in langs]
    trees = [tree([leaf(r) for r in group]) for group in grouped]
    top = tree([t[-1][0] for t in trees])
    result = []
    for g, (group, levels) in enumerate(zip(grouped, trees)):
        for at, row in enumerate(group):
            steps = [*way(levels, at), *way(top, g)]
            node, place = leaf(row, tampers(row[0])), [at]
            for k, (other, digest) in enumerate(steps):
                node = sha(digest, node) if digest and other % 2 == 0 else sha(node, digest)
            result.append((row[0], leaf(row), levels[-1][0], top[-1][0], sha(*(d for _, d in steps)),
                           node, node == top[-1][0]))
    return sorted(result, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], SPEC)
    got = manifest.verified_manifest(
        df, tampered=lambda: F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)
    return sorted((tuple(r) for r in got.collect()), key=str)


def made(count, langs=("de", "en"), step=1, first=0):
    rng = random.Random(count)
    return [(first + i * step, rng.choice(["s", None]), rng.choice(langs), rng.choice([None, 5, i]),
             rng.choice([None, "", "é text", str(i)])) for i in range(count)]


def test_table(spark, documents):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in documents.collect()]
    assert run(spark, rows) == plain(rows)


@pytest.mark.parametrize("count, langs, step, first", [
    (1, ("de",), 1, 0), (2, (None,), 1, -1), (5, ("de", None, "", "é", "z"), 1, 0),
    (1025, ("de",), 1, 65_000), (2500, ("de", "en"), 977, -1_000_000), (40, ("de",), 1 << 57, -(1 << 62))])
def test_shapes(spark, count, langs, step, first):
    rows = made(count, langs, step, first)
    random.Random(1).shuffle(rows)
    assert run(spark, rows) == plain(rows)


def test_more_groups_than_slots(spark):
    rows = [(i, "s", f"l{i % 1100}", 3, "t") for i in range(1300)]
    assert run(spark, rows) == plain(rows)


def test_hard_rows(spark):
    big = (1 << 63) - 1
    rows = [(None, None, None, None, None)] * 3 + [(None, "s", "de", 1, "a"), (None, "s", "de", 1, "b"),
            (5, "s", "de", 1, "a"), (5, "s", "de", 1, "a"), (5, "s", "de", 1, "b"), (5, "s", None, 1, "b"),
            (big, "s", "de", big, "x" * 100_000), (-big - 1, "s", "de", -1, ""), (-1, "", "", 0, " "),
            (14, "s", "de", None, "a"), (14, "s", "de", 1, "a")]
    rows += [(i, "s", "de", big, "t") for i in range(20, 60)]
    got = run(spark, rows)
    assert got == plain(rows) and {r[-1] for r in got} == {True, False}
    assert run(spark, []) == []


@pytest.mark.parametrize("copies", [10, manifest.COPIES])
def test_a_hot_id_a_hot_row_and_rows_without_id(spark, monkeypatch, copies):
    monkeypatch.setattr(manifest, "COPIES", 10 if copies == 10 else copies)
    share = manifest.positions.__defaults__
    monkeypatch.setattr(manifest.positions, "__defaults__", (50,))
    rows = made(200, ("de",)) + [(77, "s", "de", 1, str(i)) for i in range(300)]
    rows += [(78, "s", "de", 1, "same")] * 250 + [(None, "s", "de", 1, str(i % 150)) for i in range(200)]
    assert run(spark, rows) == plain(rows)
    assert share == (manifest.SHARE,)


def test_nothing_tampered_is_all_verified(spark):
    rows = made(30)
    df = spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], SPEC)
    assert all(r.verified for r in manifest.verified_manifest(df).collect())


@pytest.mark.parametrize("share", [0.001, 0.05, 0.2, 1.0])
def test_ranks_against_a_plain_count(share):
    rng = np.random.default_rng(3)
    lows = np.flatnonzero(rng.random(1 << 16) < share)
    counts = rng.integers(1, 4, len(lows)) * (rng.random(len(lows)) < 0.1) + 1
    kept = manifest.container(lows, counts)
    assert kept["ids"] == len(lows) and kept["rows"] == counts.sum()
    assert (manifest.members(kept["bits"], kept["ids"]) == lows).all()
    asked = rng.integers(0, 1 << 16, 500)
    got = manifest.Ranks(kept["ids"], kept["bits"], kept["again"], kept["surplus"]).of(asked)
    assert got.tolist() == [int(counts[lows < a].sum()) for a in asked]
