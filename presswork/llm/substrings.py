"""Removal of passages that a document with a smaller id has too, found by recompression."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import recompression
from .shared import WHITE, boxed, discard, forget, lasting, plain, stored, text_uid, word_blocks

WINDOW = 13
#: Bytes of text that are parsed at once.
SLICE = 1 << 19


def _slices(texts: list[bytes], window: int, with_text: bool = True) -> Iterator[tuple]:
    """Words of all texts, slice by slice: names, lengths, number of the text, number of the word in it.

    And, ``with_text``, the words themselves, joined by one space. Each slice begins with the last
    ``window`` - 1 words of the one before, so that every window lies whole in
    just one slice that it is new to.
    """
    data = b" ".join(texts)
    first_byte = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
    seen = np.zeros(len(texts), np.int64)
    kept, tail, at = None, b"", 0
    while at < len(data):
        to = min(len(data), at + SLICE)
        while to < len(data) and data[to] not in WHITE:
            to += 1
        names, sizes, begin = recompression.words(data[at:to])
        text = b" ".join(data[at:to].split()) if with_text else b""
        owner = np.searchsorted(first_byte, begin + at, "right") - 1
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else owner
        counts = np.diff(np.append(starts, len(owner)))
        number = np.arange(len(owner)) - np.repeat(starts, counts) + seen[owner]
        seen[owner[starts]] += counts
        new = (names, sizes, owner, number)
        if kept is not None:
            new = tuple(map(np.concatenate, zip(kept, new)))
            text = b" ".join(part for part in (tail, text) if part)
        if window > 1 and len(new[0]):
            kept = tuple(x[-(window - 1):] for x in new)
            length = int(kept[1].sum()) + max(0, len(kept[1]) - 1)
            tail = text[len(text) - length:]
        if len(new[0]) >= window:
            yield *new, text
        at = to


def _places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte (exclusive) of words that are joined by one space."""
    ends = np.cumsum(sizes + 1) - 1
    return ends - sizes, ends


def _spans(batch: pa.RecordBatch, window: int) -> Iterator[pa.RecordBatch]:
    """Runs of consecutive windows with one anchor: doc_id, uid, anchor, alike, alike2, span."""
    ids, uids = batch["doc_id"], batch["uid"]
    for names, sizes, owner, number, text in _slices(batch["text"].to_pylist(), window):
        anchor, place = recompression.parse(names, sizes, owner, window)
        count = len(anchor)
        inside = owner[:count] == owner[window - 1:]
        new = np.concatenate([[True], (place[1:] != place[:-1]) | (anchor[1:] != anchor[:-1])
                              | (owner[1:count] != owner[:count - 1]) | (inside[1:] != inside[:-1])])
        start = np.flatnonzero(new)
        length = np.diff(np.append(start, count))
        start, length = start[inside[start]], length[inside[start]]
        first, end = _places(sizes)
        # all words that the run covers
        alike = recompression.digests(text, first[start], end[start + length + window - 2])
        which = pa.array(owner[start])
        yield pa.RecordBatch.from_arrays(
            [ids.take(which), uids.take(which), pa.array(anchor[start].view(np.int64)),
             pa.array(alike[:, 0]), pa.array(alike[:, 1]), pa.array(number[start] << 8 | length)],
            ["doc_id", "uid", "anchor", "alike", "alike2", "span"])


def _anchors(batch: pa.RecordBatch, window: int) -> Iterator[pa.RecordBatch]:
    """Each anchor of each text, once per run of its windows: anchor, doc_id."""
    for names, sizes, owner, _, _ in _slices(batch["text"].to_pylist(), window, with_text=False):
        anchor, place = recompression.parse(names, sizes, owner, window)
        count = len(anchor)
        inside = owner[:count] == owner[window - 1:]
        new = np.concatenate([[True], (place[1:] != place[:-1]) | (anchor[1:] != anchor[:-1])
                              | (owner[1:count] != owner[:count - 1])])
        start = np.flatnonzero(new & inside)
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchor[start].view(np.int64)), batch["doc_id"].take(pa.array(owner[start]))],
            ["anchor", "doc_id"])


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     window: int = WINDOW) -> DataFrame:
    """Windows whose words also start in a document with a smaller id: doc_id, uid, windows.

    ``windows`` is an array of numbers, each 256 times the first word of a run
    of such windows plus their number; ``uid`` tells rows with one id and
    different texts apart. Documents without such windows have no row.

    1. Each window gets an anchor, a symbol of the recompressed text that its
       own words determine. Anchors of one document only are left out; so are,
       mostly, all passages that no other document has.
    2. Runs of windows around a shared anchor that are equal as a whole to a run
       in a smaller document are settled with it.
    3. What remains, runs cut off by an edge of a passage, is settled window by
       window against one document for each different run with the anchor.

    Runs and windows are compared by a digest of the words that they cover.

    Every least document is found by an aggregate before the shuffle; joins back
    have plain shuffles on both sides that Spark can split. So an anchor may be
    in any share of the documents.
    """
    def spans(batches):
        forget()
        for batch in batches:
            yield from _spans(batch, window)

    def anchors(batches):
        forget()
        for batch in batches:
            yield from _anchors(batch, window)

    def hashed(batches):
        forget()
        for batch in batches:
            columns = {name: [] for name in ("doc_id", "uid", "pending", "word", "alike", "alike2")}
            for row in batch.to_pylist():
                parts = list(word_blocks(row["text"], SLICE))
                first_byte, end = _places(np.concatenate(
                    [np.fromiter(map(len, words), np.int64, len(words)) for words in parts]))
                words = b" ".join(map(b" ".join, parts))
                found = row["spans"]
                first = np.array([f["span"] for f in found]) >> 8
                count = np.array([f["span"] for f in found]) & 255
                at = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(
                    np.cumsum(count) - count, count)
                pending = np.repeat([f["pending"] for f in found], count)
                for a in range(0, len(at), 1 << 16):
                    part = at[a:a + (1 << 16)]
                    alike = recompression.digests(words, first_byte[part], end[part + window - 1])
                    columns["doc_id"].append(np.full(len(part), row["doc_id"]))
                    columns["uid"].append(np.full(len(part), row["uid"]))
                    columns["pending"].append(pending[a:a + (1 << 16)])
                    columns["word"].append(part)
                    columns["alike"].append(alike[:, 0])
                    columns["alike2"].append(alike[:, 1])
                    if sum(map(len, columns["word"])) > 1 << 18:
                        yield _batch(columns)
                        columns = {name: [] for name in columns}
            if columns["word"]:
                yield _batch(columns)

    text = plain(F.col(text_col))
    named = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), text_uid(id_col, text_col).alias("uid"),
        F.encode(text, "utf-8").alias("text"))

    shared = stored(
        named.mapInArrow(anchors, "anchor long, doc_id long").groupBy("anchor")
        .agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
        .where("least < most").select("anchor", "least"), "shared-anchors")
    runs = stored(
        named.mapInArrow(
            spans, "doc_id long, uid long, anchor long, alike long, alike2 long, span long")
        .join(shared, "anchor"), "shared-runs")
    discard(shared)
    again = stored(runs.groupBy("alike", "alike2")
                   .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("most"))
                   .where("first < most").drop("most"), "equal-runs")
    settled = stored(runs.join(again, ["alike", "alike2"], "left").drop("alike", "alike2"),
                     "settled-runs")
    discard(runs)
    whole = settled.where("doc_id > first").select("doc_id", "uid", "span")

    sources = (settled.where("first is null or doc_id = first")
               .withColumn("pending", F.expr("doc_id > least")))
    open_anchors = stored(sources.where("pending").select("anchor").distinct(), "open-anchors")
    wanted = (sources.join(open_anchors, "anchor", "left_semi").groupBy("doc_id", "uid")
              .agg(F.collect_set(F.struct("span", "pending")).alias("spans")))
    windows = stored(
        named.join(wanted, ["doc_id", "uid"]).mapInArrow(
            hashed,
            "doc_id long, uid long, pending boolean, word long, alike long, alike2 long"),
        "open-windows")
    met = stored(windows.groupBy("alike", "alike2")
                 .agg(F.min("doc_id").alias("first"),
                      F.max(F.when(F.col("pending"), F.col("doc_id"))).alias("last"))
                 .where("first < last").drop("last"), "equal-windows")
    single = (windows.where("pending").join(met, ["alike", "alike2"]).where("doc_id > first")
              .select("doc_id", "uid", F.expr("word << 8 | 1").alias("span")))
    return (whole.unionByName(single).groupBy("doc_id", "uid")
            .agg(F.collect_set("span").alias("windows")))


def _batch(columns: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(x)) for x in columns.values()], list(columns))


def kept_words(data: bytes, windows: list[int] | None, window: int = WINDOW) -> tuple[int, int, bytes]:
    """Words of a text, words covered by the windows, and the others joined by one space."""
    if not windows:
        parts = [(len(words), b" ".join(words)) for words in word_blocks(data)]
        return sum(n for n, _ in parts), 0, b" ".join(text for _, text in parts)
    spans = np.array(windows)
    first, count = spans >> 8, spans & 255
    end = first + count + window - 1
    step = np.zeros(int(end.max()) + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, end, -1)
    covered = np.cumsum(step) > 0
    parts, at = [], 0
    for words in word_blocks(data):
        gone = covered[at:at + len(words)].tolist()
        gone += [False] * (len(words) - len(gone))
        parts += [word for word, g in zip(words, gone) if not g]
        at += len(words)
    return at, at - len(parts), b" ".join(parts)


def _split(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """``row`` (all columns of a document) and ``split``: n_words, n_removed, kept."""
    found = lasting("repeats", lambda: repeated_windows(docs, id_col, text_col, window))

    @F.arrow_udf("n_words long, n_removed long, kept binary")
    def split(texts: pa.Array, windows: pa.Array) -> pa.Array:
        rows = [kept_words(t.as_py(), w.as_py(), window) for t, w in zip(texts, windows)]
        return pa.array([dict(zip(("n_words", "n_removed", "kept"), r)) for r in rows],
                        pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()),
                                   ("kept", pa.binary())]))

    rows = boxed(docs, id=F.col(id_col), key=text_uid(id_col, text_col))
    joined = rows.join(found, (rows["id"] == found["doc_id"]) & (rows["key"] == found["uid"]), "left")
    text = F.encode(plain(F.col("row").getField(text_col)), "utf-8")
    return joined.select("row", split(text, F.col("windows")).alias("split"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   window: int = WINDOW) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept`` (bytes), in place of columns of these names.

    Words are runs of other bytes than [\\x20\\x09-\\x0D]. A word is removed if a
    window of ``window`` words that covers it also starts in a document with a
    smaller id; windows are judged on the texts as they came. Within one
    document, and among rows with one id, nothing is a repeat. Rows with a null
    id keep all words and are no source. Null and empty texts have no words;
    shorter texts than a window have none removed. Names of symbols only tell
    where to look; passages are equal if 128 bits of BLAKE2b of their words are.
    """
    ours = ("n_words", "n_removed", "kept")
    return _split(docs, id_col, text_col, window).select(
        *(F.col("row").getField(c).alias(c) for c in docs.columns if c not in ours), "split.*")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the texts that are left; a text that repeats nothing stays as it is.

    Of other texts the kept words are joined by one space. ``n_chars``, if there
    is one, is that of the new text. Rows with a null id stay as they are.
    """
    changed = F.col("split.n_removed") > 0
    new = {text_col: F.decode("split.kept", "utf-8")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(new[text_col]).cast(docs.schema["n_chars"].dataType)
    old = {c: F.col("row").getField(c) for c in docs.columns}
    return _split(docs, id_col, text_col, WINDOW).select(
        *(F.when(changed, new[c]).otherwise(v).alias(c) if c in new else v.alias(c)
          for c, v in old.items()))
