"""Token counts of texts of any length, by overlapping chunks that are spliced where they agree.

The library joins the neighbouring pieces with the best score first. What it makes of a text is the one
sequence of pieces in which every two neighbours, encoded alone, come out as these two pieces: the
first join across a border of the sequence would also happen between its two neighbours alone. So if
two chunks have one piece in common, same place and same number, then the pieces of the first
chunk up to it and those of the second after it are what the library makes of the whole: all
neighbours are neighbours in one of the chunks.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import per_process, plain, stored

LIMIT = 4096
#: Bytes from one chunk to the next, and bytes that two chunks share at first.
STRIDE = 1 << 15
OVERLAP = 1 << 9
#: How much both grow for texts with neighbours that do not agree anywhere.
WIDER = 4


def _library(model_path: str):
    def load():
        from sentencepiece import SentencePieceProcessor

        return SentencePieceProcessor(model_file=model_path)

    return per_process(f"pieces {model_path}", load)


def whole_counts(text: Column, model_path: str) -> Column:
    """The number of pieces of each text (bytes), encoded in one go."""
    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        library = _library(model_path)
        return pa.array([len(library.encode(t.as_py())) for t in texts], pa.int64())

    return count(text)


def on_borders(data: bytes, last: bool) -> tuple[int, bytes]:
    """Bytes cut anywhere, without the parts of characters at their ends, and how many went in front."""
    front = 0
    while front < min(3, len(data)) and data[front] & 0xC0 == 0x80:
        front += 1
    end = len(data)
    if not last:
        back = 1
        while back <= min(4, len(data)) and data[-back] & 0xC0 == 0x80:
            back += 1
        if back <= min(4, len(data)) and data[-back] >= 0xC0:
            size = 2 + (data[-back] >= 0xE0) + (data[-back] >= 0xF0)
            end -= back if size > back else 0
    return front, data[front:end]


def _encoded(batch: pa.RecordBatch, model_path: str, stride: int, overlap: int) -> pa.RecordBatch:
    """Per chunk its number of pieces, and those in the parts shared with the neighbours, with offsets.

    A shared part is an array of (place of the piece in the chunk, first byte in
    the text, last byte, number of the piece).
    """
    library = _library(model_path)
    counts, heads, tails = [], [], []
    for number, chunks, data in zip(*(batch[c].to_pylist() for c in ("chunk", "chunks", "data"))):
        start = number * stride
        front, data = on_borders(data, number == chunks - 1) if chunks > 1 else (0, data)
        pieces = library.encode(data, return_type="proto").pieces
        spans = np.array([(p.begin, p.end, p.id) for p in pieces], np.int64).reshape(-1, 3)
        spans[:, :2] += start + (front if number else 0)
        spans = np.column_stack([np.arange(len(spans)), spans])
        parts = []
        for begin, wanted in ((start, number > 0), (start + stride, number < chunks - 1)):
            # the first bytes of an unknown character have no span of their own
            inside = (spans[:, 1] >= begin) & (spans[:, 2] <= begin + overlap) & wanted
            inside &= spans[:, 1] < spans[:, 2]
            parts.append(spans[inside].astype("<i8").tobytes())
        counts.append(len(spans))
        heads.append(parts[0])
        tails.append(parts[1])
    return pa.RecordBatch.from_arrays(
        [batch["digest"], batch["chunk"], pa.array(counts, pa.int64()),
         pa.array(heads, pa.binary()), pa.array(tails, pa.binary())],
        ["digest", "chunk", "pieces", "head", "tail"])


def spliced(counts: list[int], heads: list[bytes], tails: list[bytes]) -> int | None:
    """Pieces of a text from those of its chunks in order; None if two neighbours share no piece."""
    total = 0
    for left, right in zip(tails, heads[1:]):
        a, b = (np.frombuffer(x, "<i8").reshape(-1, 4) for x in (left, right))
        places = {tuple(row[1:]): row[0] for row in b.tolist()}
        same = next(((row[0], places[tuple(row[1:])]) for row in a.tolist()
                     if tuple(row[1:]) in places), None)
        if same is None:
            return None
        total += same[0] - same[1]
    return total + counts[-1]


def _long_counts(texts: DataFrame, model_path: str, stride: int, overlap: int) -> DataFrame:
    """``n_tokens`` per ``digest`` of long texts (columns digest and data): rounds with wider overlaps.

    Equal chunks of equal texts meet in an aggregate before they are encoded, so
    copies are encoded once and chunks are dealt over all tasks.
    """
    found, pending = None, texts
    while True:
        size = F.length("data")
        chunks = F.greatest(F.lit(1), F.ceil((size - overlap) / F.lit(stride))).cast("int")
        cut = (pending.withColumn("chunks", chunks)
               .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
               .select("digest", "chunk", "chunks", F.expr(
                   f"substring(data, chunk * {stride} + 1, {stride + overlap})").alias("data")))
        one = cut.groupBy("digest", "chunk").agg(F.first("chunks").alias("chunks"),
                                                 F.first("data").alias("data"))

        def encode(batches: Iterator[pa.RecordBatch], stride=stride, overlap=overlap):
            for batch in batches:
                yield _encoded(batch, model_path, stride, overlap)

        encoded = stored(one.mapInArrow(
            encode, "digest string, chunk int, pieces long, head binary, tail binary"), "chunks")

        def splice(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            table = table.sort_by("chunk")
            total = spliced(*(table[c].to_pylist() for c in ("pieces", "head", "tail")))
            return pa.table({"digest": pa.array([key[0].as_py()], pa.string()),
                             "n_tokens": pa.array([total], pa.int64())})

        counted = stored(encoded.groupBy("digest").applyInArrow(splice, "digest string, n_tokens long"),
                         "spliced")
        good = counted.where("n_tokens is not null")
        found = good if found is None else found.unionByName(good)
        failed = counted.where("n_tokens is null").select("digest")
        if failed.isEmpty():
            return found
        pending = texts.join(failed, "digest", "left_semi")
        stride, overlap = stride * WIDER, overlap * WIDER


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = LIMIT, stride: int = STRIDE, overlap: int = OVERLAP) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (more tokens than ``limit``).

    Tokens are the pieces that the sentencepiece model makes of a whole text,
    without begin and end; strings of special tokens are ordinary text. Null
    texts count as empty: 0 bytes, 0 tokens. Null ids and repeated rows stay as
    they are. An empty table gives an empty result. Other columns are not read.

    Texts of more than ``stride`` bytes are cut into chunks of ``stride`` +
    ``overlap`` bytes that overlap; chunks are rows of their own, encoded by any
    task. Neighbours are spliced at the first piece that both have at the same
    place, which proves the result (see the module). Texts in which some
    neighbours agree on no piece are cut anew with both lengths four times as
    large, at last into one chunk. Only a text that stays periodic over such a
    stretch, with pieces that fit it in several ways, is ever encoded in one go
    (a run of one letter takes the library some 140 bytes a letter).

    A task holds one chunk and a batch of short texts; what chunks share is
    gathered per text, some hundredths of its size.
    """
    if not 0 < overlap <= stride:
        raise ValueError("chunks must overlap, and only with the next one")
    data = F.encode(plain(F.col(text_col)), "utf-8")
    named = docs.select(F.col(id_col).alias("doc_id"), data.alias("data"))
    size = F.length("data").cast("long")
    short = named.where(size <= stride).select(
        "doc_id", size.alias("n_bytes"), whole_counts(F.col("data"), model_path).alias("n_tokens"))
    long_ = named.where(size > stride).select(
        "doc_id", size.alias("n_bytes"), F.sha2("data", 256).alias("digest"), "data")
    counts = _long_counts(long_.select("digest", "data"), model_path, stride, overlap)
    named_long = long_.select("doc_id", "n_bytes", "digest").join(counts, "digest").select(
        "doc_id", "n_bytes", "n_tokens")
    return short.unionByName(named_long).withColumn("over_limit", F.col("n_tokens") > limit)
