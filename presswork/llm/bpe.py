"""Byte-level BPE: texts to token ids and back, as a reduction over a tree of text halves.

A text is cut into halves until they are short, the leaves are encoded, and
neighbours are joined on the way up. Tokens near the cut can change when the
other half follows, so a join encodes a window around the cut anew. The window
grows until it starts and ends between a character that is not white space and
one that is. No match of the pattern crosses such a place, whatever surrounds
it, so the tokens outside the window are those of the whole text. The join is
associative: the tokens do not depend on where the text was cut.
"""

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .shared import per_process, plain

LEAF_CHARS = 2048
LEAF_IDS = 4096
WINDOW_CHARS = 32


def encoder(ranks_path: str):
    """The tiktoken encoding of a rank file, loaded once in a process."""
    def load():
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN,
                                 mergeable_ranks=ranks, special_tokens={})
    return per_process(f"bpe {ranks_path}", load)


def _settled(text: str, lo: int, mid: int, hi: int, window: int) -> tuple[int, int]:
    """The nearest places around ``mid`` where the split of ``text[lo:hi]`` cannot change.

    The ends of the text part count as such.
    """
    def place(at: int) -> bool:
        return text[at] in " \n\t\r" and not text[at - 1].isspace()

    begin = end = None
    while begin is None or end is None:
        left, right = max(lo, mid - window), min(hi, mid + window)
        if begin is None:
            begin = next((at for at in range(mid, left, -1) if at < hi and place(at)),
                         lo if left == lo else None)
        if end is None:
            end = next((at for at in range(mid, right) if place(at)), hi if right == hi else None)
        window *= 2
    return begin, end


def encode_tree(text: str, encoding, leaf: int = LEAF_CHARS, window: int = WINDOW_CHARS) -> list[int]:
    """The ids of ``text``, joined up a tree of halves."""
    def joined(lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        begin, end = _settled(text, lo, mid, hi, window)
        drop, count = len(text[begin:mid].encode()), len(left)
        while drop > 0:
            count -= 1
            drop -= len(encoding.decode_single_token_bytes(left[count]))
        skip, first = len(text[mid:end].encode()), 0
        while skip > 0:
            skip -= len(encoding.decode_single_token_bytes(right[first]))
            first += 1
        if drop or skip:
            raise AssertionError("a token crosses a place where no match can")
        del left[count:]
        left += encoding.encode_ordinary(text[begin:end])
        left += right[first:] if first else right
        return left

    def node(lo: int, hi: int) -> list[int]:
        if hi - lo <= leaf:
            return encoding.encode_ordinary(text[lo:hi])
        mid = (lo + hi) // 2
        return joined(lo, mid, hi, node(lo, mid), node(mid, hi))

    return node(0, len(text))


def decode_tree(ids, encoding, leaf: int = LEAF_IDS) -> bytes:
    """The bytes of ``ids``, concatenated up a tree of halves."""
    if len(ids) <= leaf:
        return encoding.decode_bytes(ids)
    mid = len(ids) // 2
    return decode_tree(ids[:mid], encoding, leaf) + decode_tree(ids[mid:], encoding, leaf)


def bpe_encode(text: Column, ranks_path: str, leaf: int = LEAF_CHARS) -> Column:
    """Token ids of each text as bytes, little-endian unsigned 32-bit; null and empty texts have none."""
    @F.arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        import numpy as np

        encoding = encoder(ranks_path)
        return pa.array([np.array(encode_tree(t.as_py(), encoding, leaf), dtype="<u4").tobytes()
                         for t in texts], pa.binary())

    return encode(plain(text))


def bpe_decode(ids: Column, ranks_path: str, leaf: int = LEAF_IDS) -> Column:
    """The bytes that :func:`bpe_encode` had encoded; null has none.

    Bytes, not text: ids that were not made from a text may decode to broken UTF-8.
    """
    @F.arrow_udf("binary")
    def decode(packed: pa.Array) -> pa.Array:
        import numpy as np

        encoding = encoder(ranks_path)
        return pa.array([decode_tree(np.frombuffer(p.as_py(), dtype="<u4").tolist(), encoding, leaf)
                         for p in packed], pa.binary())

    return decode(F.coalesce(ids, F.lit(b"")))


def id_count(ids: Column) -> Column:
    """How many ids the bytes hold."""
    return F.shiftright(F.octet_length(ids), 2).cast("long")
