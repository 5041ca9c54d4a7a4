"""Token ids of documents, and their packing into sequences by first-fit decreasing."""

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import forget, give_back, per_process, plain, stored

CAPACITY = 2048
GROUP_ROWS = 4096
SEED = 17
#: Words after which a worker begins to forget those that it has not met since.
REMEMBERED = 200_000
#: Longer words, in characters, are not remembered: in scripts without spaces a word is a whole text.
LONGEST = 48


#: A full stop or comma after something else than a letter or digit of Latin-1 in lower case.
_MIXED_SIGNS = re.compile(r"[.,](?<![0-9a-zß-öø-ÿ][.,])")


class WordIds(dict):
    """Ids, as bytes, of words between ASCII white space, by a tokenizer that never joins such words.

    The tokenizer lower-cases, drops white space and splits letters, digits and
    signs from each other, so a text's ids are those of its words in order, and
    full stops and commas after a letter or digit are words of their own. Lower
    case and the class of a sign are only taken over from Python for characters
    of Latin-1, where both agree; other texts, and those that may hold special
    tokens, keep their words as they are. A worker remembers some words of a
    bounded length, so what it holds does not grow with the texts.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.older = tokenizer, {}
        ends = {i for token, i in tokenizer.get_vocab().items() if token.endswith("</w>")}
        self.ends = np.zeros(tokenizer.get_vocab_size(), dtype=bool)
        self.ends[sorted(ends)] = True

    @staticmethod
    def spaced(text: str) -> str:
        """The text with one space between any two words."""
        for white in "\n\t\r":
            text = text.replace(white, " ")
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        if "<|" in text:
            return text
        text = text.lower()
        if not _MIXED_SIGNS.search(text):
            text = text.replace(".", " .").replace(",", " ,")
        return text

    def learn(self, words: list[str]) -> None:
        """Encodes words that are new; those of letters only, many at a time."""
        letters, others = [], []
        for word in words:
            (letters if word.isalpha() and max(word) < "Ā" else others).append(word)
        for got, word in zip(self.tokenizer.encode_batch_fast(others, add_special_tokens=False), others):
            self[word] = np.array(got.ids, dtype="<u4").tobytes()
        parts = [letters[i:i + 256] for i in range(0, len(letters), 256)]
        encoded = self.tokenizer.encode_batch_fast([" ".join(p) for p in parts],
                                                   add_special_tokens=False)
        for part, got in zip(parts, encoded):
            ids = np.array(got.ids, dtype="<u4")
            data, at = ids.tobytes(), 0
            stops = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(stops) != len(part):
                raise AssertionError("a word of letters is not one word to the tokenizer")
            for word, to in zip(part, stops):
                self[word] = data[at:to]
                at = to

    def of_different(self, words: list[str]) -> list[bytes]:
        """The ids of each word; no word comes twice."""
        long_ = [w for w in words if len(w) > LONGEST]
        short = [w for w in words if len(w) <= LONGEST] if long_ else words
        unseen = [w for w in short if w not in self]
        if len(self) + len(unseen) > REMEMBERED:
            self.older = dict(self)
            self.clear()
            unseen = short
        again = {w: self.older[w] for w in unseen if w in self.older}
        self.update(again)
        self.learn([w for w in unseen if w not in again])
        if not long_:
            return [*map(self.__getitem__, words)]
        got = self.tokenizer.encode_batch_fast(long_, add_special_tokens=False)
        once = {w: np.array(g.ids, dtype="<u4").tobytes() for w, g in zip(long_, got)}
        return [once[w] if w in once else self[w] for w in words]

    def of_spaced(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text; its words are split, looked up once and put together by Arrow."""
        words = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        different = words.flatten().dictionary_encode()
        ids = pa.array(self.of_different(different.dictionary.to_numpy(zero_copy_only=False).tolist()),
                       pa.large_binary())
        joined = ids.take(different.indices)
        _, ends, data = joined.buffers()
        at = np.frombuffer(ends, np.int64)[np.asarray(words.offsets)].tolist()
        data = memoryview(data or b"")
        for begin, end in zip(at, at[1:]):
            yield bytes(data[begin:end])

    def of(self, texts: Iterable[str], block: int = 1 << 21) -> Iterator[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers.

        Short texts are looked up together, long ones in blocks of words.
        """
        held, size = [], 0
        for text in texts:
            if size + len(text) > block:
                yield from self.of_spaced(held)
                held, size = [], 0
            if len(text) > block:
                parts, at = [], 0
                while at < len(text):
                    to = at + block
                    while to < len(text) and text[to] != " ":
                        to += 1
                    parts += self.of_spaced([self.spaced(text[at:to])])
                    at = to
                yield b"".join(parts)
                continue
            held.append(self.spaced(text))
            size += len(text)
        yield from self.of_spaced(held)


def token_ids(text: Column, tokenizer_path: str, end_id: int = 1) -> Column:
    """The library's ids of each text, none added, then ``end_id``: little-endian unsigned 32-bit.

    Strings of special tokens in a text become these, as the library does by
    default. Null texts count as empty, so every row has at least the end id.
    """
    @F.arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        def load():
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            return WordIds(Tokenizer.from_file(tokenizer_path))

        words = per_process(f"words {tokenizer_path}", load)
        last = end_id.to_bytes(4, "little")
        found = pa.array([ids + last for ids in words.of(texts.to_pylist())], pa.binary())
        give_back()
        return found

    return encode(plain(text))


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id",
                 text_col: str = "text", capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """The ids of each document, cut after every ``capacity`` ids.

    Columns: doc_id, start (ids of the document before the piece), length,
    doc_tokens, ids (bytes). Each row of ``docs``, also one with a null id or a
    null text, has at least one piece, since every document ends with ``end_id``.
    """
    n = F.shiftright(F.octet_length("all_ids"), 2).cast("long")
    cut = (docs.select(F.col(id_col).alias("doc_id"),
                       token_ids(F.col(text_col), tokenizer_path, end_id).alias("all_ids"))
           .withColumn("doc_tokens", n)
           .withColumn("start", F.explode(F.sequence(
               F.lit(0).cast("long"), F.col("doc_tokens") - 1, F.lit(capacity).cast("long")))))
    return cut.select(
        "doc_id", "start", F.least(F.lit(capacity), F.col("doc_tokens") - F.col("start")).alias("length"),
        "doc_tokens", F.expr(f"substring(all_ids, int(4 * start + 1), {4 * capacity})").alias("ids"))


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item: by falling length, into the first bin with enough room.

    A tournament tree over the rooms of all bins, each parent the larger of its
    children, finds that bin in a walk from the root.
    """
    count = 1
    while count < len(lengths):
        count *= 2
    room = [capacity] * (2 * count)
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        size, at = lengths[item], 1
        while at < count:
            at *= 2
            if room[at] < size:
                at += 1
        bins[item], offsets[item] = at - count, capacity - room[at]
        room[at] -= size
        while at > 1:
            at //= 2
            most = max(room[2 * at], room[2 * at + 1])
            if room[at] == most:
                break
            room[at] = most
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS,
         seed: int = SEED) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` (both long): each piece lies in one sequence.

    ``pieces`` has a column ``length`` from 0 to ``capacity``; null or other
    lengths are an error. All other columns are carried along, also repeated rows;
    columns that are already called sequence_id or offset are replaced.
    Pieces are dealt at random into groups of about ``group_rows``, each packed
    by first-fit decreasing in one task; equal lengths keep their order. A
    sequence leaves room at its end only: at most one sequence of a group is
    half empty or less. An empty table gives an empty result.

    The pieces are written first, so that the dealing is the same when a lost
    task runs again, and are counted there for the number of groups.
    """
    bad = F.col("length").isNull() | (F.col("length") < 0) | (F.col("length") > capacity)
    pieces = pieces.drop("sequence_id", "offset")
    held = stored(pieces.withColumn("length", F.when(bad, F.raise_error(F.lit(
        f"a piece needs a length from 0 to {capacity}"))).otherwise(F.col("length"))), "pieces")
    groups = max(1, -(-held.count() // group_rows))
    schema = T.StructType([*held.schema.fields, T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])

    def fit(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        forget()
        table = table.select(range(1, table.num_columns))  # without the group, the first column
        bins, offsets = first_fit_decreasing(table["length"].to_pylist(), capacity)
        first = key[0].as_py() << 32
        return (table.append_column("sequence_id", pa.array([first + b for b in bins], pa.int64()))
                .append_column("offset", pa.array(offsets, pa.int64())))

    group = "group of " + " ".join(held.columns)  # a name that no column has
    dealt = held.select(F.floor(F.rand(seed) * groups).alias(group), "*")
    return dealt.groupBy(f"`{group.replace('`', '``')}`").applyInArrow(fit, schema)
