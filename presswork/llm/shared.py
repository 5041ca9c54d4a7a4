"""What the operators share: the scratch folder, stored steps, words of a text, state of a worker."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

#: The temporary folders of sessions on this machine.
_LOCAL: dict[str, str] = {}

#: What the innermost :func:`lasting` that runs will delete; none outside of one.
_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a session on one machine gets a temporary folder; on a
    cluster that is an error, since executors do not see each other's disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        context = spark.sparkContext
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if context.applicationId not in _LOCAL:
            _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="presswork-")
        folder = _LOCAL[context.applicationId]
    return folder.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{scratch(spark)}/presswork/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors.

    Spark knows the exact size of what is read back, so that it broadcasts it only
    if it is small, and can split skewed partitions of joins with it. The shuffle
    files of the write go when it ends. Whoever owns the folder empties it.
    """
    spark = df.sparkSession
    path = fresh(spark, name)
    if (passing := _PASSING.get()) is not None:
        passing.append(path)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def lasting(name: str, make: Callable[[], DataFrame | None]) -> DataFrame | None:
    """What ``make`` returns, stored; what :func:`stored` wrote inside of it goes then.

    Nothing else may read the steps inside later on. None stays None.
    """
    outer = _PASSING.set(steps := [])
    try:
        made = make()
    finally:
        _PASSING.reset(outer)
    if made is None:
        return None
    kept = stored(made, name)
    _delete(made.sparkSession, steps)
    return kept


def discard(df: DataFrame) -> None:
    """Deletes what :func:`stored` wrote for ``df``, once nothing reads it any more."""
    folders = {file.rpartition("/")[0] for file in df.inputFiles()}
    _delete(df.sparkSession, [path for path in folders if "/presswork/" in path])


def _delete(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def small_batches(spark: SparkSession, megabytes: int = 8) -> None:
    """Bounds the Arrow batches of this session by bytes, not only by rows: texts vary in length."""
    spark.conf.set(_BATCH_BYTES, str(megabytes << 20))


def plain(text: Column) -> Column:
    """The text, empty for null."""
    return F.coalesce(text, F.lit(""))


def text_uid(id_col: str, text_col: str) -> Column:
    """A hash of id and text, which tells rows with one id and different texts apart."""
    return F.xxhash64(F.col(id_col), plain(F.col(text_col)))


def place() -> Column:
    """By which the first row of a group stays: the smallest ``doc_id``, null last, then ``uid``."""
    return F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "uid")


def boxed(rows: DataFrame, **own: Column) -> DataFrame:
    """All columns as one, ``row``, beside ``own`` columns made from them; so no names can clash."""
    return rows.select(F.struct("*").alias("row"), *(c.alias(name) for name, c in own.items()))


def first_rows(docs: DataFrame, grouped: DataFrame, id_col: str, text_col: str,
               null_ids_stay: bool) -> DataFrame:
    """``docs`` with one row of each group of ``grouped``; all columns, rows of no group stay.

    ``grouped`` has the ``doc_id`` and ``uid`` (:func:`text_uid`) of rows, and as
    ``first`` the least :func:`place` of the row's group. Of rows equal in id and
    text the least by a hash of all columns stays. With ``null_ids_stay`` rows
    with a null id stay in any case.

    Rows go by id and text together. Joins are plain shuffles that Spark can
    split, and repeated rows meet in an aggregate, before the shuffle.
    """
    if null_ids_stay:
        grouped = grouped.where("doc_id is not null")
    found = stored(
        grouped.groupBy("doc_id", "uid", place().eqNullSafe(F.col("first")).alias("stays")).count()
        .where("not stays or count > 1")
        .select(F.col("doc_id").alias("copy_id"), F.col("uid").alias("copy_uid"), "stays"), "copies")
    keyed = boxed(docs, id=F.col(id_col), uid=text_uid(id_col, text_col))

    def same(rows: DataFrame) -> Column:
        return keyed["id"].eqNullSafe(rows["copy_id"]) & (keyed["uid"] == rows["copy_uid"])

    left = keyed.join(found, same(found), "left_anti").select("row.*")
    repeated = found.where("stays")
    if repeated.isEmpty():
        return left
    one = (keyed.join(repeated, same(repeated), "left_semi").groupBy("id", "uid")
           .agg(F.min_by("row", F.xxhash64("row")).alias("row")))
    return left.union(one.select("row.*"))


def per_process(name: str, make: Callable, kept: int = 2):
    """``make()``, once in each Python worker; ``name`` tells what is kept apart.

    A worker serves one operator after the other, so only the ``kept`` states
    that were used last stay in its memory.
    """
    import sys
    import types

    held = sys.modules.setdefault("_presswork_held", types.ModuleType("_presswork_held"))
    states = held.__dict__.setdefault("states", {})
    states[name] = states.pop(name) if name in states else make()
    while len(states) > kept:
        del states[next(iter(states))]
    return states[name]


def forget() -> None:
    """Drops what earlier operators keep in this Python worker, for one that keeps nothing."""
    import sys

    held = sys.modules.get("_presswork_held")
    if held is not None:
        held.__dict__.get("states", {}).clear()
    give_back()


def give_back() -> None:
    """Returns what this Python worker has freed to the system: an idle worker is none of the next step's."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


#: The bytes that separate words: [\x20\x09-\x0D], also what ``bytes.split`` takes for white space.
WHITE = b" \t\n\v\f\r"


def word_blocks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text, in lists of about ``size`` bytes, so that a long text is never split whole."""
    at, end = 0, len(data)
    while at < end:
        to = min(end, at + size)
        while to < end and data[to] not in WHITE:
            to += 1
        if words := data[at:to].split():
            yield words
        at = to
