"""Canonical tables on disk: facts by day and machine, so that reports skip and need not shuffle."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from presswork.schemas import DAY, SCHEMAS
from presswork.sources.tables import Tables, canonical

#: The time that gives a fact its day, which the reports filter by.
FACTS = {
    "production_results": "shift_start",
    "downtimes": "start_ts",
    "scraps": "shift_start",
    "energy_alerts": "shift_start",
    "energy_readings": "reading_ts",
    "energy_stops": "shift_start",
    "operator_log": "shift_start",
}
MACHINE = "machine_code"


def workspace(spark: SparkSession) -> str:
    """A new folder that all executors share, under ``spark.checkpoint.dir``.

    Where that is unset, a session on one machine gets a temporary folder; on a
    cluster it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="presswork-")
    return f"{folder.rstrip('/')}/presswork/store-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class Store:
    """Tables under ``root``, known to the session's catalog as ``{prefix}_{name}``.

    Facts are partitioned by the day of their time and, if ``buckets`` is not 0,
    bucketed and sorted by machine. A day filter then reads its days only, a
    machine filter its buckets, and sums and windows per machine start without a
    shuffle. All rows of a machine then meet in one task, though: for a machine
    that holds a large share of all rows write the store with ``buckets=0``.
    Other tables are plain files. Facts read back have a column ``day`` more.

    Executors and the driver must all see ``root``.
    """

    spark: SparkSession
    root: str
    prefix: str = "presswork"
    buckets: int = 64

    def _table(self, name: str) -> str:
        return f"{self.prefix}_{name}"

    def _path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def write(self, name: str, df: DataFrame) -> None:
        """``df``, which has the columns of canonical table ``name``, as that table; replaces it.

        Rows are cleaned on the way, as by :func:`presswork.sources.tables.canonical`.
        Rows without a time or a machine are kept. Each day and bucket is dealt to
        a task of its own; Spark splits those that are too large for one and
        puts small ones together.
        """
        df = canonical(df, name)
        if name in FACTS:
            df = df.withColumn(DAY, F.to_date(FACTS[name]))
            if self.buckets:
                bucket = F.pmod(F.hash(MACHINE), F.lit(self.buckets))
                df = df.withColumn("_bucket", bucket).hint("rebalance", DAY, "_bucket").drop("_bucket")
            else:
                df = df.hint("rebalance", DAY)
        writer = df.write.format("parquet").mode("overwrite").option("path", self._path(name))
        if name in FACTS:
            writer = writer.partitionBy(DAY)
            if self.buckets:
                writer = writer.bucketBy(self.buckets, MACHINE).sortBy(MACHINE, FACTS[name])
        writer.saveAsTable(self._table(name))

    def open(self, name: str) -> None:
        """Makes a table that an earlier session has written known to this one."""
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SCHEMAS[name])
        laid_out = ""
        if name in FACTS:
            columns += f", {DAY} date"
            laid_out = f"PARTITIONED BY ({DAY})"
            if self.buckets:
                laid_out += (f" CLUSTERED BY ({MACHINE}) SORTED BY ({MACHINE}, {FACTS[name]})"
                             f" INTO {self.buckets} BUCKETS")
        self.spark.sql(f"DROP TABLE IF EXISTS {self._table(name)}")
        self.spark.sql(f"CREATE TABLE {self._table(name)} ({columns}) USING parquet {laid_out}"
                       f" LOCATION '{self._path(name)}'")
        if name in FACTS:
            self.spark.sql(f"ALTER TABLE {self._table(name)} RECOVER PARTITIONS")

    def read(self, name: str) -> DataFrame:
        """A table that was written or opened; its columns in the canonical order, then ``day``."""
        return self.spark.table(self._table(name)).select(
            *SCHEMAS[name].names, *[DAY] * (name in FACTS))

    def tables(self) -> Tables:
        return Tables(self.read)
