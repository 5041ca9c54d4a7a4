"""URL lists with dates: which entry was active when a page was fetched. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Actions of an entry, the one that wins on equal dates first.
ACTIONS = ("block", "allow", "remove")
FOREVER = "9999-01-01 00:00:00"


def url_keys(captures: DataFrame) -> DataFrame:
    """``captures`` with ``host`` and ``keys``: what an entry may name to match the URL.

    Keys are the host, its parent domains of two labels or more (none for
    numeric addresses), and the host with the first segment of the path. A null
    or malformed URL has a null host and no keys.
    """
    lower = F.lower("url")
    authority = F.regexp_extract(lower, r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    host = F.regexp_replace(authority, r"^.*@|\.?(:[0-9]*)?$", "")
    segment = F.regexp_extract(lower, r"^[a-z][a-z0-9+.-]*://[^/?#]*/([^/?#]+)", 1)
    labels = F.split("host", r"\.")
    parents = F.when(
        (F.size(labels) > 2) & ~F.col("host").rlike(r"^[0-9.]+$"),
        F.transform(F.sequence(F.lit(2), F.size(labels) - 1),
                    lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")),
    ).otherwise(F.array().cast("array<string>"))
    paths = F.when(F.col("segment") != "", F.array(F.concat_ws("/", "host", "segment")))
    keys = F.concat(F.array("host"), parents, F.coalesce(paths, F.array().cast("array<string>")))
    return (captures.withColumn("host", F.when(host != "", host)).withColumn("segment", segment)
            .withColumn("keys", F.when(F.col("host").isNotNull(), keys)).drop("segment"))


def validity(entries: DataFrame) -> DataFrame:
    """Dated entries (``list_key``, ``action``, ``dated``) as intervals ``[valid_from, valid_to)``.

    An entry holds until the next one for its key. Of entries for one key and
    date the first of :data:`ACTIONS` holds; repeated entries are one. "remove"
    only ends what was before. Entries with a null key, date or unknown action
    are left out.
    """
    rank = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action"))
    per_date = (entries.where(rank > 0).where("list_key is not null and dated is not null")
                .groupBy("list_key", "dated").agg(F.min(rank).alias("rank")))
    # the next date within the month, or the first of the key's next month that has one: so no
    # task sorts more of a key's entries than a month's, or a date for each of its months
    per_date = per_date.withColumn("month", F.trunc("dated", "month"))
    within = F.lead("dated").over(Window.partitionBy("list_key", "month").orderBy("dated"))
    months = per_date.groupBy("list_key", "month").agg(F.min("dated").alias("first"))
    months = months.withColumn("later", F.lead("first").over(
        Window.partitionBy("list_key").orderBy("month"))).drop("first")
    return (per_date.withColumn("within", within).join(months, ["list_key", "month"])
            .withColumn("valid_to", F.coalesce("within", "later", F.lit(FOREVER).cast("timestamp_ntz")))
            .where(F.col("rank") < 3)
            .select("list_key", F.element_at(F.array(*map(F.lit, ACTIONS)), F.col("rank").cast("int"))
                    .alias("action"), F.col("dated").alias("valid_from"), "valid_to"))


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id") -> DataFrame:
    """The entry that decides on each capture: an as-of join of captures and dated entries.

    ``captures`` has ``id_col``, ``url`` and ``fetched_at`` (no time zone). The
    result has one row per distinct capture: the three columns, host, list_key,
    action, valid_from, valid_to of the entry active at ``fetched_at`` with the
    longest matching key (ties: the smaller text), all null if there is none,
    and ``blocked``. Captures with a null URL or time match no entry.

    Both sides are cut into months: an interval stands once in every month that
    it covers and any capture is of, and a capture looks only into its own. One
    wrong date adds one month, however far off it is. So a key with a long history costs each
    capture the few entries of one month, and a host that holds a third of the
    captures is spread over months and split further by Spark, which finds a
    plain shuffle on both sides, or broadcasts the intervals if they are small.
    """
    seen = url_keys(captures.select(F.col(id_col).alias("id"), "url", "fetched_at"))
    # at most the months of the years 1 to 9999
    months = seen.agg(F.sort_array(F.collect_set(F.trunc("fetched_at", "month")))).scalar()
    wanted = (seen.where("keys is not null and fetched_at is not null")
              .select("id", "url", "fetched_at", "host", F.explode("keys").alias("list_key"))
              .withColumn("month", F.trunc("fetched_at", "month")))
    open_in = (validity(entries).withColumn("months", months)
               .withColumn("month", F.explode(F.filter("months", lambda m: (
                   m >= F.trunc("valid_from", "month")) & (m < F.col("valid_to")))))
               .drop("months"))
    holds = ((F.col("valid_from") <= F.col("fetched_at"))
             & (F.col("fetched_at") < F.col("valid_to")))
    met = (wanted.join(open_in, ["list_key", "month"]).where(holds)
           .select("id", "url", "fetched_at", "host", F.struct(
               (-F.length("list_key")).alias("order"), "list_key", "action", "valid_from",
               "valid_to").alias("entry")))
    nothing = seen.select("id", "url", "fetched_at", "host",
                          F.lit(None).cast(met.schema["entry"].dataType).alias("entry"))
    best = (met.unionByName(nothing).groupBy("id", "url", "fetched_at", "host")
            .agg(F.min("entry").alias("entry")))
    return best.select(
        F.col("id").alias(id_col), "url", "fetched_at", "host", "entry.list_key", "entry.action",
        "entry.valid_from", "entry.valid_to",
        F.coalesce(F.col("entry.action") == "block", F.lit(False)).alias("blocked"))
