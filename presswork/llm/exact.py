"""Exact deduplication by progressive refinement, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import first_rows, place, plain, stored, text_uid

PREFIX_CHARS = 64


def normalised(text: Column) -> Column:
    """The text with each run of white space as one space; null is empty."""
    return F.regexp_replace(plain(text), r"[\x20\x09-\x0D]+", " ")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), text_uid(id_col, text_col).alias("uid"),
                       normalised(F.col(text_col)).alias("body"))


def _keys(prefix_chars: int) -> tuple[Column, Column]:
    return (F.length("body").alias("n"),
            F.xxhash64(F.substring("body", 1, prefix_chars)).alias("prefix"))


def _repeated(body: DataFrame, prefix_chars: int) -> DataFrame:
    """The n and prefix that more than one row has, found by length first."""
    length, prefix = _keys(prefix_chars)
    repeated = F.col("count") > 1
    lengths = stored(body.select(length).groupBy("n").count().where(repeated).select("n"),
                     "exact-lengths")
    return stored(body.select(length, prefix).join(lengths, "n", "left_semi")
                  .groupBy("n", "prefix").count().where(repeated).select("n", "prefix"),
                  "exact-prefixes")


def _survivors(body: DataFrame, prefixes: DataFrame, prefix_chars: int) -> DataFrame:
    """doc_id, uid and text_sha256 of the rows whose length and prefix another row has.

    Bodies of other rows are dropped by the semi-join: in their scan while the
    prefixes are few enough for a broadcast or a Bloom filter.
    """
    return stored(body.select("doc_id", "uid", "body", *_keys(prefix_chars))
                  .join(prefixes, ["n", "prefix"], "left_semi")
                  .select("doc_id", "uid", F.sha2(F.encode("body", "utf-8"), 256).alias("text_sha256")),
                  "exact-survivors")


def _hashed(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int, digest_all: bool,
            ) -> tuple[DataFrame, DataFrame]:
    """All rows with text_sha256, null or not where it is not needed, and the rows that need it."""
    body = _rows(docs, id_col, text_col)
    prefixes = _repeated(body, prefix_chars)
    if digest_all:
        hashed = stored(body.select("doc_id", *_keys(prefix_chars), F.sha2(
            F.encode("body", "utf-8"), 256).alias("text_sha256")), "exact-hashed")
        return hashed, hashed.join(prefixes, ["n", "prefix"], "left_semi")
    survivors = _survivors(body, prefixes, prefix_chars)
    one = survivors.select(F.col("doc_id").alias("its_id"), F.col("uid").alias("its_uid"),
                           "text_sha256").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("uid") == F.col("its_uid"))
    return body.select("doc_id", "uid").join(one, same, "left"), survivors


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 prefix_chars: int = PREFIX_CHARS, digest_all: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are refined in three steps, each a count of narrow keys: by the length
    of the normalised text, then by a hash of its first characters, then by
    SHA-256 of all of it. Only rows whose group still has two rows go on to the
    next step. ``text_sha256`` is null for texts that never got to the last step,
    unless ``digest_all`` asks for the digest of every text.

    Of equal texts the row with the smallest id stays. Null and empty texts are
    equal. Repeated rows with one id and one text all have ``kept`` as that id
    has. Null ids never name the row that stays unless all ids of a group are
    null; these rows all stay. An empty table gives an empty result. Only the
    two named columns are read; others may have any name.

    Counts are aggregated before the shuffle, and the join back to the groups
    has a plain shuffle on both sides that Spark can split, so that a group may
    hold any share of the rows.
    """
    hashed, repeated = _hashed(docs, id_col, text_col, prefix_chars, digest_all)
    groups = stored(
        repeated.groupBy("text_sha256")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .where(F.col("group_size") > 1), "exact-groups")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return (hashed.join(groups, "text_sha256", "left")
            .select("doc_id", keep.alias("keep_id"),
                    F.coalesce("group_size", F.lit(1)).alias("group_size"),
                    F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256"))


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               null_ids_stay: bool = True) -> DataFrame:
    """``docs`` with one row of each group of equal texts, one of its smallest id; all columns stay.

    Rows go by id and text: other texts of an id that goes stay. Repeated rows of
    one id and one text leave one. Rows with a null id all stay, or with
    ``null_ids_stay=False`` only one of a group without other ids. Null and empty
    texts are equal; an empty table stays empty; columns may have any name.
    Texts are read for their length and prefix, but only those whose length and
    prefix occur again are carried on and hashed whole.
    """
    body = _rows(docs, id_col, text_col)
    again = _survivors(body, _repeated(body, PREFIX_CHARS), PREFIX_CHARS)
    firsts = stored(again.groupBy("text_sha256").agg(F.min(place()).alias("first"),
                                                     F.count("*").alias("group_size"))
                    .where("group_size > 1").drop("group_size"), "exact-firsts")
    return first_rows(docs, again.join(firsts, "text_sha256"), id_col, text_col, null_ids_stay)
