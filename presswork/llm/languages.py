"""Language identification by fusing the evidence of a text, its markup and its address.

The score of a language is, in logarithms, the sum of the text's likelihood, the
likelihood of the declared markup language and of the address suffix in it, and
the prior of the host. Nothing is labelled but the texts that the text model is
made from: how declarations, suffixes and hosts go with languages is counted by
grouped aggregation, with each record's posterior by text alone as its weight.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import boxed, plain, stored

#: Buckets for the hashes of byte trigrams: the size of the model for each language.
BUCKETS = 1 << 14
#: Trigrams of running text repeat each other's evidence, so their likelihoods are tempered.
TEXT_WEIGHT = 0.2
#: Weight of the level above, in records, when a level's counts are smoothed.
STRENGTH = 4.0

_SLICE = 1 << 20
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:ord("a")] = ord(" ")
_FOLD[ord("a"):ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("z") + 1:128] = ord(" ")


def trigrams(text: str) -> np.ndarray:
    """How often each bucket's byte trigrams are in the text, in lower case, with other signs as spaces."""
    raw = np.frombuffer(f" {text.lower()} ".encode(), np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(raw) - 2, _SLICE):
        b = _FOLD[raw[at:at + _SLICE + 2]]
        code = b[:-2] | b[1:-1] << 8 | b[2:] << 16
        code = code[(b[1:-1] != 32) | (b[:-2] != 32)]
        counts += np.bincount((code * np.uint32(2654435761)) >> np.uint32(18), minlength=BUCKETS)
    return counts


@dataclass(frozen=True)
class TextModel:
    """Log probabilities of trigram buckets, a row for each of ``languages``."""

    languages: tuple[str, ...]
    logs: np.ndarray


def train_text_model(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text",
                     most: int = 500) -> TextModel:
    """Counts the trigrams of all labelled texts by language; rows with a null language are left out.

    Each task adds up what it reads; the driver gets :data:`BUCKETS` numbers a
    language. More than ``most`` languages, as unclean labels have, are an error.
    Without labelled texts the model has no language. Null texts count as empty.
    """
    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
                if lang not in totals:
                    totals[lang] = np.zeros(BUCKETS, np.int64)
                totals[lang] += trigrams(text.as_py())
        for lang, counts in totals.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at])],
                ["lang", "bucket", "n"])

    known = labelled.where(F.col(lang_col).isNotNull())
    codes = known.select(lang_col).distinct().limit(most + 1).count()
    if codes > most:
        raise ValueError(f"there are more than {most} languages; clean the labels or raise the bound")
    found = (known
             .select(F.col(lang_col).alias("lang"), plain(F.col(text_col)).alias("text"))
             .mapInArrow(count, "lang string, bucket long, n long")
             .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow())
    names = np.array(found["lang"].to_pylist(), dtype=object)
    languages = tuple(sorted(set(names.tolist())))
    counts = np.full((len(languages), BUCKETS), 0.5)
    for row, lang in enumerate(languages):
        mine = names == lang
        counts[row, found["bucket"].to_numpy()[mine]] += found["n"].to_numpy()[mine]
    return TextModel(languages, np.log(counts / counts.sum(axis=1, keepdims=True)))


def text_scores(text: Column, model: TextModel) -> Column:
    """The tempered log likelihood of each whole text in each language; zeros without a text."""
    logs = model.logs.astype(np.float32)

    @F.arrow_udf("array<double>")
    def score(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts:
            counts = trigrams(text.as_py())
            at = np.flatnonzero(counts)
            rows.append((TEXT_WEIGHT * (logs[:, at].astype(np.float64) @ counts[at])).tolist())
        return pa.array(rows, pa.list_(pa.float64()))

    return score(plain(text))


def page_records(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) as records: visible text, declared language, host and the levels above."""
    lower = F.lower("url")
    host = F.regexp_replace(F.regexp_extract(lower, r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1),
                            r"^.*@|\.?(:[0-9]*)?$", "")
    declared = F.lower(F.regexp_extract(
        F.col("html"), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,8})", 1))
    text = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-z0-9#]+;", " ")
    named = pages.select(
        "page_id", text.alias("text"), F.nullif(declared, F.lit("")).alias("declared"),
        F.nullif(host, F.lit("")).alias("host"))
    return named.select(
        "*", F.regexp_extract("host", r"([^.]+\.)?[^.]+$", 0).alias("domain"),
        F.regexp_extract("host", r"[^.]+$", 0).alias("suffix"))


def _total(arrays: Column, size: int) -> Column:
    return F.array(*[F.sum(arrays[i]) for i in range(size)])


def _smoothed(counts: Column, above: Column) -> Column:
    """Shares of counts, with the shares of the level above as :data:`STRENGTH` records."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, above, lambda n, p: (n + STRENGTH * p) / (total + STRENGTH))


def identify(records: DataFrame, model: TextModel) -> DataFrame:
    """``records`` with text_language, language and confidence in place of text.

    ``records`` has text, declared, host, domain and suffix, each of which may be
    null, and any others, which stay; columns that are called like the three
    results are replaced. Repeated rows stay, each a record. ``language`` has the largest posterior,
    which is ``confidence``; ties go to the first code. Where a record has no
    text and shares no address with others, that is the most frequent language.
    Without a language in the model all three columns are null.

    The prior of a host is smoothed by that of its domain, and this by all
    records; the suffix is evidence of its own, as the declared language is, and
    so is not a level of the prior, where it would count twice. A record's own text is left out of the
    counts it is judged by. Counts are aggregated before the shuffle and joined
    back from written tables, which Spark broadcasts if they are small, and by
    shuffles that it can split if not; so a host may have any share of the records.
    """
    size = len(model.languages)
    results = ("text_language", "language", "confidence")
    if not size:
        kept = [c for c in records.columns if c not in ("text", *results)]
        none = F.lit(None)
        return records.select(*kept, none.cast("string").alias("text_language"),
                              none.cast("string").alias("language"), none.cast("double").alias("confidence"))
    levels = ("host", "domain", "suffix", "declared")
    kept = records.drop("text", *results).columns
    scored = boxed(records, scores=text_scores(F.col("text"), model),
                   **{level: F.col(level) for level in levels})
    scored = scored.withColumn("row", F.struct(*(F.col("row").getField(c).alias(c) for c in kept)))
    scored = stored(scored.withColumn("own", _softmax(F.col("scores"))), "text-scores")
    totals = stored(scored.agg(_total(F.col("own"), size).alias("all")), "language-totals")
    zero = F.array(*[F.lit(0.0)] * size)
    everything = totals.first()["all"]
    overall = F.array(*[F.lit(float(n or 0)) for n in everything])

    joined = scored
    for level in levels:
        counts = stored(scored.where(F.col(level).isNotNull()).groupBy(F.col(level).alias("key"))
                        .agg(_total(F.col("own"), size).alias(f"of_{level}")), f"by-{level}")
        joined = joined.join(counts, joined[level] == counts["key"], "left").drop("key")

    less = lambda c: F.zip_with(c, F.col("own"), lambda n, o: F.greatest(n - o, F.lit(0.0)))
    without = {f"of_{level}": F.coalesce(less(F.col(f"of_{level}")), zero) for level in levels}
    joined = joined.withColumns(without).withColumn("of_all", less(overall))
    even = F.array(*[F.lit(1.0 / size)] * size)
    joined = joined.withColumn("prior", _smoothed(F.col("of_all"), even))
    for level in ("domain", "host"):
        joined = joined.withColumn("prior", _smoothed(F.col(f"of_{level}"), F.col("prior")))
    score = F.zip_with("scores", "prior", lambda t, p: t + F.log(p))
    for level in ("declared", "suffix"):
        # how often records in each language have this value, against how often any record has
        share = F.zip_with(f"of_{level}", "of_all", lambda n, all_: (n + 0.1) / (all_ + 0.1 * 10))
        score = F.when(F.col(level).isNull(), score).otherwise(
            F.zip_with(score, share, lambda s, p: s + F.log(p)))
    names = F.array(*map(F.lit, model.languages))
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    return joined.withColumn("post", _softmax(score)).select(
        *(F.col("row").getField(c).alias(c) for c in kept), best(F.col("own")).alias("text_language"),
        best(F.col("post")).alias("language"), F.array_max("post").alias("confidence"))


def _softmax(scores: Column) -> Column:
    powers = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, x: a + x))
