"""The operators over the test tables, as the driver runs them, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe, centroids, exact, languages, manifest, packing, search, simhash, substrings, tokens, toxicity,
    url_lists, warc,
)
from .shared import small_batches

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page, by all evidence, and of every document, by its text and source.

    The text model is made from documents that are not held out by
    ``toxicity.held_out``; ``lang`` is no evidence for a document.
    """
    docs = table(spark, sf_dir, "documents")
    held_out = toxicity.held_out(F.col("doc_id"))
    model = languages.train_text_model(docs.where(~held_out))
    none = F.lit(None)
    pages = languages.page_records(table(spark, sf_dir, "pages")).withColumns(
        {"doc_id": none.cast("long"), "held_out": none.cast("boolean")})
    texts = docs.select("doc_id", "text", F.col("source").alias("host"), held_out.alias("held_out")
                        ).withColumns({"page_id": none.cast("long"), **{
                            name: none.cast("string") for name in ("declared", "domain", "suffix")}})
    found = languages.identify(pages.unionByName(texts), model)
    return found.select("page_id", "doc_id", "held_out", "declared", "host", "text_language",
                        "language", "confidence")


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = bpe.bpe_encode(F.col("text"), ranks).alias("ids")
    docs = table(spark, sf_dir, "documents").select("doc_id", ids)
    both = docs.select("doc_id", "ids", bpe.bpe_decode(F.col("ids"), ranks).alias("decoded"))
    return both.select("doc_id", bpe.id_count(F.col("ids")).alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_inner_products(table(spark, sf_dir, "embeddings"))


TOP_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank,
    vec_id, score
  FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def web_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def packed(docs: DataFrame, with_ids: bool = False) -> DataFrame:
    """The place of each piece of all documents and a digest of its ids; ``with_ids``, the ids too."""
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    light = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                          *["ids"] * with_ids)
    return packing.pack(light)


def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def _unit(text: F.Column, at: int, below: int) -> F.Column:
    """A number from 0 to ``below`` - 1 made from a text."""
    digits = F.conv(F.substring(F.md5(text.cast("binary")), at, 6), 16, 10)
    return F.pmod(digits.cast("long"), F.lit(below))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with a fetch time within 2024, made from the page's id."""
    at = F.col("page_id").cast("string")
    day = F.date_add(F.lit("2024-01-01").cast("date"), _unit(at, 1, 366).cast("int"))
    return table(spark, sf_dir, "pages").select(
        "page_id", "url",
        (day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), _unit(at, 7, 24).cast("int")))
        .alias("fetched_at"))


def list_entries(pages: DataFrame) -> DataFrame:
    """Up to four dated list entries for each host, parent domain and first path segment seen."""
    keys = (url_lists.url_keys(pages.select("url")).select(F.explode("keys").alias("list_key"))
            .distinct())
    of = F.concat_ws(" ", "list_key", "k")
    day = F.date_add(F.lit("2023-10-01").cast("date"), _unit(of, 1, 450).cast("int"))
    return (keys.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
            .where(F.col("k") < _unit(F.col("list_key"), 1, 5))
            .select("list_key",
                    F.element_at(F.array(*map(F.lit, url_lists.ACTIONS)),
                                 (_unit(of, 7, 3) + 1).cast("int")).alias("action"),
                    day.cast("timestamp_ntz").alias("dated")))


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = captures(spark, sf_dir)
    return url_lists.filter_urls(seen, list_entries(seen))


URL_SQL = """
WITH c AS (
  SELECT page_id, url, lower(url) AS u, md5(page_id::VARCHAR) AS h FROM pages),
captures AS (
  SELECT page_id, url, u,
    (DATE '2024-01-01' + (('0x' || h[1:6])::BIGINT % 366)::INT)::TIMESTAMP
      + to_hours((('0x' || h[7:12])::BIGINT % 24)::INT) AS fetched_at,
    nullif(regexp_replace(regexp_replace(
      regexp_extract(u, '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''),
      '\\.?(:[0-9]*)?$', ''), '') AS host,
    regexp_extract(u, '^[a-z][a-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1) AS segment
  FROM c),
keyed AS (
  SELECT page_id, url, fetched_at, host, unnest(list_concat(list_concat([host],
      CASE WHEN regexp_matches(host, '^[0-9.]+$') THEN []
           ELSE list_transform(range(2, len(string_split(host, '.'))),
                  lambda i: array_to_string(string_split(host, '.')[i:], '.')) END),
      CASE WHEN segment <> '' THEN [host || '/' || segment] ELSE [] END)) AS list_key
  FROM captures WHERE host IS NOT NULL),
numbered AS (
  SELECT list_key, md5(list_key || ' ' || k) AS h FROM (
    SELECT list_key, unnest(range(0, ('0x' || md5(list_key)[1:6])::BIGINT % 5)) AS k
    FROM (SELECT DISTINCT list_key FROM keyed))),
entries AS (
  SELECT list_key, ('0x' || h[7:12])::BIGINT % 3 AS rank,
    (DATE '2023-10-01' + (('0x' || h[1:6])::BIGINT % 450)::INT)::TIMESTAMP AS dated
  FROM numbered),
dated AS (SELECT list_key, dated, min(rank) AS rank FROM entries GROUP BY ALL),
spans AS (
  SELECT list_key, rank, dated AS valid_from,
    coalesce(lead(dated) OVER (PARTITION BY list_key ORDER BY dated),
             TIMESTAMP '9999-01-01 00:00:00') AS valid_to
  FROM dated),
met AS (
  SELECT k.*, s.rank, s.valid_from, s.valid_to,
    row_number() OVER (PARTITION BY page_id, url, fetched_at
                       ORDER BY length(list_key) DESC, list_key) AS place
  FROM (SELECT DISTINCT * FROM keyed) k JOIN spans s USING (list_key)
  WHERE s.rank < 2 AND s.valid_from <= fetched_at AND fetched_at < s.valid_to)
SELECT c.page_id, c.url, c.fetched_at, c.host, m.list_key,
  CASE m.rank WHEN 0 THEN 'block' WHEN 1 THEN 'allow' END AS action,
  m.valid_from, m.valid_to, coalesce(m.rank = 0, false) AS blocked
FROM (SELECT DISTINCT page_id, url, fetched_at, host FROM captures) c
LEFT JOIN met m ON m.place = 1 AND m.page_id IS NOT DISTINCT FROM c.page_id
  AND m.url IS NOT DISTINCT FROM c.url AND m.fetched_at IS NOT DISTINCT FROM c.fetched_at
"""


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"), digest_all=True)


EXACT_SQL = """
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS body
  FROM documents),
g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept,
  sha256(d.body) AS text_sha256
FROM d JOIN g USING (body)
"""

def simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"),
                         "component_id")


def toxic_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    return toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), toxic_model(spark, sf_dir))


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, tampered with where 7 divides the crc32 of the id."""
    return manifest.verified_manifest(
        table(spark, sf_dir, "documents"),
        tampered=lambda: F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)


MANIFEST_SQL = """
WITH RECURSIVE named AS (
  SELECT doc_id, lang, n_chars, list_transform(
      [doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text, (n_chars::HUGEINT + 1)::VARCHAR],
      lambda v: coalesce(strlen(v) || ':' || v, '-')) AS f,
    xor(4294967295, list_reduce(
      list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)),
        lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, lang, sha256(f[1] || f[2] || f[3] || f[4] || f[5]) AS leaf,
    CASE WHEN crc % 7 = 0 AND n_chars IS NOT NULL
      THEN sha256(f[1] || f[2] || f[3] || f[6] || f[5]) END AS altered
  FROM named),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS tree,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM leaves),
nodes AS (
  SELECT tree, 0 AS level, pos, leaf AS node, count(*) OVER (PARTITION BY tree) AS size FROM placed
  UNION ALL
  SELECT tree, any_value(level) + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)),
    (any_value(size) + 1) // 2
  FROM nodes WHERE size > 1 GROUP BY tree, pos // 2),
subroots AS (
  SELECT tree, level, node, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS size
  FROM nodes WHERE size = 1),
tops AS (
  SELECT 0 AS level, pos, node, size FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)),
    (any_value(size) + 1) // 2
  FROM tops WHERE size > 1 GROUP BY pos // 2),
steps AS (
  SELECT p.tree, p.pos, n.level, n.pos > (p.pos >> n.level) AS after, n.node AS other
  FROM placed p JOIN nodes n ON n.tree = p.tree AND n.size > 1 AND n.pos = xor(p.pos >> n.level, 1)
  UNION ALL
  SELECT p.tree, p.pos, s.level + t.level, t.pos > (s.pos >> t.level), t.node
  FROM placed p JOIN subroots s USING (tree)
    JOIN tops t ON t.size > 1 AND t.pos = xor(s.pos >> t.level, 1)),
heights AS (
  SELECT tree, s.level + (SELECT max(level) FROM tops) AS height FROM subroots s),
folds AS (
  SELECT tree, pos, 0 AS level, coalesce(altered, leaf) AS node FROM placed
  UNION ALL
  SELECT f.tree, f.pos, f.level + 1, sha256(CASE WHEN s.after THEN f.node || s.other
    ELSE coalesce(s.other, '') || f.node END)
  FROM folds f JOIN heights h ON h.tree = f.tree AND f.level < h.height
    LEFT JOIN steps s ON s.tree = f.tree AND s.pos = f.pos AND s.level = f.level),
proofs AS (
  SELECT tree, pos, string_agg(other, '' ORDER BY level) AS proof FROM steps GROUP BY tree, pos)
SELECT p.doc_id, p.leaf, s.node AS subroot, r.node AS root, sha256(coalesce(q.proof, '')) AS proof_sha256,
  f.node AS folded_root, f.node = r.node AS verified
FROM placed p JOIN subroots s USING (tree) JOIN heights h USING (tree)
  JOIN folds f ON f.tree = p.tree AND f.pos = p.pos AND f.level = h.height
  JOIN (SELECT node FROM tops WHERE size = 1) r ON true
  LEFT JOIN proofs q ON q.tree = p.tree AND q.pos = p.pos
"""


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"),
                               public_tokenizers.path("piece_bpe_32k.model"))


def centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))


def _cluster_sql(rounds: int = centroids.ROUNDS, clusters: int = centroids.CLUSTERS) -> str:
    """The rounds one after the other; rows are numbered, since ids may repeat."""
    parts = [f"""
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::HUGEINT) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1 AS cluster, v AS c
  FROM v QUALIFY cluster < {clusters})"""]
    for r in range(rounds + 1):
        parts.append(f""",
a{r} AS MATERIALIZED (
  SELECT n, min(struct_pack(d := list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))),
                            cluster := cluster)) AS best
  FROM v, c{r} GROUP BY n)""")
        if r < rounds:
            parts.append(f""",
m{r} AS (
  SELECT cluster, list((total - ((total % members) + members) % members) // members ORDER BY place) AS c
  FROM (SELECT a.best.cluster AS cluster, place, sum(v.v[place])::HUGEINT AS total, count(*) AS members
        FROM a{r} a JOIN v USING (n), range(1, 65) t(place) GROUP BY ALL) GROUP BY cluster),
c{r + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(m.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} m USING (cluster))""")
    parts.append(f"""
SELECT v.vec_id, a.best.cluster::INT AS cluster, a.best.d::BIGINT AS distance,
  (sum(a.best.d) OVER (PARTITION BY a.best.cluster))::BIGINT AS cluster_inertia,
  (sum(a.best.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM v JOIN a{rounds} a USING (n) JOIN c{rounds} c ON c.cluster = a.best.cluster""")
    return "".join(parts)


QUERIES: dict[str, Query] = {
    "op1_language_id": language_id,
    "op2_byte_bpe": byte_bpe,
    "op3_top_k": top_k,
    "op4_packing": packing_query,
    "op5_warc": web_archive,
    "op6_simhash": simhash_groups,
    "op7_toxicity": toxicity_scores,
    "op8_substring_dedup": substring_dedup,
    "op9_url_filters": url_filter,
    "op10_exact_dedup": exact_dedup,
    "op11_merkle_manifest": merkle_manifest,
    "op12_token_counts": token_counts,
    "op13_centroid_clusters": centroid_clusters,
}

SQL: dict[str, str] = {
    "op3_top_k": TOP_SQL,
    "op9_url_filters": URL_SQL,
    "op10_exact_dedup": EXACT_SQL,
    "op11_merkle_manifest": MANIFEST_SQL,
    "op13_centroid_clusters": _cluster_sql(),
}
