"""The operators as queries over the test tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, htmltext, linededup, media, minhash, mixing, packing, quality, secrets, sharding
from .common import table


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_exact, n_near, n_links, and length and digest of the text that is left."""
    out = linededup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_exact", "n_near", "n_links", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("kept_chars"), F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.sharded(table(spark, sf_dir, "documents"), [1.0] * 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents")).drop("n_lexed")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.to_media(table(spark, sf_dir, "documents")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), carried=False)
    return out.select("doc_id", "size", "source_size", "target", "taken", "slot")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_minhash, op2_line_dedup, op3_sharding, op4_html, op5_secrets, op6_neighbours, op7_quality, op8_media, op9_packing, op10_mixing)}

#: Two lines of 16 characters or more within one edit have the same first 8 or the same last 8 characters.
_OP2_SQL = r"""
WITH pieces AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, text, i, ls[i] AS line FROM (SELECT doc_id, text, ls, unnest(generate_series(1, len(ls))) AS i FROM pieces)),
firsts AS (SELECT line, min((doc_id, i)) AS occ FROM lines WHERE length(line) >= 16 GROUP BY line),
pairs AS (
  SELECT a.line AS x, b.line AS y, a.occ AS ox, b.occ AS oy FROM firsts a JOIN firsts b ON left(a.line, 8) = left(b.line, 8) AND abs(length(a.line) - length(b.line)) <= 1 AND a.line <> b.line
  UNION
  SELECT a.line, b.line, a.occ, b.occ FROM firsts a JOIN firsts b ON right(a.line, 8) = right(b.line, 8) AND abs(length(a.line) - length(b.line)) <= 1 AND a.line <> b.line),
links AS (SELECT * FROM pairs WHERE levenshtein(x, y) <= 1),
lost AS (SELECT DISTINCT x FROM links WHERE oy < ox),
told AS (SELECT l.doc_id, l.i, l.line, length(l.line) < 16 AS short, f.occ = (l.doc_id, l.i) AS first, l.line IN (SELECT x FROM lost) AS near FROM lines l LEFT JOIN firsts f ON f.line = l.line),
n AS (SELECT ox AS occ, count(*) AS k FROM links GROUP BY ox),
per AS (
  SELECT t.doc_id, count(*) AS n_lines, count(*) FILTER (NOT short AND NOT first) AS n_exact, count(*) FILTER (NOT short AND first AND near) AS n_near,
    CAST(coalesce(sum(CASE WHEN first THEN n.k END), 0) AS BIGINT) AS n_links,
    coalesce(string_agg(t.line, chr(10) ORDER BY t.i) FILTER (short OR (first AND NOT near)), '') AS kept
  FROM told t LEFT JOIN n ON n.occ = (t.doc_id, t.i) GROUP BY t.doc_id)
SELECT doc_id, n_lines, n_exact, n_near, n_links, length(kept) AS kept_chars, md5(kept) AS kept_md5 FROM per
"""

#: The schedule slot by slot, and each document held against all blocks that overlap it.
_OP10_SQL = r"""
WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
told AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM sized GROUP BY source),
weighted AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][i % 3 + 1] AS w, 2.0::DOUBLE * n AS most, 1.5::DOUBLE * sum(n) OVER () AS goal FROM told),
filled AS (
  SELECT *, (goal - coalesce(sum(most) OVER (ORDER BY most / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY most / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM weighted),
goals AS (SELECT *, CASE WHEN coalesce(level * w > most, true) THEN most ELSE level * w END AS target FROM filled CROSS JOIN (SELECT arg_min(rest, (most / w, i)) FILTER (most / w >= rest) AS level FROM filled)),
cut AS (SELECT *, greatest(1, least(n, greatest(256, CAST(ceil(n / 1024) AS BIGINT)))) AS blocks FROM goals),
quotas AS (SELECT *, CASE WHEN n > 0 THEN CAST(least(floor(target * blocks / n + 0.5), 2 * blocks) AS BIGINT) ELSE 0 END AS quota FROM cut),
plan AS (SELECT *, CAST(coalesce(sum(quota) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lo FROM quotas),
size_of AS (SELECT CAST(greatest(sum(quota), 1) AS BIGINT) AS total, CAST(ceil(log2(greatest(sum(quota), 1))) AS BIGINT) AS bits FROM plan),
points AS (SELECT t, CAST(list_sum([((t >> b) & 1) << (bits - 1 - b) for b in range(bits)]) AS BIGINT) AS point FROM (SELECT bits, unnest(range(1::BIGINT << bits)) AS t FROM size_of)),
slots AS (SELECT p.i, t, (row_number() OVER (PARTITION BY p.i ORDER BY t) - 1) % p.blocks AS block FROM points JOIN plan p ON coalesce(point, 0) >= lo AND coalesce(point, 0) < lo + quota),
uses AS (
  SELECT s.i, block * (n // blocks) + least(block, n % blocks) AS a, (block + 1) * (n // blocks) + least(block + 1, n % blocks) AS b, count(*) AS times, min(t) AS t
  FROM slots s JOIN plan p ON p.i = s.i GROUP BY s.i, block, n, blocks),
placed AS (
  SELECT doc_id, size, n, target, i, row_number() OVER () AS rid, CAST(coalesce(sum(size) OVER (PARTITION BY i ORDER BY coalesce(substr(md5(CAST(doc_id AS VARCHAR)), 1, 15), repeat('0', 15)), doc_id NULLS FIRST, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
  FROM sized JOIN plan ON sized.source IS NOT DISTINCT FROM plan.source)
SELECT doc_id, size, any_value(n) AS source_size, any_value(target) AS target,
  CAST(coalesce(sum((least(b, pos + size) - greatest(a, pos)) * times), 0) AS BIGINT) AS taken, min(t) AS slot
FROM placed LEFT JOIN uses ON uses.i = placed.i AND a < pos + size AND b > pos AND size > 0 GROUP BY rid, doc_id, size
"""

#: What the others need (xxHash, minhashes, tokens, training, parsing) can't be told in SQL.
ORACLE_SQL: dict[str, str] = {"op2_line_dedup": _OP2_SQL, "op10_mixing": _OP10_SQL}
