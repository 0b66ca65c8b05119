"""Shards by weighted rendezvous hashing of stable record keys.

Every shard draws a uniform number u from (key, shard), and the row goes to the shard of the smallest
-ln(u) / weight. A shard gets rows in proportion to its weight; when one more joins, a row either stays or
moves into the new one, as the other draws don't change.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running, staged, sub_bits

#: Equal rows that leave as one stretch; larger groups are cut into stretches that are spread over all tasks.
CHUNK = 4096


def draw(key: Column, shard: int, weight: float) -> Column:
    """-ln(u) / weight, u in (0, 1) from 53 bits of a hash. A null key counts as a key of its own."""
    h = F.xxhash64(F.coalesce(key.cast("string"), F.lit("\0null")), F.lit(shard))
    u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / weight


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard, from 0; the smaller one on a tie. Weights are positive."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights are positive, and there is one at least")
    best = F.least(*[F.struct(draw(key, i, w).alias("d"), F.lit(i).alias("s")) for i, w in enumerate(weights)]) if len(weights) > 1 else F.struct(F.lit(0).alias("s"))
    return best["s"].cast("int")


def sharded(docs: DataFrame, weights: Sequence[float], grown: float | None = 1.0, key: str = "doc_id") -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text + 8), text_crc32, shard, slot and grown_shard of every row of docs (doc_id, text).

    slot counts the shard's rows from 0 without gaps, in the order of a hash of the row. grown_shard is the
    shard with one more of weight `grown`. A null text has no bytes and the check sum of the empty one; a null key is a
    key of its own. Equal rows are counted before they are shuffled and then get slots side by side, in stretches of
    CHUNK that any task can make, so one key on a third of all rows is no hot group. An empty table gives none.
    """
    rows = docs.select(F.col(key).alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"), F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("text_crc32"))
    told = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("_n"))
    told = told.withColumns({"shard": shard_of(F.col("doc_id"), list(weights)), "grown_shard": shard_of(F.col("doc_id"), [*weights, grown]) if grown else F.lit(None).cast("int")})
    told = staged(told.withColumn("_h", F.xxhash64("doc_id", "size", "text_crc32")), "shards")
    placed = running(told, ["shard"], "_h", F.col("_n"), "_at", sub_bits(told.count() // len(weights)), ["doc_id", "size", "text_crc32"])
    cut = placed.withColumn("_from", F.explode(F.sequence(F.col("_at"), F.col("_at") + F.col("_n") - 1, F.lit(CHUNK).cast("long"))))
    cut = cut.withColumn("_to", F.least(F.col("_from") + CHUNK, F.col("_at") + F.col("_n")) - 1)
    hot = F.col("_n") > CHUNK
    # a number of partitions is given, as a stretch is small before it is made and Spark would put many into one task
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = cut.where(~hot) if told.where(hot).isEmpty() else cut.where(~hot).union(cut.where(hot).repartition(n, "_from"))
    slots = spread.withColumn("slot", F.explode(F.sequence("_from", "_to")))
    return slots.select("doc_id", "size", "text_crc32", "shard", "slot", "grown_shard")
