"""Sharding by extendible hashing.

A document's key is hashed to bits.  The directory starts with one bucket;
a bucket over the byte limit splits on the next bit of the hash, and only
it.  So a document's shard is the shortest prefix of its bits whose bucket
fits, and that can be told from sums of bytes by prefix, without moving a
document: the bytes are summed by a prefix of ``STEP`` bits, from which the
sums of all shorter prefixes follow, and only what doesn't fit there is
summed by the next ``STEP`` bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Bits that are resolved in one round; a round's directory has 2 ** STEP entries for each bucket that is still too large.
STEP = 12
#: The hash is the 128 bits of an MD5.
BITS = 128


def bits_of(key: str) -> str:
    """SQL: the MD5 of the text of a key as 128 characters 0 and 1."""
    return f"concat(lpad(conv(substring(md5({key}), 1, 15), 16, 2), 60, '0'), lpad(conv(substring(md5({key}), 16, 15), 16, 2), 60, '0'), lpad(conv(substring(md5({key}), 31, 2), 16, 2), 8, '0'))"


def sharded(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, bytes, shard, depth, shard_bytes, overflow) of each row.

    shard is the bucket's hash prefix, '' while all fits into one.  A null
    text has no bytes; a null key is the key ''.  Rows of one key share all
    bits: if they exceed the limit together they are one shard of depth 128
    with overflow true, as is a row over the limit alone in its bucket.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.expr(f"cast(coalesce(octet_length({text}), 0) as bigint)").alias("bytes"))
    rows = stored(rows.withColumn("_bits", F.expr(bits_of("coalesce(cast(doc_id as string), '')"))), "shard-rows")
    # The open buckets of a round and their leaves; a leaf is final if it fits or no bit is left.
    leaves, open_, depth = None, None, 0
    sums = stored(rows.groupBy("_bits").agg(F.sum("bytes").alias("bytes")), "shard-keys")
    while depth < BITS:
        to = min(BITS, depth + STEP)
        fine = sums if open_ is None else sums.join(open_, F.expr(f"left(_bits, {depth})") == F.col("prefix"), "left_semi")
        fine = fine.groupBy(F.expr(f"left(_bits, {to})").alias("p")).agg(F.sum("bytes").alias("b"), F.count("*").alias("keys"))
        fine = stored(fine, "shard-fine")
        levels = fine.select("p", "b", "keys", F.explode(F.sequence(F.lit(depth), F.lit(to))).alias("d"))
        levels = levels.groupBy(F.expr("left(p, d)").alias("prefix"), "d").agg(F.sum("b").alias("b"), F.sum("keys").alias("keys"))
        levels = stored(levels.withColumn("fits", F.expr(f"b <= {limit}")), "shard-levels")
        # the shortest fitting prefix of each fine one
        fit = fine.select("p", F.explode(F.sequence(F.lit(depth), F.lit(to))).alias("d")).withColumn("prefix", F.expr("left(p, d)")).join(levels.where("fits"), ["prefix", "d"])
        fit = fit.groupBy("p").agg(F.min(F.struct("d", "prefix", "b")).alias("x")).select("x.prefix", F.col("x.b").alias("shard_bytes"), F.lit(False).alias("overflow")).distinct()
        # a single key that doesn't fit will not split: it is a shard at once
        alone = levels.where(f"not fits and keys = 1 and d = {to}")
        alone = alone.join(sums.withColumn("prefix", F.expr(f"left(_bits, {to})")), "prefix").select(F.col("_bits").alias("prefix"), F.col("b").alias("shard_bytes"), F.lit(True).alias("overflow"))
        fit = fit.union(alone)
        leaves = stored(fit if leaves is None else leaves.union(fit), "shard-leaves")
        open_ = stored(levels.where(f"not fits and keys > 1 and d = {to}").select("prefix"), "shard-open")
        if not open_.head(1):
            break
        depth = to
    depths = [r[0] for r in leaves.select(F.expr("length(prefix)")).distinct().orderBy(F.expr("1")).collect()]
    keys = stored(_placed(sums, leaves, depths), "shard-placed")
    return rows.join(keys, "_bits").select("doc_id", "bytes", "shard", F.length("shard").cast("int").alias("depth"), "shard_bytes", "overflow")


def _placed(sums: DataFrame, leaves: DataFrame, depths: list[int]) -> DataFrame:
    """The leaf of each hash: prefixes of the lengths that leaves have, of which exactly one is a leaf."""
    asked = sums.select("_bits", F.explode(F.array(*[F.lit(d) for d in depths])).alias("d") if depths else F.lit(0).alias("d")).withColumn("prefix", F.expr("left(_bits, d)"))
    return asked.join(leaves, "prefix").select("_bits", F.col("prefix").alias("shard"), "shard_bytes", "overflow")
