"""Sharding by extendible hashing, in DataFrame functions only.

A directory maps hash prefixes to shards. It starts with one shard; only a shard over the byte
limit splits on the next bit, until every shard fits. Bits are settled ``LEVEL_BITS`` at a time: bytes
are summed per (prefix, next bits), a prefix's depth is the first at which its sum fits, and
rows of prefixes that are still too large go on to the next bits. So a level reads only rows of
oversized prefixes, sums combine before the shuffle, and the directory is a table, never on the driver.

The first 60 bits come from the id's digest. Rows that share an id (or have none) split on 60
more bits of a row number that is fixed when the sizes are written; a shard of one row
is final, whatever its size.

Defined results: a null text has 0 bytes; a null id is hashed like the empty string; an empty
table gives no rows. Other columns are never read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forestlens.llm.common import materialize

KEY_BITS = 60
LEVEL_BITS = 10


def key_bits(doc_id: str) -> Column:
    """The first 60 bits of the id's MD5 digest, as a non-negative long."""
    digest = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def shard(docs: DataFrame, limit_bytes: int, size: Column | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, bytes, shard, depth, shard_bytes, shard_docs`` per row. ``shard`` is the bit prefix
    (empty for the only shard of a small table). No shard exceeds ``limit_bytes`` unless it is one row."""
    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))) if size is None else size
    rows = materialize(docs.select(
        F.col(doc_id).alias("doc_id"), size.cast("long").alias("bytes"), key_bits(doc_id).alias("h0"),
        F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - KEY_BITS).alias("h1"), F.lit("").alias("parent")), "shard-sizes")
    settled, levels = None, 2 * KEY_BITS // LEVEL_BITS
    for level in range(levels):
        word, shift = divmod(level * LEVEL_BITS, KEY_BITS)
        bucket = F.shiftright(f"h{word}", KEY_BITS - LEVEL_BITS - shift).bitwiseAND((1 << LEVEL_BITS) - 1).cast("int")
        bits = F.lpad(F.bin(F.col("bucket").cast("long")), LEVEL_BITS, "0")
        rows = rows.withColumn("bucket", bucket)
        sums = rows.groupBy("parent", "bucket").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
        depths = F.sequence(F.lit(1 if level else 0), F.lit(LEVEL_BITS))
        every = sums.select("parent", "bucket", "bytes", "n", F.explode(depths).alias("d"), bits.alias("bits")).withColumn(
            "prefix", F.substr("bits", F.lit(1), F.col("d")))
        nodes = every.groupBy("parent", "d", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
        fits = nodes.filter((F.col("shard_bytes") <= limit_bytes) | (F.col("shard_docs") == 1))
        leaf = every.select("parent", "bucket", "d", "prefix").join(fits, ["parent", "d", "prefix"]).groupBy("parent", "bucket").agg(
            F.min_by(F.struct("prefix", "shard_bytes", "shard_docs"), "d").alias("leaf"))
        directory = materialize(sums.select("parent", "bucket", bits.alias("bits")).join(leaf, ["parent", "bucket"], "left"), "shard-directory")
        # keys of the rows go by other names, so each side has its own columns
        placed = rows.alias("r").join(directory.alias("x"), (F.col("r.parent") == F.col("x.parent")) & (F.col("r.bucket") == F.col("x.bucket")))
        done = placed.filter("x.leaf is not null").select(
            "r.doc_id", "r.bytes", F.concat("r.parent", "x.leaf.prefix").alias("shard"), F.col("x.leaf.shard_bytes").alias("shard_bytes"),
            F.col("x.leaf.shard_docs").alias("shard_docs"))
        settled = done if settled is None else settled.union(done)
        if directory.filter("leaf is null").isEmpty():
            break
        rows = materialize(placed.filter("x.leaf is null").select(
            "r.doc_id", "r.bytes", "r.h0", "r.h1", F.concat("r.parent", "x.bits").alias("parent")), "shard-oversized")
    return settled.select("doc_id", "bytes", "shard", F.length("shard").alias("depth"), "shard_bytes", "shard_docs")
