"""Incremental exact de-duplication (C2): batches against a stored cleaned set that is not shuffled.

The stored set keeps one Bloom filter of 32,768 bits for each partition of the record digests, as a table of bitmaps. A batch is de-duplicated,
then joined with the filters only: a record whose bits are not all set is new. The few others are looked up exactly: their
digests go to the stored files as a semi-join (broadcast while there are at most ``BROADCAST_DIGESTS``), and what comes back is compared column
by column. A false hit costs a lookup, never a record.

A manifest names the folders of the set; it is replaced in one rename after all of a batch is written, so a failed or
repeated batch leaves the set as it was."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forestlens.operators import records as rc
from forestlens.sources.sinks import write_json

BITS = 32_768                # of one bitmap of Spark's bitmap functions
HASHES = 3
BROADCAST_DIGESTS = 1 << 20
_DIGEST, _PART = "record_digest", "filter_part"


def _bit(i: int) -> Column:
    return F.pmod(F.xxhash64(F.col(_DIGEST), F.lit(i)), F.lit(BITS)).cast("long")


def bloom_filters(digests: DataFrame, partitions: int) -> DataFrame:
    """``(filter_part, bits)`` of a frame with ``record_digest``: one bitmap per partition of the digests."""
    bits = digests.select(F.pmod(_DIGEST, F.lit(partitions)).cast("long").alias(_PART),
                          F.explode(F.array(*[_bit(i) for i in range(HASHES)])).alias("bit"))
    return bits.groupBy(_PART).agg(F.bitmap_construct_agg("bit").alias("bits"))


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).groupBy(_PART).agg(F.bitmap_or_agg("bits").alias("bits"))


def maybe_stored(rows: DataFrame, filters: DataFrame, partitions: int) -> DataFrame:
    """``rows`` (with ``record_digest``) and ``hit``: whether all bits of the digest are set."""
    names = [F.col(f"`{c}`") for c in rows.columns]
    probe = rows.withColumns({_PART: F.pmod(_DIGEST, F.lit(partitions)).cast("long")} | {f"_bit{i}": _bit(i) for i in range(HASHES)})
    hit = F.lit(True)
    for i in range(HASHES):
        byte = f"cast(conv(hex(substring(bits, cast(_bit{i} div 8 + 1 AS INT), 1)), 16, 10) AS INT)"
        hit = hit & (F.expr(f"shiftright({byte}, cast(_bit{i} % 8 AS INT)) & 1") == 1)
    return probe.join(filters, _PART, "left").select(*names, F.coalesce(hit, F.lit(False)).alias("hit"))


@dataclass
class CleanedSet:
    """A stored set of distinct records under ``path``."""

    spark: SparkSession
    path: str
    rows_per_filter: int = 4096          # 8 bits a record: about 3 % false hits when a filter is full

    def _manifest(self) -> dict | None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest.json")
        if not target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target):
            return None
        return json.loads(self.spark.read.text(f"{self.path}/manifest.json").first()[0])

    def records(self) -> DataFrame | None:
        """All records of the set, without their digests; None before the first batch."""
        m = self._manifest()
        return None if m is None else self.spark.read.parquet(*m["folders"]).drop(_DIGEST)

    def add(self, batch: DataFrame) -> DataFrame:
        """The batch's records that are not in the set yet, after adding them."""
        m = self._manifest()
        cols = [F.col(f"`{c}`") for c in batch.columns]
        fresh = batch.dropDuplicates().select("*", rc.digest(batch).alias(_DIGEST))
        folder = f"{self.path}/records-{uuid.uuid4().hex[:12]}"
        if m is None:
            fresh.write.parquet(folder)
            added = self.spark.read.parquet(folder)
            partitions = max(1, -(-added.count() // self.rows_per_filter))
            filters = bloom_filters(added, partitions)
            m = {"folders": []}
        else:
            stored = self.spark.read.parquet(*m["folders"])
            probed = f"{self.path}/probed-{uuid.uuid4().hex[:12]}"
            partitions = m["partitions"]
            maybe_stored(fresh, self.spark.read.parquet(m["filters"]), partitions).write.parquet(probed)
            fresh = self.spark.read.parquet(probed)
            hits = fresh.filter("hit").drop("hit")
            digests = hits.select(_DIGEST).distinct()
            found = stored.join(F.broadcast(digests) if hits.count() <= BROADCAST_DIGESTS else digests, _DIGEST, "left_semi")
            a, b = hits.alias("a"), found.alias("b")
            same = [F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in hits.columns]
            new = a.join(b, same, "left_anti").union(fresh.filter("NOT hit").drop("hit"))
            new.write.parquet(folder)
            added = self.spark.read.schema(new.schema).parquet(folder)
            total = stored.count() + added.count()
            if total > 2 * partitions * self.rows_per_filter:      # filters are full: build larger ones
                partitions = -(-total // self.rows_per_filter)
                filters = bloom_filters(stored.select(_DIGEST).union(added.select(_DIGEST)), partitions)
            else:
                filters = merged(self.spark.read.parquet(m["filters"]), bloom_filters(added, partitions))
        where = f"{self.path}/filters-{uuid.uuid4().hex[:12]}"
        filters.write.parquet(where)
        write_json(self.spark, {"folders": [*m["folders"], folder], "filters": where, "partitions": partitions}, f"{self.path}/manifest.json")
        return added.select(*cols)
