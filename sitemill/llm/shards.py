"""Sharding by a two-pass external shuffle, with DataFrame functions only.

Pass 1 scatters records into buckets that fit into memory: the shard follows from doc_id and the number of
shards alone (the highest of one seeded hash per shard, so one more shard takes records only into itself),
the bucket inside the shard from a seeded hash of the record.  Pass 2 brings each bucket to one task, puts
it into random order with Spark's ``shuffle``, which is a Fisher-Yates shuffle, and writes it.  A bucket's
first slot is the number of records in the shard's earlier buckets, so slots run without gaps from 0.

The law that holds is ``key``; sizes and counts of shards are near equal but not exactly so.

Defined results: a null text has no bytes and crc32 0; a null doc_id is a key like any other.  Records that
repeat both doc_id and text share a bucket.  The order inside a bucket follows from the seed and the
partitioning of the session.  Written files hold each record as one struct, so no column name can clash.
An empty table gives no files and an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHARDS, SEED = 40, 20240619
#: Bytes of text of one bucket, about.
BUCKET_BYTES = 4 << 20


def size_of(text: str | Column = "text") -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def key_shard(key: str | Column, shards: int, seed: int = SEED) -> Column:
    """The shard with the highest hash for this key."""
    key = F.col(key) if isinstance(key, str) else key
    draws = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.xxhash64(F.lit(seed), s, key).alias("h"), s.alias("s"))
    )
    return F.array_max(draws)["s"]


def scattered(docs: DataFrame, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """``row, shard, bucket``: every record with the place that pass 1 sends it to."""
    total = docs.agg(F.sum(size_of()).alias("b")).first()["b"] or 0
    buckets = max(1, -(-total // (shards * bucket_bytes)))
    return docs.select(
        F.struct("*").alias("row"),
        key_shard("doc_id", shards, seed).alias("shard"),
        F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "text"), F.lit(buckets)).alias("bucket"),
    )


def write(docs: DataFrame, path: str, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> None:
    """Write ``row, slot`` in folders ``shard=0`` and so on, in slot order within each file."""
    placed = scattered(docs, shards, bucket_bytes, seed)
    sizes = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = placed.repartition(n, "shard", "bucket").groupBy("shard", "bucket").agg(F.collect_list("row").alias("rows"))
    mixed = together.join(offsets.hint("shuffle_hash"), ["shard", "bucket"])
    slots = mixed.select("shard", "before", F.posexplode(F.shuffle("rows", seed)).alias("at", "row"))
    final = slots.select("row", (F.col("before") + F.col("at")).cast("long").alias("slot"), "shard")
    final.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def read(spark: SparkSession, path: str, row_type: str) -> DataFrame:
    """``row, slot, shard`` of all written records."""
    return spark.read.schema(f"row {row_type}, slot long, shard int").parquet(path)


def report(docs: DataFrame, path: str, shards: int = SHARDS) -> DataFrame:
    """Write the shards and read them back: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``."""
    source = docs.select("doc_id", "text")
    write(source, path, shards)
    row_type = source.select(F.struct("*").alias("row")).schema["row"].dataType.simpleString()
    found = read(docs.sparkSession, path, row_type)
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        size_of("row.text").alias("size"),
        F.crc32(F.coalesce("row.text", F.lit(""))).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        key_shard(F.col("row.doc_id"), shards + 1).alias("grown_shard"),
    )
