import zlib

from pyspark.sql import functions as F

from sitemill.llm import shards as S
from sitemill.workspace import new_path
from tests.llm.conftest import ODD_TEXTS, frame


def check(rows, docs, shards):
    expected = sorted(((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in docs), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=str) == expected
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.law == "key" and 0 <= r.shard < shards and r.grown_shard in (r.shard, shards)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    places = {}
    assert all(places.setdefault(r.doc_id, r.shard) == r.shard for r in rows)


def test_odd_documents(spark, odd, none):
    check(S.report(odd, new_path(spark, "t"), 4).collect(), ODD_TEXTS, 4)
    S.write(odd, path := new_path(spark, "t"), 4)
    kept = S.read(spark, path, odd.select(F.struct("*").alias("row")).schema["row"].dataType.simpleString())
    assert sorted(map(str, kept.select("row.*").collect())) == sorted(map(str, odd.collect()))
    assert S.report(none, new_path(spark, "t"), 4).count() == 0


def test_small_buckets_and_order(spark):
    docs = [(i, f"text {i} " * 20) for i in range(400)]
    S.write(frame(spark, docs), path := new_path(spark, "t"), 3, bucket_bytes=4000)
    rows = spark.read.parquet(path).select("shard", "slot", "row.doc_id").orderBy("shard", "slot").collect()
    for shard in range(3):
        ids = [r.doc_id for r in rows if r.shard == shard]
        assert [r.slot for r in rows if r.shard == shard] == list(range(len(ids))) and ids != sorted(ids) and len(ids) > 90


def test_shuffle_is_uniform(spark):
    docs = spark.range(3).crossJoin(spark.range(600).withColumnRenamed("id", "g"))
    mixed = docs.groupBy("g").agg(F.array_sort(F.collect_list("id")).alias("x")).select(F.shuffle("x", 5).alias("x"))
    counts = {str(r.x): r["count"] for r in mixed.groupBy("x").count().collect()}
    assert len(counts) == 6 and min(counts.values()) > 60
