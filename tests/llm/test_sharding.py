import zlib

import pytest
from helpers import AWKWARD, documents
from pyspark.sql import functions as F

from entitynet.llm import sharding


@pytest.mark.parametrize("rows", [1, 2, 3, 5, 64, 65, 1000])
def test_permutation_and_its_inverse(spark, rows):
    got = spark.range(rows).select("id", sharding.permute(F.col("id"), rows, "k").alias("p")).select(
        "id", "p", sharding.permute(F.col("p"), rows, "k", inverse=True).alias("back")).collect()
    assert sorted(r.p for r in got) == list(range(rows)) and all(r.back == r.id for r in got)


def test_another_key_is_another_order(spark):
    got = spark.range(500).select(*[sharding.permute(F.col("id"), 500, k).alias(k) for k in "ab"]).collect()
    assert sum(r.a == r.b for r in got) < 20


def test_large_domains_stay_inside(spark):
    rows = 10**13 + 7
    got = spark.range(2000).select((F.col("id") * 5_000_000_003).alias("n")).select("n", sharding.permute(F.col("n"), rows, "k").alias("p")).collect()
    assert all(0 <= r.p < rows for r in got) and len({r.p for r in got}) == 2000


def test_assignment_is_even_gapless_and_computable(spark):
    texts = [*AWKWARD, *[f"text {i % 7}" for i in range(90)]]
    docs = documents(spark, [(i, t) for i, t in enumerate(texts)])
    rows = sharding.assign(docs, 8).orderBy("doc_id").collect()
    assert [r.size for r in rows] == [len((t or "").encode()) + 1 for t in texts]
    assert [r.text_crc32 for r in rows] == [zlib.crc32((t or "").encode()) for t in texts]
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.assign(docs.repartition(5), 8).orderBy("doc_id").collect()
    assert again == rows
    back = spark.createDataFrame([(r.shard, r.slot, r.doc_id) for r in rows], "shard bigint, slot bigint, row bigint")
    assert back.where(sharding.row_at(F.col("shard"), F.col("slot"), len(rows), 8) != F.col("row")).count() == 0


def test_repeated_and_null_ids_and_empty(spark):
    docs = documents(spark, [(1, "a"), (1, "a"), (None, "b"), (None, None)])
    assert sorted((r.shard, r.slot) for r in sharding.assign(docs, 2).collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert sharding.assign(docs.limit(0)).count() == 0
