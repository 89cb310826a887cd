"""Small ranges share tasks; the records are the same."""

import json

from spanledger.sources import json_array as J


def test_many_small_ranges_take_few_tasks(spark, tmp_path):
    for d in range(3):
        (tmp_path / f"{d}.json").write_bytes(json.dumps({"R": [{"id": i, "t": "x{[" * (i % 5)} for i in range(400)]}).encode("utf-16"))
    got = J.json_array(spark, str(tmp_path), "R", range_bytes=256)
    assert got.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    rows = got.collect()
    assert sorted((r["path"][-6:], r["pos"], json.loads(r["text"])["id"]) for r in rows) == [(f"{d}.json", i, i) for d in range(3) for i in range(400)]


def test_large_documents_take_more_tasks(spark):
    cores = spark.sparkContext.defaultParallelism
    assert J._tasks(spark, 1, 10) == 1 and J._tasks(spark, 10_000, 1 << 20) == 2 * cores
    assert J._tasks(spark, 10 ** 6, J.RANGE_BYTES * 500) == 500 and J._tasks(spark, 10 ** 7, J.RANGE_BYTES * 10 ** 7) == 100_000
