"""The stream's state: gone after a success and after a lock, results as in batch."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from msgscope.streaming.lockout import lockout_batch, lockout_stream

SCHEMA = "event_id long, identifier long, ts timestamp, success boolean"


def test_state_ends(spark, tmp_path):
    start = datetime(2026, 1, 1)
    at = lambda s: start + timedelta(seconds=s)
    files = [
        # 1 is locked, 2 clears, 3 and 4 keep one open failure, 5 has none
        [(1, 0, False), (1, 1, False), (1, 2, False), (2, 3, False), (2, 4, True), (3, 5, False), (4, 6, False), (5, 7, True)],
        [(1, 20, False), (4, 21, True), (5, 22, False), (5, 23, False), (5, 24, False)],
        [(1, 40, False), (3, 41, False), (6, 400, True)],
        [(1, 500, True), (7, 501, False)],
        [(6, 900, True)],
    ]
    rows, n = [], 0
    for i, f in enumerate(files):
        part = [(n + j, who, at(s), ok) for j, (who, s, ok) in enumerate(f)]
        n += len(part)
        rows += part
        # one file after the other: the source takes them by time of writing
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = (
        lockout_stream(stream, "10 seconds").writeStream.format("parquet").outputMode("append")
        .option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ckpt").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    want = sorted(map(tuple, lockout_batch(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == want and len(got) == n
    assert {r[2] for r in got} == {"ok", "failed", "locked"}
    # seven identifiers were seen; only 3 (two failures) and 7 (one) are open at the end
    assert max(kept) >= 3 and kept[-1] == 2, kept
    state = spark.read.format("statestore").load(f"{tmp_path}/ckpt").select(F.col("key.identifier").alias("i")).collect()
    assert sorted(r["i"] for r in state) == [3, 7]
