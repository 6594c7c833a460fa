import time

from ordina.streaming import progress, sessions


def test_batches_are_reported(spark):
    listener = progress.watch(spark)
    assert sessions.stream_dedup(spark, "/root/testdata/sf0.001").count() > 0
    for _ in range(50):
        if sum(rows for _, _, rows in listener.batches) > 1000:
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert sum(rows for _, _, rows in listener.batches) == 1000 + 1 and not listener.failed
