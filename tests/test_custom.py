from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from graphloom.operators import custom
from graphloom.streaming import streams


def test_map_reduce(spark):
    rows = spark.range(100)
    mapper = lambda b: pd.DataFrame({"key": b["id"] % 3, "value": b["id"]})
    reducer = lambda g: pd.DataFrame({"key": [g["key"].iloc[0]], "value": [g["value"].sum()]})
    for combine in (False, True):
        got = {r.key: r.value for r in custom.map_reduce(rows, mapper, reducer, "key long, value long", combine).collect()}
        assert got == {k: sum(i for i in range(100) if i % 3 == k) for k in range(3)}
    assert custom.process_batches(rows, lambda b: b + 1, "id long").agg(F.sum("id")).first()[0] == 5050
    tasks = spark.createDataFrame([(0, 10), (0, 20), (5, None)], "started_us long, ended_us long")
    r = custom.pool_statistics(tasks, 2).first()
    assert (r.submitted, r.completed, r.mean_us, r.utilisation) == (3, 2, 15.0, 0.75)


def test_streamed_windows(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [(t + timedelta(minutes=i), "view" if i % 2 else "click", float(i), i % 4) for i in range(30)]
    schema = "ts timestamp, event_type string, value double, user_id long"
    df = spark.createDataFrame(rows, schema)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = streams.windowed(stream, "10 minutes").writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    batch = sorted(map(tuple, streams.windowed(df, "10 minutes").collect()))
    assert sorted(map(tuple, spark.table("w").collect())) == batch and len(batch) == 6
    assert streams.sessions(df, "3 minutes").count() == 30 and streams.sessions(df, "5 minutes").count() == 4
