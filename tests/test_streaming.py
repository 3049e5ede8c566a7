"""The window functions on streams give what they give on tables."""

import datetime as dt

from pyspark.sql import functions as F

from quillon.sources import tables
from quillon.streaming import windows

SF = "/root/testdata/sf0.001"


def drained(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_tumbling_stream_equals_table(spark, tmp_path):
    tables.scan(spark, SF, "events").repartition(3).write.parquet(f"{tmp_path}/in")
    stream = windows.read(spark, f"{tmp_path}/in", tables.SCHEMAS["events"], files_per_trigger=1)
    got = drained(windows.tumbling(stream, "ts", "1 day", ["event_type"], n=F.count(F.lit(1))), "tumbling", "complete")
    want = windows.tumbling(tables.scan(spark, SF, "events"), "ts", "1 day", ["event_type"], n=F.count(F.lit(1)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_late_rows_and_repeats(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    for k, rows in enumerate([[(1, at(1)), (2, at(2)), (2, at(2))], [(3, at(120))], [(6, at(121))], [(4, at(3))], [(5, at(300))]]):
        spark.createDataFrame(rows, "id long, ts timestamp_ntz").coalesce(1).write.parquet(f"{tmp_path}/part{k}")
    for k in range(5):
        (tmp_path / "in").mkdir(exist_ok=True)
        next((tmp_path / f"part{k}").glob("*.parquet")).rename(tmp_path / "in" / f"{k}.parquet")
    import os

    for k in range(5):
        os.utime(tmp_path / "in" / f"{k}.parquet", (1_000_000 + k, 1_000_000 + k))
    read = lambda: windows.read(spark, f"{tmp_path}/in", "id long, ts timestamp_ntz", files_per_trigger=1)
    got = drained(windows.tumbling(read(), "ts", "1 hour", late="10 minutes", n=F.count(F.lit(1))), "late")
    assert sorted(map(tuple, got.select("window_start", "n").collect())) == [(at(0), 3), (at(120), 2)]  # row 4 came too late
    once = drained(windows.deduplicated(read(), ["id"], "ts", "10 minutes"), "once")
    assert sorted(r.id for r in once.collect()) == [1, 2, 3, 5, 6]
