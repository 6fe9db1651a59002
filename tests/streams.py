"""Run a table as a stream: its rows in no order over two files, and a third that moves the watermark beyond them."""

import glob
import os
import shutil
import tempfile

import pandas as pd


def streamed(spark, events, start, key="host"):
    """What ``start`` (stream -> stream of rows) writes, as a table. Events have ts; the third file's key is of its own."""
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        pdf = events.toPandas().sample(frac=1, random_state=3)
        last = pdf.iloc[:1].copy()
        last["ts"], last[key] = pd.Timestamp("2200-01-01"), "end"
        os.makedirs(f"{base}/in")
        half = len(pdf) // 2
        for i, part in enumerate((pdf.iloc[:half], pdf.iloc[half:], last)):
            spark.createDataFrame(part, events.schema).coalesce(1).write.parquet(f"{base}/{i}")
            shutil.move(glob.glob(f"{base}/{i}/part-*.parquet")[0], f"{base}/in/{i}.parquet")
            os.utime(f"{base}/in/{i}.parquet", (1000 + i, 1000 + i))
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in").withWatermark("ts", "20000 days")
        query = start(stream).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(200)
        assert query.exception() is None
        return spark.read.parquet(f"{base}/out")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
