import glob
import os
import shutil
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewell.queries.stateful import bucketed
from tracewell.sources.audit import Audit
from tracewell.streaming import folds
from tracewell.streaming.fold import folded, folded_stream
from tracewell.streaming.folds import EVENT_FOLDS, NODE_FOLDS

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, map(tuple, df.collect())))


@pytest.mark.parametrize("name", [*EVENT_FOLDS, *NODE_FOLDS])
def test_stream_gives_the_rows_of_batch_whatever_the_arrival(spark, name):
    a = Audit.of(spark, SF)
    fold = EVENT_FOLDS.get(name) or NODE_FOLDS[name]
    events = (bucketed(a.placed) if name in EVENT_FOLDS else a.touch_placed).where("host = 'h1' AND stream_pos < 60").withColumn("ts", F.col("ts").cast("timestamp"))
    if "z" in fold.inputs:
        events = events.withColumn("z", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.hash("event_id", i) / 2.0**31))
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        pdf = events.toPandas().sample(frac=1, random_state=3)  # arrival in no order, over two files; the third moves the watermark on
        last = pdf.iloc[:1].copy()
        last["ts"] = pd.Timestamp("2200-01-01")
        last["host"] = "end"
        os.makedirs(f"{base}/in")
        for i, part in enumerate((pdf.iloc[:30], pdf.iloc[30:], last)):
            spark.createDataFrame(part, events.schema).coalesce(1).write.parquet(f"{base}/{i}")
            shutil.move(glob.glob(f"{base}/{i}/part-*.parquet")[0], f"{base}/in/{i}.parquet")
            os.utime(f"{base}/in/{i}.parquet", (1000 + i, 1000 + i))
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in").withWatermark("ts", "20000 days")
        query = folded_stream(stream, fold).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        want = rows(folded(events, fold))
        assert want and rows(spark.read.parquet(f"{base}/out")) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_states_are_bounded_and_alerted_nodes_kept(spark, monkeypatch):
    flow = Audit.of(spark, SF).placed.where("host = 'h1'").orderBy("stream_pos").collect()
    monkeypatch.setattr(folds, "P", folds.Parameters(most_states=20, protected=50, alert=60000.0))
    for protect in (False, True):
        step, states, touched, until = folds._bounded(protect), {}, {}, {}
        for e in flow:
            host, pos, n, gone, spared, *_ = step(states, e)
            for node, kind in ((e.info_src, e.src_kind), (e.info_dst, e.dst_kind)):
                touched[node] = (folds.EVICTED_FIRST[kind], pos)
                if e.score >= 60000.0:
                    until[node] = pos + 50
            may_go = [x for x in touched if x not in (e.info_src, e.info_dst) and not (protect and until.get(x, -1) >= pos)]
            if len(touched) > 20 and may_go:
                want = min(may_go, key=lambda x: touched[x][0])
                first = [x for x in may_go if touched[x][0] == touched[want][0]]
                # equal times are the two ends of one event
                assert touched[gone] == min(touched[x] for x in first)
                del touched[gone]
            else:
                assert gone is None
            assert n == len(touched)


def test_order_of_partitions_does_not_matter(spark):
    events = Audit.of(spark, SF).placed
    fold = EVENT_FOLDS["risk_propagation"]
    assert rows(folded(events.repartition(7, "event_id"), fold)) == rows(folded(events.coalesce(1), fold))
