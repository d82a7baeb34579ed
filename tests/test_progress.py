"""Counters while a stream runs equal the counts after it."""

import time

from pyspark.sql import functions as F

from lotwise.operators import stores as S
from lotwise.sources.captured import captured
from lotwise.streaming.progress import ProgressListener, observed


def test_counts_of_a_running_stream_are_those_after_it(spark, data, tmp_path):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    for part in range(3):
        pages.filter(F.col("page_id") % 3 == part).select(F.lit("s").alias("site"), "page_id", "html").write.mode("append").partitionBy("site", "page_id").text(f"{tmp_path}/pages")
    events = []
    listener = ProgressListener("pages", lambda phase, counts: events.append(("job", phase, counts["done"], counts["characters"])))
    spark.streams.addListener(listener)
    try:
        for _ in range(2):  # the second run finds nothing new
            stream = observed(captured(spark, f"{tmp_path}/pages", streaming=True, fields="name,html", settle="0"), "pages", done=F.count(F.lit(1)), characters=F.sum(F.length("html")))
            q = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
            q.awaitTermination()
        until = time.time() + 20
        while not events and time.time() < until:
            time.sleep(0.2)
        time.sleep(1)
    finally:
        spark.streams.removeListener(listener)
    after = spark.read.parquet(f"{tmp_path}/out").agg(F.count("*").alias("n"), F.sum(F.length("html")).alias("c")).first()
    folded = S.fold_progress(spark.createDataFrame(events, "job string, phase string, done bigint, total bigint"), "job", "phase", "done", "total").first()
    assert (folded.done, folded.total) == (after.n, after.c) and after.n == pages.count()
    assert [e[2] for e in events] == sorted(e[2] for e in events)
