from fixtures import frame, rows

from keyloom import Schema
from keyloom.streaming import feed


def test_a_stream_feeds_a_dataset(spark, tmp_path):
    source, out, mark = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"
    kinds = "k long, v string, at long"
    frame(spark, kinds, [(1, "a", 1), (2, "b", 1)]).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(kinds).parquet(source)
    feed.start(stream, out, mark, once=True).awaitTermination()
    frame(spark, kinds, [(1, "c", 2), (3, "d", 1)]).coalesce(1).write.mode("append").parquet(source)
    feed.start(stream, out, mark, once=True).awaitTermination()
    s = Schema(spark)
    d = feed.register(s, out, ["k"], "at")
    t = s.get(k=d["k"]).infer(["k"], d["v"])
    assert rows(t.to_df()) == [(1, "c"), (2, "b"), (3, "d")]
