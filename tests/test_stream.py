from lanternq.streaming import crawl_stream as S


def test_steps():
    t = S.step(None, "enqueue", None, None, 2)
    assert t == ("pending", 0, None, None) and S.step(None, "claim", None, None, 2) is None
    t = S.step(t, "claim", None, None, 2)
    t = S.step(t, "fail", "e", "now", 2)
    assert t == ("pending", 1, "e", None)
    t = S.step(S.step(t, "claim", None, None, 2), "fail", "e", "now", 2)
    assert t == ("failed", 2, "e", "now")


def test_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [("a", "enqueue", None, None, 1), ("a", "claim", None, None, 2), ("a", "complete", None, "now", 3), ("b", "enqueue", None, None, 4), ("b", "complete", None, "now", 5)]
    spark.createDataFrame(rows, S.EVENTS).write.parquet(str(tmp_path / "in"))
    stream = S.transitions(spark.readStream.schema(S.EVENTS).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("queue_states").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.url: r.state for r in S.latest(spark.table("queue_states")).collect()}
    assert got == {"a": "done", "b": "pending"}
