"""The write queue as a stream: any order, repeats, and a restart from the checkpoint."""

from corpusloom.streaming import feed


def test_queue_streamed_in_any_order(spark, tmp_path):
    items = [(f"q{q}", s, 100 * q + s, f"p{s % 3}", "network" if (q, s) == (1, 5) else "write", s % 4 != 0) for q in (1, 2) for s in range(1, 9)]
    schema = "queue string, seq long, id long, path string, kind string, ok boolean"

    def send(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = feed.replay_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        with feed.rocks(spark):
            run = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
            run.awaitTermination()
        return spark.read.parquet(str(tmp_path / "out"))

    # the first of each queue is missing: nothing of it runs; then a new query goes on from the checkpoint
    first = send([x for x in reversed(items) if x[1] != 1 or x[0] == "q2"] + [items[3], (None, 1, 1, "p", "write", True), ("q2", None, 1, "p", "write", True)])
    assert {r.queue for r in first.collect()} == {"q2"}
    ran = send([items[0], items[1], items[-1]])
    got = sorted((r.queue, r.seq, r.outcome) for r in ran.collect())
    assert got == sorted((q, s, "waiting" if q == "q1" and s >= 5 else "applied" if ok else "dropped") for q, s, _, _, _, ok in items)
    batch = feed.replay(spark.createDataFrame(items, schema), queue_of="queue")
    assert sorted(map(tuple, feed.outcomes(ran).collect())) == sorted(map(tuple, batch.select("path", "applied", "dropped", "waiting", "last_id").collect()))
