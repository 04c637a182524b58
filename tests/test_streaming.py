from quillon.operators import governance as G
from quillon.streaming.governance import replay_stream


def test_stream_replays_like_batch(spark, tmp_path):
    rows = [(p, s, ["suggested", "approved", "rejected", "superseded"][(p * 7 + s * 3) % 4]) for p in range(5) for s in range(6)]
    schema = "proposal long, seq long, state string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = replay_stream(stream).writeStream.format("memory").queryName("replayed").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.sql("SELECT proposal, seq, state, legal FROM replayed").collect()))
    want = sorted((r.proposal, r.seq, r.state, r.legal) for r in G.replay(spark.createDataFrame(rows, schema), "proposal", "seq", "state").collect())
    assert got == want
