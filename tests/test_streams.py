"""The replay source, stateful operators and sinks, in small."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftnet.operators.gate import packet_status
from driftnet.sources.replay import NAME, PacketReplay
from driftnet.streaming.run import drained, to_sinks
from driftnet.streaming.state import assembled_pieces, frontier_queues


def folder_stream(spark, path, rows, schema, parts):
    for i in range(parts):
        spark.createDataFrame(rows[i::parts], schema).coalesce(1).write.mode("append").json(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(path))


def test_replay_batch_and_stream(spark, tmp_path):
    spark.dataSource.register(PacketReplay)
    (tmp_path / "b.txt").write_text("1000000 1.1.1.1 5 2.2.2.2 6881 6431\nbroken line\n2000000 ::1 7 :: 6881\n")
    (tmp_path / "c.txt").write_text("3000000 1.1.1.1 5 2.2.2.2 6881 zz\n4000000 1.1.1.1 5 2.2.2.2 6881 78\n")
    want = [("1.1.1.1", b"d1"), ("1.1.1.1", b"x"), ("::1", b"")]

    def packets(rows):
        return sorted((r["remote_ip"], bytes(r["data"])) for r in rows if r["reject"] is None)

    batch = spark.read.format(NAME).option("path", str(tmp_path)).load().collect()
    assert packets(batch) == want
    assert sorted(r["reject"] for r in batch if r["reject"] is not None) == ["3000000 1.1.1.1 5 2.2.2.2 6881 zz", "broken line"]
    live = spark.readStream.format(NAME).option("path", str(tmp_path)).load()
    q = live.writeStream.format("memory").queryName("packets").start()
    q.processAllAvailable()
    assert packets(spark.table("packets").collect()) == want
    (tmp_path / "a.txt").write_text("5000000 9.9.9.9 5 2.2.2.2 6881 79\n")  # later, with a name that sorts first
    q.processAllAvailable()
    q.stop()
    assert packets(spark.table("packets").collect()) == sorted([*want, ("9.9.9.9", b"y")])


def test_copies_that_come_late(spark, tmp_path):
    """A copy years after its message is no new message, in whatever batch it comes."""
    import datetime as dt

    from driftnet.plans.streams import CATALOGUE

    schema = "delivery_id long, info_hash string, peer_addr string, discovered_at timestamp, received_at timestamp"
    t0 = dt.datetime(2025, 1, 1)
    for i, days in enumerate((3000, 0, 900)):
        rows = [(i, "A" * 40, "10.0.0.1:80", t0, t0 + dt.timedelta(days=days)), (10 + i, f"{i}" * 40, "10.0.0.1:80", t0, t0)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "announces.parquet"))
    got = CATALOGUE.queries["stream_dedupe"](spark, str(tmp_path)).collect()
    assert sorted(r["info_hash"] for r in got) == sorted(["a" * 40, "0" * 40, "1" * 40, "2" * 40])


def test_a_batch_costs_what_it_holds(spark, tmp_path):
    """Copies are found in the state: a batch is a job, and nothing stored is read again."""
    import datetime as dt

    from driftnet.plans.streams import CATALOGUE

    t0 = dt.datetime(1969, 1, 1)
    for i in range(3):
        rows = [(i, "A" * 40, "10.0.0.1:80", t0, t0), (i, f"{i}" * 40, "[::1]:80", t0, t0), (i, "A" * 40, None, t0, t0), (i, "x", "10.0.0.1:80", t0, t0)]
        spark.createDataFrame(rows, "delivery_id long, info_hash string, peer_addr string, discovered_at timestamp, received_at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "announces.parquet"))
    jobs = lambda: spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    began, provider = jobs(), spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    df = CATALOGUE.queries["stream_dedupe"](spark, str(tmp_path))
    assert jobs() - began <= 3 * 2 + 2
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == provider
    assert sorted(r["info_hash"][0] for r in df.collect()) == ["0", "1", "2", "a"]


def test_results_and_rejects(spark, tmp_path):
    s = folder_stream(spark, tmp_path / "in", [("d1",), ("x",), (None,)], "p string", 1)
    got: dict[str, list] = {"ok": [], "bad": []}
    status = packet_status(F.col("p").cast("binary"))
    q = to_sinks(s, status == "ok", lambda d: got["ok"].extend(r["p"] for r in d.collect()), lambda d: got["bad"].extend(r["p"] for r in d.collect()), str(tmp_path / "log"))
    q.awaitTermination()
    assert got["ok"] == ["d1"] and len(got["bad"]) == 2


def test_frontier_over_batches(spark, tmp_path):
    rows = [(4, 0, a, i) for i, a in enumerate("abaca")]
    every = drained(frontier_queues(folder_stream(spark, tmp_path / "in", rows, "family int, shard int, address string, seq long", 1), 2), "update")
    assert [r["address"] for r in every.orderBy("position").collect()] == ["c", "a"]


def test_pieces_over_batches(spark, tmp_path):
    rows = [("k", 1, 2, "b"), ("gap", 1, 2, "x"), ("k", 0, 2, "a")]
    s = folder_stream(spark, tmp_path / "in", rows, "key string, piece int, total int, text string", 3)
    pieces = s.select("key", "piece", "total", F.col("text").cast("binary").alias("data"))
    got = drained(assembled_pieces(pieces, None)).collect()
    assert [(r["key"], bytes(r["data"]), r["pieces"]) for r in got] == [("k", b"ab", 2)]


def test_a_fetch_that_takes_too_long_is_given_up(spark, tmp_path):
    """The first half of a key is forgotten after its timeout; its second half alone completes nothing."""
    import time

    schema = "key string, piece int, total int, text string"

    def add(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))

    add(("slow", 0, 2, "a"), ("quick", 0, 2, "x"))
    s = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    live = assembled_pieces(s.select("key", "piece", "total", F.col("text").cast("binary").alias("data")), 6000)
    q = live.writeStream.format("memory").queryName("fetched").option("checkpointLocation", str(tmp_path / "log")).trigger(processingTime="200 milliseconds").start()
    read = lambda: sum(p["numInputRows"] for p in q.recentProgress)

    def until(rows):
        for _ in range(100):  # such a query is never done: a timeout may always fire
            if read() >= rows:
                return
            time.sleep(0.2)
        raise AssertionError(read())

    try:
        until(2)
        add(("quick", 1, 2, "y"))
        until(3)
        time.sleep(9)
        add(("slow", 1, 2, "b"))
        until(4)
        time.sleep(1)
        assert [(r["key"], bytes(r["data"])) for r in spark.table("fetched").collect()] == [("quick", b"xy")]
    finally:
        q.stop()
