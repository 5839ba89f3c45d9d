import datetime
import tempfile

from sparkloom.streaming import jobs

SCHEMA = "ts timestamp, user string, n int, text string"


def stream_of(spark, batches):
    folder = tempfile.mkdtemp(prefix="spark-")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{i}")
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(folder)


def at(minute):
    return datetime.datetime(2024, 1, 1, 0, minute)


def test_windows_and_late_rows(spark):
    rows = [(at(0), "a", 1, ""), (at(4), "a", 2, ""), (at(6), "b", 3, ""), (at(59), "b", 4, "")]
    out = tempfile.mkdtemp(prefix="spark-") + "/out"
    jobs.run_once(jobs.windowed(stream_of(spark, [rows]), "ts", ["user"], "5 minutes", "10 minutes"), out, "complete")
    got = {(r.window_start.minute, r.user, r.n) for r in spark.read.parquet(out).collect()}
    assert got == {(0, "a", 2), (5, "b", 1), (55, "b", 1)}


def test_sessions(spark):
    rows = [(at(m), "a", m, "") for m in (0, 2, 4, 20, 21, 50)]
    out = tempfile.mkdtemp(prefix="spark-") + "/out"
    jobs.run_once(jobs.sessions(stream_of(spark, [rows]), "ts", ["user"], "5 minutes", "1 minute"), out)
    assert {(r.begin.minute, r.end.minute, r.n) for r in spark.read.parquet(out).collect()} >= {(0, 9, 3), (20, 26, 2)}


def test_messages(spark):
    rows = [(at(0), "a", 2, "lo;wor"), (at(0), "a", 1, "hel"), (at(0), "b", 1, "no end"), (at(1), "a", 3, "ld;rest")]
    out = tempfile.mkdtemp(prefix="spark-") + "/out"
    jobs.run_once(jobs.messages(stream_of(spark, [rows]), {"user": "string"}, "n", "text", ";"), out)
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [("a", "hello;", True), ("a", "world;", True)]


def test_nothing_of_a_long_message_is_lost(spark):
    rows = [(at(0), "a", i, "x" * 30) for i in range(4)] + [(at(0), "a", 9, "en")]
    out = tempfile.mkdtemp(prefix="spark-") + "/out"
    stream = stream_of(spark, [rows, [(at(1), "a", 10, "d.next")]])
    jobs.run_once(jobs.messages(stream, {"user": "string"}, "n", "text", "end.", longest=50), out)
    got = spark.read.parquet(out).collect()
    assert "".join(r.message for r in sorted(got, key=lambda r: r.complete)) == "x" * 120 + "end." and [r.complete for r in sorted(got, key=lambda r: r.complete)] == [False, True]


def test_a_message_of_any_length_over_two_files(spark):
    rows = [(at(0), "a", 1, "x" * 1_500_000), (at(0), "a", 2, "y" * 1_400_000)]
    out = tempfile.mkdtemp(prefix="spark-") + "/out"
    stream = stream_of(spark, [rows, [(at(1), "a", 3, "z" * 100_000 + ";")]])
    jobs.run_once(jobs.messages(stream, {"user": "string"}, "n", "text", ";", longest=2**31 - 1), out)
    assert [(len(r.message), r.complete) for r in spark.read.parquet(out).collect()] == [(3_000_001, True)]


def test_a_batch_that_is_run_again_doubles_no_row(spark):
    """The log of the last batch is taken away, as if the query had failed before it was written."""
    import os
    import shutil

    base = tempfile.mkdtemp(prefix="spark-")
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    for k in range(3):
        spark.createDataFrame([(at(k), "a", k, "")], SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")
    jobs.run_once(stream().select("n"), f"{base}/out", checkpoint=f"{base}/state")
    last = max(int(x) for x in os.listdir(f"{base}/state/commits") if x.isdigit())
    os.remove(f"{base}/state/commits/{last}")
    for crc in (f"{base}/state/commits/.{last}.crc",):
        if os.path.exists(crc):
            os.remove(crc)
    jobs.run_once(stream().select("n"), f"{base}/out", checkpoint=f"{base}/state")
    assert sorted(r.n for r in spark.read.parquet(f"{base}/out").collect()) == [0, 1, 2]
    shutil.rmtree(base)


def test_sessions_closed_by_timers_over_a_restart(spark):
    """Rows out of order, one that joins two sessions, and a query that is stopped between batches and goes on from its checkpoint."""
    import os

    base = tempfile.mkdtemp(prefix="spark-")
    batches = [[(0, "a"), (3, "a"), (20, "a"), (1, "b")], [(24, "a"), (22, "b"), (50, "c")], [(52, "c"), (58, "c")], [(59, "zz")]]

    def run(k):
        spark.createDataFrame([(at(m), u, m, "") for m, u in batches[k]], SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        with jobs.timers(spark):
            jobs.run_once(jobs.closed_when_idle(stream, "ts", {"user": "string"}, 300, "10 minutes"), f"{base}/out", checkpoint=f"{base}/state")

    def found():
        return sorted((r.user, r.begin.minute, r.end.minute, r.n) for r in spark.read.parquet(f"{base}/out").collect())

    run(0)
    assert found() == [("a", 0, 3, 2), ("b", 1, 1, 1)][: len(found())]
    for k in (1, 2, 3):
        run(k)
    assert found() == [("a", 0, 3, 2), ("a", 20, 24, 2), ("b", 1, 1, 1), ("b", 22, 22, 1)] and os.path.isdir(f"{base}/state")
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_a_key_has_one_timer_however_many_sessions():
    """The first session's end is waited for; when time has passed several ends they are given out at once."""
    from types import SimpleNamespace

    from pyspark.sql import Row

    held, timers = [], set()
    state = SimpleNamespace(get=lambda: iter(list(held)), put=lambda x: held.__setitem__(slice(None), x), clear=held.clear)
    idle = jobs._Idle("t", ["user"], 10_000_000)
    idle.init(SimpleNamespace(getListState=lambda *_: state, registerTimer=timers.add, deleteTimer=timers.discard))
    second = 1_000_000
    list(idle.handleInputRows(("a",), iter([Row(t=t * second) for t in (100, 0, 50, 55, 200)]), None))
    assert len(held) == 4 and timers == {10_001}
    list(idle.handleInputRows(("a",), iter([Row(t=5 * second)]), None))
    assert timers == {15_001}
    timers.clear()
    done = list(idle.handleExpiredTimer(("a",), SimpleNamespace(getCurrentWatermarkInMs=lambda: 120_000), SimpleNamespace(getExpiryTimeInMs=lambda: 15_001)))
    assert [(r.user, r.begin // second, r["last"] // second, r.n) for r in done] == [("a", 0, 5, 2), ("a", 50, 55, 2), ("a", 100, 100, 1)]
    assert held == [(200 * second, 200 * second, 1)] and timers == {210_001}
