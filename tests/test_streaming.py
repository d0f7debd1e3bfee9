import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchloom import schemas
from matchloom.operators import buckets, jobs
from matchloom.streaming import flows


@pytest.fixture
def shared(spark, tmp_path):
    return str(tmp_path)


def as_stream(spark, folder, *batches):
    """Rows written as one file per batch, replayed one file at a time."""
    for n, df in enumerate(batches):
        df.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return flows.replay(spark, f"{folder}/in", 1)


def test_stream_of_attempts_equals_batch(spark, shared):
    ev = [(j, s, ["started", "failed"][s % 2], f"2024-01-01 00:00:{s:02d}", "t", False, None) for j in range(5) for s in range(2 * j + 1)] + [(9, 0, "started", "2024-01-01", None, None, None), (9, 1, "succeeded", "2024-01-01", None, None, 1), (9, 2, "started", "2024-01-02", None, None, None)]
    df = spark.createDataFrame(ev, "job_id long, seq long, event string, ts string, error string, permanent boolean, posting_id long").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = as_stream(spark, shared, df.filter("seq < 3"), df.filter("seq >= 3"), df.filter("seq < 3"))
    with flows.rocksdb(spark):
        out = flows.drain(flows.job_states(stream), "update")
    last = {}
    for r in out.collect():
        last[r.job_id] = max(last.get(r.job_id, (0, "")), (r.attempts, "" if r.status == "running" else r.status))
    want = {r.job_id: (r.attempts, "" if r.status == "running" else r.status) for r in jobs.fold_lifecycle(df).collect()}
    assert last == want


def stamped(spark, rows):
    return spark.createDataFrame([(h, n, (pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=s)).to_pydatetime()) for h, n, s in rows], "host string, request_id long, ts timestamp")


def test_token_bucket(spark, shared):
    """Requests in any order and over several batches; the last one of another host moves the watermark past them."""
    rows = [("e.com", n, s) for n, s in enumerate([0, 0, 0, 0, 0, 10])]
    stream = as_stream(spark, shared, stamped(spark, [rows[5], rows[2], rows[0]]), stamped(spark, [rows[1], rows[4], rows[3]]), stamped(spark, [("-", -1, 10**6)]))
    with flows.rocksdb(spark):
        out = flows.drain(flows.pace_requests(stream, rate=1.0, burst=3, most_wait=1.5, slot_s=5))
    waits = [(r.wait_s, r.over_limit) for r in out.filter("host = 'e.com'").orderBy("request_id").collect()]
    assert waits[:3] == [(0.0, False)] * 3 and waits[3] == (1.0, False) and waits[4] == (2.0, True) and waits[5] == (0.0, False) and len(waits) == 6


def test_idle_hosts_have_no_state(spark, shared):
    """A host's bucket goes once it is full again and the host idle; the next request starts a new one."""
    batches = [[(f"h{k}", k, k) for k in range(6)], [("x", 100, 5_000)], [("x", 101, 50_000)], [("h0", 102, 60_000), ("x", 103, 60_001)], [("-", -1, 10**6)]]
    query = flows.pace_requests(as_stream(spark, shared, *[stamped(spark, b) for b in batches]), rate=1.0, burst=2, slot_s=10, idle_s=60.0)
    with flows.rocksdb(spark):
        q = query.writeStream.format("parquet").option("checkpointLocation", f"{shared}/log").trigger(availableNow=True).start(f"{shared}/out")
        q.awaitTermination()
    assert {r.request_id for r in spark.read.parquet(f"{shared}/out").filter("host <> '-'").collect()} == {*range(6), 100, 101, 102, 103}
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 6  # what is left of the last hosts


def test_catalog_stream_is_safe_to_replay(spark, shared):
    s = buckets.BucketStore(spark, f"{shared}/store")
    s.create("postings", spark.createDataFrame([], schemas.schema_of("postings")), ["canonical_key"], 4)
    rows = spark.createDataFrame([(1, "a", "https://e.com/a", "T", None, "word " * 60), (1, "b", "https://e.com/b", "T", None, "word " * 70)], "source_id long, external_id string, url string, title string, updated_at timestamp, content string")
    write = flows.catalog_writer(s, lambda: "2024-01-01")
    write(rows, 0)
    first = sorted(map(str, s.read("postings").collect()))
    version = s.version("postings")
    write(rows, 0)  # the same batch once more is known
    assert s.version("postings") == version
    flows.catalog_writer(s, lambda: "2024-01-01", writer="other")(rows, 0)  # from another writer it meets the hash gate
    assert sorted(map(str, s.read("postings").collect())) == first and len(first) == 2
    stream = as_stream(spark, shared, rows.limit(1))
    flows.ingest_catalog(stream, s, lambda: "2024-01-01", f"{shared}/ck", complete=lambda batch: batch.select("source_id").distinct(), writer="stream").awaitTermination(60)
    assert {r.url: r.closed_at is None for r in s.read("postings").collect()} == {"https://e.com/a": True, "https://e.com/b": False}


def test_duplicates_and_sessions(spark, shared):
    df = spark.createDataFrame([("posting", "k", 5, "2024-01-01 00:00:00", "interested"), ("posting", "k", 5, "2024-01-01 00:10:00", "applied"), ("posting", "m", 5, "2024-01-01 02:00:00", "interested")], "kind string, dedupe_key string, user_id long, t string, verdict string").withColumn("ts", F.col("t").cast("timestamp"))
    stream = as_stream(spark, shared, df)
    assert flows.drain(flows.once(stream, "ts", ["kind", "dedupe_key"])).count() == 2
    out = flows.drain(flows.feedback_sessions(flows.replay(spark, f"{shared}/in"), "user_id", "ts", "verdict"), "complete")
    assert sorted((r.n_events, r.n_verdicts, r.applied) for r in out.collect()) == [(1, 1, False), (2, 2, True)]


def test_busy_host_in_slots_and_list(spark, shared):
    """More requests of a host than its list holds: the waits of a plain fold; and a host costs one timer, however many slots wait."""
    rows = [("e.com", n, (n * 7919) % 5000 * 0.4) for n in range(5000)] + [("f.com", 10_000 + n, 20 * n) for n in range(100)]
    stream = as_stream(spark, shared, stamped(spark, rows), stamped(spark, [("-", -1, 10**6)]))
    with flows.rocksdb(spark):
        out = flows.drain(flows.pace_requests(stream, rate=1.0, burst=3, most_wait=1.5, slot_s=10))
    got = {r.request_id: (round(r.wait_s, 6), r.over_limit) for r in out.filter("host <> '-'").collect()}
    for host in ("e.com", "f.com"):
        tokens, at = 3.0, None
        for t, n in sorted((t, n) for h, n, t in rows if h == host):
            tokens, at = min(3.0, tokens + (t - at if at is not None else 0)), t
            wait = 0.0 if tokens >= 1 else 1 - tokens
            assert abs(got[n][0] - wait) < 1e-4 and got[n][1] == (wait > 1.5)
            tokens -= wait <= 1.5
    assert len(got) == 5100


def test_batches_of_several_files(spark):
    """No task reads a whole batch, batches keep their rows and order, and small ones are filled up with empty files."""
    rows = spark.range(1000).select("id", F.when(F.col("id") < 900, 1).otherwise(F.when(F.col("id") < 999, 2).otherwise(3)).alias("batch"))
    stream = flows.in_batches(rows, "batch", file_rows=100)
    seen = {}
    q = stream.writeStream.foreachBatch(lambda df, n: seen.update({n: (df.rdd.getNumPartitions(), sorted(r.id for r in df.collect()))})).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [seen[n][1] for n in sorted(seen)] == [list(range(900)), list(range(900, 999)), [999]]
