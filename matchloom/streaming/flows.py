"""Streams: catalog ingest, duplicates, counters, pacing, job state, depths, feedback sessions.

Every flow is a function from a streaming frame to a streaming frame (or, for
the catalog, a ``foreachBatch`` writer).  All are safe to replay: keys decide,
not arrival.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from matchloom.functions.classify import RETRY_LIMIT, RETRY_SECONDS
from matchloom.operators import catalog as cat
from matchloom.operators.buckets import BucketStore
from matchloom.operators.shared import shared_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB while the block runs."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def replay(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Files of a Parquet table as a stream."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return reader.parquet(path)


#: Rows of a file of :func:`in_batches`, about.
FILE_ROWS = 250_000


def in_batches(rows: DataFrame, batch: str, file_rows: int = FILE_ROWS) -> DataFrame:
    """``rows`` as a stream of one micro-batch for each value of the column ``batch``, in their order.

    Written to the shared folder, the same number of files for each: as many as
    the largest batch needs at ``file_rows`` rows a file, so no task reads a
    whole batch.  Batches that fill fewer files get empty ones.
    """
    spark = rows.sparkSession
    folder = shared_folder(spark)
    sizes = {r[0]: r[1] for r in rows.groupBy(batch).count().collect()}  # as many as batches are wanted
    files = max(1, -(-max(sizes.values(), default=0) // file_rows))
    schema, number = rows.drop(batch).schema, 0
    for n in sorted(sizes):
        number += files
        mine = rows.filter(F.col(batch) == n).drop(batch)
        (mine.coalesce(1) if files == 1 else mine.repartition(files)).write.mode("append").parquet(folder)
        while len(spark.read.schema(schema).parquet(folder).inputFiles()) < number:
            spark.createDataFrame([], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and return its result as a table in the shared folder.

    In update and complete mode a later batch replaces the rows of an earlier one.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark)
    schema = stream.schema
    if mode == "append":
        q = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/log").outputMode("append").trigger(availableNow=True).start(f"{folder}/out")
    else:
        q = stream.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")).option("checkpointLocation", f"{folder}/log").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.schema(schema)
    if mode == "complete":
        last = q.lastProgress["batchId"] if q.lastProgress else 0
        return out.parquet(f"{folder}/out/batch={last}")
    return out.parquet(f"{folder}/out") if mode == "append" else out.option("recursiveFileLookup", True).parquet(f"{folder}/out")


# --- catalog ------------------------------------------------------------------------


def catalog_writer(store: BucketStore, now: Callable[[], object], complete: Callable[[DataFrame], DataFrame] | None = None, writer: str = "crawl") -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: enumerated rows (source_id, url, ...) are decided, merged and, for wholly read sources, closed.

    The catalog ``postings`` is bucketed by ``canonical_key``; only buckets
    with keys of the batch, or with postings that it closes, are written.  The
    batch's rows get their keys once and are written before they are used.  A
    batch that is delivered again changes nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        work = f"{store.root}/postings.work/{uuid.uuid4().hex}"

        def written(rows: DataFrame, name: str) -> DataFrame:
            rows.write.parquet(f"{work}/{name}")
            return store.spark.read.parquet(f"{work}/{name}")

        found = written(cat.keyed(batch), "found")
        at = F.lit(now()).cast("timestamp")
        gone = found.select("canonical_key").limit(0)
        if complete is not None:
            done = written(complete(batch).select("source_id").distinct(), "done")
            open_ = store.read("postings").filter("closed_at IS NULL").select("canonical_key", "source_id")
            gone = open_.join(done.hint("merge"), "source_id", "left_semi").join(found.select("canonical_key").hint("merge"), "canonical_key", "left_anti").select("canonical_key")
        gone = written(gone, "gone")

        def merge(current: DataFrame) -> DataFrame:
            merged = cat.merge_crawl(current, cat.crawl_actions(found, current), at)
            closing = gone.withColumn("_gone", F.lit(True)).hint("merge")
            shut = F.when(F.col("closed_at").isNull() & F.col("_gone"), at).otherwise(F.col("closed_at"))
            return merged.join(closing, "canonical_key", "left").withColumn("closed_at", shut).drop("_gone")

        store.update("postings", found.select("canonical_key").unionByName(gone), merge, writer, batch_id)
        store.remove(work)

    return write


def ingest_catalog(stream: DataFrame, store: BucketStore, now: Callable[[], object], checkpoint: str, complete: Callable[[DataFrame], DataFrame] | None = None, writer: str = "crawl"):
    """Start the continuous ingest; returns the query."""
    return stream.writeStream.foreachBatch(catalog_writer(store, now, complete, writer)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# --- duplicates and counters ----------------------------------------------------------


def once(stream: DataFrame, ts: str, keys: list[str], within: str = "1 hour") -> DataFrame:
    """Redelivered work passes once within the delay."""
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def status_counters(stream: DataFrame, ts: str, status: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    w = stream.withWatermark(ts, late).groupBy(F.window(ts, window), status).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("window_start"), status, "n")


def depth_series(stream: DataFrame, ts: str, queue: str, depth: str, window: str = "1 hour", late: str = "10 minutes", order: str | None = None) -> DataFrame:
    """Largest and last depth per queue and window, and when the last was sampled (``order``, by default ``ts``); samples later than the watermark are dropped."""
    at = order or ts
    w = stream.withWatermark(ts, late).groupBy(F.window(ts, window), queue).agg(F.max(depth).alias("peak"), F.max_by(depth, at).alias("last"), F.max(at).alias("last_at"))
    return w.select(F.col("window.start").alias("window_start"), queue, "peak", "last", "last_at")


def feedback_sessions(stream: DataFrame, user: str, ts: str, verdict: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a user's feedback: events, verdicts used, whether it ended in an application."""
    w = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), user).agg(F.count("*").alias("n_events"), F.collect_set(verdict).alias("v"), F.max_by(verdict, ts).alias("last_verdict"))
    return w.select(user, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n_events", F.size("v").alias("n_verdicts"), (F.col("last_verdict") == "applied").alias("applied"))


# --- stateful --------------------------------------------------------------------------

PACED = "host string, request_id long, ts_us long, wait_s double, over_limit boolean"
#: Waiting requests of a host that lie in one list; more are dealt to slots.
FEW = 4096


class TokenBucket(StatefulProcessor):
    """Tokens of one host: refilled at ``rate`` a second up to ``burst``; a request without a token waits for one.

    Requests wait until the watermark has passed their slot of ``slot_s``
    seconds of event time, and are then served in order of time.  Up to
    :data:`FEW` of a host wait in one list, so that a host costs a few calls to
    its state in a batch, not a few for every slot; beyond, each slot has an
    entry, and no more than the list and one slot of one host are in memory.
    A host has one timer: the end of its first slot that waits or, if none
    does, when its bucket is full again after ``idle_s`` seconds.  Then it has
    no state.
    """

    def __init__(self, rate: float, burst: int, most_wait: float, slot_s: int, idle_s: float) -> None:
        self.rate, self.burst, self.most_wait, self.slot = rate, burst, most_wait, 1_000_000 * slot_s
        self.idle = int(1000 * max(idle_s, burst / rate))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # ``first`` is the lowest slot that waits; ``few`` and ``dealt`` count the entries of the list and of the slots; ``timer`` is set for then.
        self.state = handle.getValueState("bucket", "tokens double, at double, idle_from long, first long, few long, dealt long, timer long")
        self.few = handle.getListState("few", "id long, us long")
        self.slots = handle.getMapState("slots", "slot long", "ids array<long>, us array<long>")

    def _deal(self, rows: list[tuple[int, int]]) -> int:
        """Put requests into their slots; returns how many slots are new."""
        by_slot: dict[int, list[tuple[int, int]]] = {}
        for row in rows:
            by_slot.setdefault(row[1] // self.slot, []).append(row)
        new = 0
        for slot, part in by_slot.items():
            known = self.slots.containsKey((slot,))
            ids, us = self.slots.getValue((slot,)) if known else ([], [])
            self.slots.updateValue((slot,), ([*ids, *[i for i, _ in part]], [*us, *[t for _, t in part]]))
            new += not known
        return new

    def _set_timer(self, old: int | None, due: int) -> int:
        if old != due:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(due)
        return due

    def _slot_end(self, slot: int) -> int:
        return (slot + 1) * self.slot // 1000

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        tokens, at, idle_from, first, few, dealt, timer = self.state.get() or (float(self.burst), None, 0, None, 0, 0, None)
        held: list[tuple[int, int]] = []
        for r in rows:
            held.append((r.request_id, r.ts_us))
            slot = r.ts_us // self.slot
            first = slot if first is None else min(first, slot)
            if len(held) == FEW:
                dealt += self._deal(held)
                held = []
        if few + len(held) > FEW:
            dealt += self._deal([*held, *((r[0], r[1]) for r in self.few.get())])
            self.few.clear()
            few = 0
        elif held:
            self.few.appendList(held)
            few += len(held)
        self.state.update((tokens, at, idle_from, first, few, dealt, self._set_timer(timer, self._slot_end(first))))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state, due = self.state.get(), expiredTimerInfo.getExpiryTimeInMs()
        if state is None or state[6] != due:
            return
        tokens, at, idle_from, first, few, dealt, _ = state
        if first is None:
            self.state.clear()  # idle since ``idle_from``
            return
        passed = timerValues.getCurrentWatermarkInMs()
        waiting: dict[int, list[tuple[int, int]]] = {}
        if few:
            for i, us in self.few.get():
                waiting.setdefault(us // self.slot, []).append((us, i))
        entries = sorted(k[0] for k in self.slots.keys()) if dealt else []
        served = [n for n in sorted({*waiting, *entries}) if self._slot_end(n) <= passed]
        stored = set(entries)
        for slot in served:
            order = waiting.pop(slot, [])
            if slot in stored:
                order += zip(*reversed(self.slots.getValue((slot,))))
                self.slots.removeKey((slot,))
            for us, i in sorted(order):
                t = us / 1e6
                tokens = min(float(self.burst), tokens + max(0.0, t - (t if at is None else at)) * self.rate)
                at = t if at is None else max(at, t)
                wait = 0.0 if tokens >= 1 else (1 - tokens) / self.rate
                over = wait > self.most_wait
                if not over:
                    tokens -= 1  # a request that would wait too long is released and takes none
                yield Row(host=key[0], request_id=i, ts_us=us, wait_s=wait, over_limit=over)
        left = [(i, us) for part in waiting.values() for us, i in part]
        if few and len(left) < few:
            self.few.put(left) if left else self.few.clear()
        later = [*waiting, *(n for n in entries if self._slot_end(n) > passed)]
        idle_from = self._slot_end(served[-1]) if served else idle_from
        next_due = self._slot_end(min(later)) if later else idle_from + self.idle + 1
        if next_due <= passed:
            self.state.clear()  # idle for long enough already
            return
        self.handle.registerTimer(next_due)
        self.state.update((tokens, at, idle_from, min(later, default=None), len(left), dealt - sum(n in stored for n in served), next_due))

    def close(self) -> None:
        pass


def pace_requests(stream: DataFrame, rate: float = 1.0, burst: int = 3, most_wait: float = 10.0, late: str = "1 minute", slot_s: int = 60, idle_s: float = 3600.0) -> DataFrame:
    """Wait of each request (host, request_id, ts) under the host's token bucket, once the watermark has passed its slot.

    Requests later than ``late`` are dropped.  Requests of one host are served
    one after the other, which is what pacing means; those of a slot are what a
    task holds at once.
    """
    timed = stream.select("host", "request_id", "ts", F.unix_micros("ts").alias("ts_us")).withWatermark("ts", late)
    paced = timed.groupBy("host").transformWithState(TokenBucket(rate, burst, most_wait, slot_s, idle_s), PACED, "Append", "EventTime")
    return paced.select("host", "request_id", F.timestamp_micros("ts_us").alias("ts"), "wait_s", "over_limit")


JOB_STATE = "job_id long, status string, attempts int, last_error string, next_delay_s double"


class JobLifecycle(StatefulProcessor):
    """State of one job over its events in order of ``seq``; a finished job ignores replays."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("job", "status string, attempts int, last_error string, seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        status, attempts, error, seen = self.state.get() if self.state.exists() else ("queued", 0, None, -1)
        for e in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples():
            if status == "succeeded" or e.seq <= seen:
                continue
            seen = int(e.seq)
            if e.event == "started":
                status, attempts = "running", attempts + 1
            elif e.event == "succeeded":
                status, error = "succeeded", None
            else:
                status, error = "dead" if e.permanent or attempts > RETRY_LIMIT else "failed", (e.error or "")[:2000]
        self.state.update((status, attempts, error, seen))
        delay = float(RETRY_SECONDS[min(max(attempts, 1), len(RETRY_SECONDS)) - 1]) if status == "failed" else None
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "attempts": [attempts], "last_error": [error if status != "running" else None], "next_delay_s": [delay]})

    def close(self) -> None:
        pass


def job_states(stream: DataFrame) -> DataFrame:
    """State of every job after each batch, from events (job_id, seq, event, error, permanent)."""
    return stream.select("job_id", "seq", "event", "error", "permanent").groupBy("job_id").transformWithStateInPandas(JobLifecycle(), JOB_STATE, "Update", "None")
