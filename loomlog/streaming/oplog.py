"""The log as a stream. Each operator has a batch twin in `operators`, which its test compares it with.

The stream of operations carries no watermark: whatever comes late is still part of its document.
Only aggregates over time (events of a tick, sessions) have one.
"""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomlog.operators import intervals, merge, store

OPS = "doc string, client long, seq long, ts timestamp_ntz, k long, value double, len long, clock long"


def read_ops(spark: SparkSession, path: str, schema: str = OPS, files_per_trigger: int = 1) -> DataFrame:
    """Operations from a folder that files are added to."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run(df: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Run a stream over all that is there now, with `each` for each batch; it goes on where it stopped."""
    df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start().awaitTermination()


def deduped(ops: DataFrame) -> DataFrame:
    """Each operation once, however late it comes again."""
    return ops.dropDuplicates(["doc", "client", "clock"])


def state_vectors(ops: DataFrame) -> DataFrame:
    return intervals.state_vector(ops)


def tumbling(events: DataFrame, width: str, late: str, key: tuple = ("doc",)) -> DataFrame:
    """(key, start, n) of each closed window: many edits, one event."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(*key, F.window("at", width).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*key, F.col("w.start").alias("start"), "n")


def hopping(events: DataFrame, width: str, step: str, late: str, key: tuple = ("doc",)) -> DataFrame:
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(*key, F.window("at", width, step).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*key, F.col("w.start").alias("start"), "n")


def idle_sessions(events: DataFrame, gap: str, late: str, key: tuple = ("doc",)) -> DataFrame:
    """(key, started, ended, n) of each session that has been quiet for longer than the gap."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(*key, F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("ended")).select(*key, F.col("w.start").alias("started"), "ended", "n")


def presence(updates: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """(doc, client, clock, state, present): the presence of each client whenever it changes.

    updates: (doc, client, clock, state). A clock counts if it is higher than the one held, which is 0
    for an unknown client, or the same with a removal of a client that is there. With a ttl, a
    client that is silent for so long is removed at its clock.
    """

    def step(key, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        clock, state, there = held.get if held.exists else (0, None, False)
        before = (clock, state, there)
        if held.hasTimedOut:
            state, there = None, False
        for frame in frames:
            for c, s in frame.sort_values("clock")[["clock", "state"]].itertuples(index=False):
                gone = not isinstance(s, str)
                if c > clock or (c == clock and gone and there):
                    clock, state, there = int(c), None if gone else s, not gone
        held.update((clock, state, there))
        if ttl_ms and there:
            held.setTimeoutDuration(ttl_ms)
        if (clock, state, there) != before:
            yield pd.DataFrame({"doc": [key[0]], "client": [key[1]], "clock": [clock], "state": [state], "present": [there]})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return updates.groupBy("doc", "client").applyInPandasWithState(step, "doc string, client long, clock long, state string, present boolean", "clock long, state string, present boolean", "update", timeout)


def token_bucket(events: DataFrame, capacity: float, rate: float) -> DataFrame:
    """(client, seq, tokens) as events (client, seq, ts, len) arrive; see `rooms.token_bucket`."""

    def step(key, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        at, tokens = held.get if held.exists else (None, capacity)
        rows = pd.concat(list(frames)).sort_values(["ts", "seq"])
        out = []
        for seq, ts, cost in rows[["seq", "ts", "len"]].itertuples(index=False):
            now = ts.value / 1e9
            tokens = (capacity if at is None else min(capacity, tokens + max(now - at, 0) * rate)) - cost
            at = now
            out.append((key[0], seq, tokens))
        held.update((at, tokens))
        yield pd.DataFrame(out, columns=["client", "seq", "tokens"])

    return events.groupBy("client").applyInPandasWithState(step, "client long, seq long, tokens double", "at double, tokens double", "append", GroupStateTimeout.NoTimeout)


def answers(ops: DataFrame, peers: DataFrame) -> DataFrame:
    """What each arriving operation holds that the peers (doc, client, state) lack: a stream joined to a table."""
    return intervals.diff_since(ops, peers)


def fan_out(ops: DataFrame, members: DataFrame) -> DataFrame:
    from loomlog.operators import rooms

    return rooms.fan_out(ops, members)


def append_to(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that a batch that runs again does not repeat: each batch is a folder of its own."""

    def each(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return each


def materialise(log_path: str, view_path: str) -> Callable[[DataFrame, int], None]:
    """A sink for decoded updates: they join the log, and the documents they touch are merged anew.

    Only touched documents are read again; their views land in a folder a batch, the newest of which counts.
    """

    def each(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{log_path}/batch={n}")
        log = spark.read.parquet(log_path).where(F.col("batch") <= n).drop("batch")
        touched = log.join(batch.select("doc").distinct(), "doc", "left_semi")
        merge.texts(merge.integrate(touched)).write.mode("overwrite").parquet(f"{view_path}/batch={n}")

    return each


def latest_texts(spark: SparkSession, view_path: str) -> DataFrame:
    """(doc, parent, text) as of the last batch that touched each."""
    rows = spark.read.parquet(view_path)
    return rows.groupBy("doc", "parent").agg(F.max_by("text", "batch").alias("text"))


def deliver(send: Callable[[list], None], tries: int = 3) -> Callable[[DataFrame, int], None]:
    """A sink that hands rows to `send` from the tasks, a partition at a time, and tries again on failure."""

    def each(batch: DataFrame, n: int) -> None:
        def part(rows):
            held = [r.asDict(recursive=True) for r in rows]
            for k in range(tries):
                try:
                    return send(held) if held else None
                except OSError:
                    if k + 1 == tries:
                        raise

        batch.foreachPartition(part)

    return each


def compaction_due(ops: DataFrame, every: int) -> DataFrame:
    """(doc, n) whenever another `every` operations of a document have come in."""

    def step(key, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        before = held.get[0] if held.exists else 0
        after = before + sum(map(len, frames))
        held.update((after,))
        if after // every > before // every:
            yield pd.DataFrame({"doc": [key[0]], "n": [after // every * every]})

    return ops.groupBy("doc").applyInPandasWithState(step, "doc string, n long", "n long", "append", GroupStateTimeout.NoTimeout)


def compact_batch(documents: DataFrame, log: DataFrame, integrated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Compaction of what is fully integrated; rows that still wait for others stay in the log."""
    waiting = integrated.where("pending").select(F.col("doc").alias("doc_id")).distinct()
    return store.compact(documents, log, log.select("doc_id", "seq").join(waiting, "doc_id", "left_anti"))
