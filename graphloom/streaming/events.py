"""Events: batch and Structured Streaming forms share the same functions wherever the engine allows.

Event time is ``ts``; a stream takes an explicit watermark, and rows later than it are dropped by the engine from
stateful operators only.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator
from operator import itemgetter

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..functions.cut import new_path


def sessions(events: DataFrame, gap: str, key: str = "user_id", watermark: str | None = None) -> DataFrame:
    """Activity sessions by a gap: key, started, ended, events.  For a stream give a watermark."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if watermark:
        e = e.withWatermark("ts", watermark)
    g = e.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return g.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")


def pair_calls(called: DataFrame, completed: DataFrame, key: str, within: str, watermark: str | None = None) -> DataFrame:
    """Each call with the completions of its key that follow within the time, with duration_ms; on streams an interval
    join whose state the watermark bounds."""
    a, b = called, completed.withColumnsRenamed({key: "key_", "ts": "done"})
    if watermark:
        a, b = a.withWatermark("ts", watermark), b.withWatermark("done", watermark)
    on = (F.col(key) == F.col("key_")) & (F.col("done") >= F.col("ts")) & (F.col("done") <= F.col("ts") + F.expr(f"INTERVAL {within}"))
    return a.join(b, on).drop("key_").withColumn("duration_ms", (F.unix_micros("done") - F.unix_micros("ts")) / 1000.0)


def stage_transitions(events: DataFrame, key: str, stage: str, order: list[str]) -> DataFrame:
    """Forward-only stages: a row is accepted when its stage isn't under the greatest before it."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("accepted", F.coalesce(F.col(stage) >= F.max(stage).over(w), F.lit(True)))


class Stages(StatefulProcessor):
    """Greatest stage of each key so far.  A key without events for ``ttl_ms`` of event time is forgotten, wherever batches end; a timer clears
    what it held.  Rows of a batch are taken in the order given."""

    def __init__(self, stage: str, order: list[str], columns: list[str], ttl_ms: int) -> None:
        self.ttl_ms, self.row = ttl_ms, Row(*columns, "accepted")
        self.stage, self.ts, self.order = columns.index(stage), columns.index("ts"), [columns.index(c) for c in order]

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "top long, until long")  # one value: each call is a round trip

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        top, until = was = self.held.get() or (None, None)
        for r in sorted(rows, key=itemgetter(*self.order)):  # values stand in the order of columns
            at, stage = int(r[self.ts].timestamp() * 1000), r[self.stage]
            if until is not None and at > until:
                top = None
            accepted = top is None or stage >= top
            top = stage if top is None else max(top, stage)
            until = at + self.ttl_ms if until is None else max(until, at + self.ttl_ms)
            yield self.row(*r, accepted)
        if (top, until) != tuple(was):
            self.held.update((top, until))
        if was[1] is None:  # one timer a key; it is set anew only when it rings
            self.handle.registerTimer(until)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = self.held.get()[1]
        if until > expiredTimerInfo.getExpiryTimeInMs():
            self.handle.registerTimer(until)
        else:
            self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def stage_stream(events: DataFrame, key: str, stage: str, order: list[str] | None = None, watermark: str = "10 minutes", ttl_ms: int = 86_400_000) -> DataFrame:
    """The same on a stream: the columns of ``order`` (ts first) and ``accepted`` for each row, batch by batch.  State is one value a key, dropped
    ``ttl_ms`` after its last event; rows behind the watermark are dropped before it.  The query starts under ``state_store``."""
    order = order or ["ts"]
    columns = list(dict.fromkeys([key, *order, stage]))
    e = events.select(*columns).withColumn("ts", F.col("ts").cast("timestamp")).withColumn(stage, F.col(stage).cast("long")).withWatermark("ts", watermark)
    out = T.StructType([*[e.schema[c] for c in columns], T.StructField("accepted", T.BooleanType())])
    return e.groupBy(key).transformWithState(Stages(stage, order, columns, ttl_ms), out, "append", "EventTime")


PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Keyed state with timers needs the RocksDB provider; the session has its own again afterwards."""
    was = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, was) if was else spark.conf.unset(PROVIDER)


def replayed(events: DataFrame, query: Callable[[DataFrame], DataFrame], batches: int = 4, closing: str | None = None) -> DataFrame:
    """A table as a stream: its rows are written by ranges of ts, a range of many files arrives at a time and is one batch, and what ``query`` makes
    of the stream is run to its end each time and read back.  With ``closing``, one more batch has the last row again, so much later, which lets the watermark close what
    waits for it.  Rows without ts come first."""
    spark = events.sparkSession
    place = new_path(spark)
    time = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = events.select(F.percentile_approx(time, F.lit([k / batches for k in range(1, batches)]), F.lit(10_000))).first()[0] or [] if batches > 1 else []
    batch = sum((F.when(time > F.lit(c), 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0))
    events.withColumn("batch", batch).write.partitionBy("batch").parquet(f"{place}/dealt")
    dealt = spark.read.schema(T.StructType([*events.schema, T.StructField("batch", T.IntegerType())])).parquet(f"{place}/dealt")
    arriving = [dealt.where(F.col("batch") == k).drop("batch") for k in range(len(set(cuts)) + 1)]
    if closing:
        last = events.orderBy(F.desc_nulls_last("ts")).limit(1).withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {closing}"))
        arriving.append(last.select(*[F.col(f.name).cast(f.dataType) for f in events.schema]))
    for rows in arriving:
        rows.write.mode("append").parquet(f"{place}/in")
        out = query(spark.readStream.schema(events.schema).parquet(f"{place}/in"))
        with state_store(spark):
            run = out.writeStream.format("parquet").option("checkpointLocation", f"{place}/checkpoint").outputMode("append").trigger(availableNow=True).start(f"{place}/out")
            run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{place}/out")


def windowed_counts(events: DataFrame, width: str, slide: str | None = None, watermark: str | None = None, by: str = "event_type") -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if watermark:
        e = e.withWatermark("ts", watermark)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return e.groupBy(w.alias("w"), by).agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "events")


def read_stream(spark: SparkSession, path: str, schema: str, form: str = "json") -> DataFrame:
    return spark.readStream.format(form).schema(schema).load(path)


def append_log(events: DataFrame, path: str, checkpoint: str, form: str = "json"):
    """Append-only sink; with its checkpoint each event is written once."""
    return events.writeStream.format(form).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)


def fan_out(events: DataFrame, sinks: dict[str, Callable[[DataFrame, int], None]], checkpoint: str, failed: list | None = None):
    """Each batch to every sink; one that fails doesn't stop the others.  Its failure is noted in ``failed``, or, where none is given, written as a
    row (sink, batch, error) beside the checkpoint, in ``failures``, for the batch doesn't come again."""

    def send(batch: DataFrame, number: int) -> None:
        batch.persist()
        for name, sink in sinks.items():
            try:
                sink(batch, number)
            except Exception as e:  # a sink is foreign code
                if failed is not None:
                    failed.append((name, number, str(e)))
                else:
                    batch.sparkSession.createDataFrame([(name, number, str(e))], "sink string, batch long, error string").write.mode("append").parquet(f"{checkpoint}/failures")
        batch.unpersist()

    return events.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
