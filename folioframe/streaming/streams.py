"""Pages that keep arriving: the batch operators per micro-batch, completion and registry upkeep."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from folioframe.functions.numbers import half_up
from folioframe.operators.templates import register, registry_status


def page_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def _run(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append", no_data: bool = False) -> None:
    """Process what has arrived and stop; call again (or schedule) for what comes later.

    Batches without data are off unless ``no_data``: state with a timeout by the clock would ask for them without end, and its timeouts fire with the next
    data. Event-time timers need one such batch after the watermark has moved.
    """
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, str(no_data).lower())
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    finally:
        conf.set(name, before)
    query.awaitTermination()


def stream_pages(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Whole page rows through a page operator, once each; a replayed batch overwrites its own partition."""
    def each(batch: DataFrame, batch_id: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    _run(stream, checkpoint, each)


def document_complete(stream: DataFrame, out: str, checkpoint: str, doc: str = "doc_id", time: str = "ts", idle_hours: float = 168.0) -> None:
    """One row per document, written once: in the batch in which its last announced page arrives (``state`` complete).

    ``stream``: one row per completed page with ``announced`` pages and ``elapsed_ms``. What is known of a document is
    forgotten after ``idle_hours`` without a page; one that was never complete is then written as ``incomplete``. Pages
    of a document already written change nothing while it is remembered.
    """
    key = stream.schema[doc].dataType.simpleString()
    known = "pages bigint, announced bigint, elapsed_ms double, completed_at timestamp"

    def follow(group, pieces, state):
        if state.hasTimedOut:
            pages, announced, elapsed, last, written = state.get
            state.remove()
            if not written:
                yield pd.DataFrame([(group[0], pages, announced, elapsed, last, "incomplete")], columns=names)
            return
        pages, announced, elapsed, last, written = state.get if state.exists else (0, 0, 0.0, None, False)
        for piece in pieces:
            pages += len(piece)
            announced = max(announced, int(piece["announced"].fillna(0).max()))
            elapsed += float(piece["elapsed_ms"].fillna(0).sum())
            latest = piece[time].max()
            if not pd.isna(latest):
                last = latest.to_pydatetime() if last is None else max(last, latest.to_pydatetime())
        ready = not written and pages >= announced
        state.update((pages, announced, elapsed, last, written or ready))
        state.setTimeoutDuration(max(1, round(idle_hours * 3_600_000)))
        if ready:
            yield pd.DataFrame([(group[0], pages, announced, elapsed, last, "complete")], columns=names)

    names = [doc, "pages", "announced", "elapsed_ms", "completed_at", "state"]
    page = stream.select(doc, F.col("announced").cast("bigint"), F.col("elapsed_ms").cast("double"), time)
    found = page.groupBy(doc).applyInPandasWithState(follow, f"`{doc}` {key}, {known}, state string", f"{known}, written boolean", "append", "ProcessingTimeTimeout")

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    _run(found, checkpoint, each)


def _percent() -> Column:
    read = F.least(F.lit(85), half_up(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("fraction"))) * 85))
    return F.when(F.col("is_analysis"), 90).otherwise(read).cast("bigint")


def progress(event: DataFrame, doc: Sequence[str] = ("doc_id",), bucket_seconds: int = 3600) -> DataFrame:
    """Monotone percentage per document: at most 85 while pages are read, 90 from the analysis on.

    ``event``: ``ts``, ``event_id``, ``fraction`` (0-1 of all pages), ``is_analysis``. The running maximum is taken
    inside time buckets and over one row per bucket, so a busy document does not run through one window.
    """
    e = event.withColumns({"_p": _percent(), "_b": F.floor(F.unix_timestamp("ts") / bucket_seconds)})
    before = Window.partitionBy(*doc).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tops = e.groupBy(*doc, "_b").agg(F.max("_p").alias("_m")).withColumn("_before", F.coalesce(F.max("_m").over(before), F.lit(0))).drop("_m")
    inside = Window.partitionBy(*doc, "_b").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumn("_in", F.max("_p").over(inside)).join(tops, [*doc, "_b"]).withColumn("percent", F.greatest("_in", "_before")).drop("_p", "_b", "_in", "_before")


class _Progress(StatefulProcessor):
    """Events of one document wait until the watermark has passed them, and leave in the order of time with the maximum so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts timestamp, event_id bigint, percent bigint")
        self.top = handle.getValueState("top", "percent bigint")

    def handleInputRows(self, key, rows, timerValues):
        # one timer, at the first of the events: what is released sets the next one
        for piece in rows:
            events = [(ts.to_pydatetime(), int(event_id), int(percent)) for ts, event_id, percent in zip(piece["ts"], piece["event_id"], piece["percent"])]
            if events:
                self.waiting.appendList(events)
                self.handle.registerTimer(int(piece["ts"].min().timestamp() * 1000))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        # all that the watermark has passed, so that each event is read and written once and not with every other one's timer
        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        if not self.waiting.exists():
            return
        top = self.top.get()[0] if self.top.exists() else 0
        out, later = [], []
        for ts, event_id, percent in sorted(map(tuple, self.waiting.get())):
            if int(ts.timestamp() * 1000) > until:
                later.append((ts, event_id, percent))
                continue
            top = max(top, percent)
            out.append((*key, event_id, top))
        self.top.update((top,))
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(int(later[0][0].timestamp() * 1000))
        else:
            self.waiting.clear()
        yield pd.DataFrame(out, columns=["doc", "event_id", "percent"])

    def close(self) -> None:
        pass


def stream_progress(stream: DataFrame, out: str, checkpoint: str, doc: str = "doc_id", lateness: str = "1 hour") -> None:
    """Every event once with the percentage that :func:`progress` gives it, as soon as no earlier event can come any more.

    ``stream``: ``doc``, ``ts``, ``event_id``, ``fraction``, ``is_analysis``. An event waits in the state of its document until the watermark, the latest time seen less
    ``lateness``, has passed it; a timer then releases it. Events that arrive later than that are left out. A replayed batch overwrites its own
    partition. What is still waiting at the end leaves when the stream goes on.
    """
    kind = stream.schema[doc].dataType.simpleString()
    events = stream.select(F.col(doc).alias("doc"), "ts", F.col("event_id").cast("bigint").alias("event_id"), _percent().alias("percent")).withWatermark("ts", lateness)
    found = events.groupBy("doc").transformWithStateInPandas(_Progress(), f"doc {kind}, event_id bigint, percent bigint", "append", "EventTime")

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.withColumnRenamed("doc", doc).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    store = "spark.sql.streaming.stateStore.providerClass"
    conf = stream.sparkSession.conf
    before = conf.get(store)
    conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        _run(found, checkpoint, each, no_data=True)
    finally:
        conf.set(store, before)


TEMPLATE = "template_id BIGINT, fingerprint STRING, ord BIGINT"
BUCKETS = 256


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("fingerprint"), F.lit(buckets)).cast("int")


def _append_templates(template: DataFrame, registry_folder: str, batch_id: int, buckets: int) -> None:
    placed = template.select("template_id", "fingerprint", "ord", _bucket(buckets).alias("bucket"), F.lit(batch_id).cast("bigint").alias("batch_id"))
    # files of one bucket come from few tasks, a large bucket from several
    placed.hint("rebalance", "bucket").write.partitionBy("bucket", "batch_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{registry_folder}/template")


def start_registry(template: DataFrame, registry_folder: str, buckets: int = BUCKETS) -> None:
    """Store the templates known before the first batch (``template_id``, ``fingerprint``, ``ord``); ``buckets`` holds for the life of the registry."""
    _append_templates(template, registry_folder, -1, buckets)


def stored_templates(spark: SparkSession, registry_folder: str) -> DataFrame:
    return spark.read.schema(f"{TEMPLATE}, bucket INT, batch_id BIGINT").parquet(f"{registry_folder}/template")


def registry_updates(stream: DataFrame, registry_folder: str, checkpoint: str, buckets: int = BUCKETS) -> None:
    """Registrations and status events per micro-batch against the stored registry.

    Rows: ``template_id``, ``fingerprint`` (null for status events), ``status``, ``ts``, ``event_id``. The registry lies in
    ``buckets`` by fingerprint, and a batch reads those of its own fingerprints. Accepted registrations and events
    are appended; a replayed batch doesn't see what it wrote before, and overwrites it.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        new = batch.where(F.col("fingerprint").isNotNull()).select("template_id", "fingerprint", F.col("event_id").alias("ord"))
        touched = [r[0] for r in new.select(_bucket(buckets)).distinct().collect()]  # at most ``buckets`` numbers
        stored = stored_templates(spark, registry_folder).where(F.col("bucket").isin(touched) & (F.col("batch_id") != batch_id))
        _append_templates(register(new, stored), registry_folder, batch_id, buckets)
        batch.where(F.col("fingerprint").isNull()).select("template_id", "status", "ts", "event_id").write.mode("overwrite").parquet(f"{registry_folder}/event/batch_id={batch_id}")
        batch.unpersist()

    _run(stream, checkpoint, each)


def stored_status(spark: SparkSession, registry_folder: str) -> DataFrame:
    """Current status per template from the stored event log."""
    return registry_status(spark.read.parquet(f"{registry_folder}/event"))
