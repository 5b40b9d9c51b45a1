"""Streaming forms of the run-log reader and of scoring.

The sinks are replayable: a micro-batch overwrites its own partition or is committed by
the file sink's log, so a lost executor or a restarted query never doubles rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from tuneframe.operators.scoring import score_cls, with_answers
from tuneframe.sources.readers import parse_metric_lines, run_of_path
from tuneframe.streaming.growing import GrowingLines


def _trigger(writer: DataStreamWriter, interval: str | None) -> DataStreamWriter:
    """Process what is there and stop, or keep going at an interval."""
    return writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)


# ------------------------------------------------------------------ run logs


def run_log_stream(
    spark: SparkSession, path: str, pattern: str | None = None, max_files: int = 1000, growing: bool = False
) -> DataFrame:
    """Metrics of the log files that appear under ``path``: of complete files, at most ``max_files`` in a micro-batch,
    or (``growing``) of the lines that have been appended to any of them since the last one, see :mod:`.growing`."""
    if growing:
        spark.dataSource.register(GrowingLines)
        lines = spark.readStream.format("growing_lines").option("path", path).load()
        return parse_metric_lines(lines, run_of_path(F.col("path"), *([pattern] if pattern else [])))
    lines = spark.readStream.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).text(path)
    run = run_of_path(F.col("_metadata.file_path"), *([pattern] if pattern else []))
    return parse_metric_lines(lines, run)


def stream_run_log(
    spark: SparkSession, path: str, sink: str, checkpoint: str, pattern: str | None = None, interval: str | None = None,
    growing: bool = False,
) -> StreamingQuery:
    """Append parsed metrics under ``sink``, one partition per micro-batch; a replayed batch
    overwrites its partition. Read the state with :func:`latest_from_sink`."""
    writer = run_log_stream(spark, path, pattern, growing=growing).writeStream.foreachBatch(_store(sink))
    return _trigger(writer.option("checkpointLocation", checkpoint), interval).start()


def _store(sink: str, *partitions: str):
    """Writer of one micro-batch that overwrites only its own partitions."""

    def store(batch: DataFrame, batch_id: int) -> None:
        (
            batch.withColumn("batch", F.lit(batch_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*partitions, "batch")
            .parquet(sink)
        )

    return store


def latest_from_sink(spark: SparkSession, sink: str) -> DataFrame:
    """Latest value per (run, metric) in a sink: by the step in the tag, then by micro-batch.

    A restarted run may log a tag twice in one batch; then the larger value counts, NaN least.
    """
    rows = spark.read.schema("run_name string, tag string, name string, value double, batch int").parquet(sink)
    step = F.coalesce(F.regexp_extract("tag", r"_(\d+)$", 1).try_cast("bigint"), F.lit(0))
    return (
        rows.withColumn("step", step)
        .groupBy("run_name", "name")
        .agg(F.max("step").alias("step"), F.max_by("value", F.struct("step", "batch", F.nanvl("value", F.lit(None).cast("double")))).alias("value"))
    )


# ------------------------------------------------------------------ scoring


# What a prediction was when it arrived.
ARRIVALS = ["on_time", "repeated", "late"]
_CLOCK, _BUCKET, _KEY, _AT = "_clock", "_bucket", "_key", "_at"
# Buckets of keys: one call and one state for the keys of a bucket. Their number is fixed with the state and they grow with the stream.
BUCKETS = 512
_KEY_TYPE = np.dtype("V16")
# Rows of a bucket that wait to be judged together.
HELD_ROWS = 1 << 16


class _Arrivals(StatefulProcessor):
    """Names each row ``on_time``, ``repeated`` or ``late``; remembers the keys of a bucket, each until its time has passed."""

    def __init__(self, columns: Sequence[str], delay_us: int):
        self.columns, self.delay_us = list(columns), delay_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.keys = handle.getValueState("keys", T.StructType([T.StructField("until", T.BinaryType()), T.StructField("key", T.BinaryType())]))

    def _load(self) -> tuple[np.ndarray, np.ndarray]:
        """Times in milliseconds up to which keys are remembered, and the keys."""
        held = self.keys.get()
        until, key = held if held else (b"", b"")
        return np.frombuffer(until, np.int64), np.frombuffer(key, _KEY_TYPE)

    def _save(self, until: np.ndarray, key: np.ndarray) -> None:
        self.keys.update((until.tobytes(), key.tobytes()))
        self.handle.registerTimer(int(until.min()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        until, keys = self._load()
        known = set(keys.tolist())
        fresh: dict[bytes, int] = {}

        def judge(parts: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at = np.concatenate([part[_AT].to_numpy() for part in parts])
            names = np.frombuffer(b"".join(name for part in parts for name in part[_KEY]), _KEY_TYPE).tolist()
            early = at // 1000 < watermark
            arrival = np.where(early, "late", "repeated").astype(object)
            for i in np.argsort(at, kind="stable").tolist():
                if not early[i] and names[i] not in known:
                    known.add(names[i])
                    fresh[names[i]] = (int(at[i]) + self.delay_us) // 1000
                    arrival[i] = "on_time"
            for part in parts:
                yield part[self.columns].assign(arrival=arrival[: len(part)])
                arrival = arrival[len(part) :]

        held, size = [], 0
        for part in rows:
            part.columns = [*self.columns, _CLOCK, _BUCKET, _KEY, _AT]  # names with an underscore in front arrive as numbers
            held.append(part)
            size += len(part)
            if size >= HELD_ROWS:
                yield from judge(held)
                held, size = [], 0
        if size:
            yield from judge(held)
        if fresh:
            more = np.fromiter(fresh.values(), np.int64, len(fresh))
            self._save(np.concatenate((until, more)), np.concatenate((keys, np.frombuffer(b"".join(fresh), _KEY_TYPE))))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until, keys = self._load()
        kept = until > max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        if kept.any():
            self._save(until[kept], keys[kept])
        else:
            self.keys.clear()
        return iter(())

    def close(self) -> None:
        pass


def _key_of(predictions: DataFrame, keys: Sequence[str]) -> Column:
    """The key columns as 16 bytes: a digest of all their values, null told apart from every value."""
    plain = [(F.col(k) + 0.0).alias(k) if isinstance(predictions.schema[k].dataType, T.FractionalType) else F.col(k) for k in keys]
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    return F.unhex(F.md5(F.to_json(F.struct(*plain), exact)))


def arrivals(predictions: DataFrame, time: str = "ts", delay: str = "1 hour", keys: Sequence[str] = ("run_id", "example_id", "step")) -> DataFrame:
    """Add ``arrival`` to every row of a stream: the first of a key is ``on_time``, another one within ``delay`` of it ``repeated``,
    and one that is older than the watermark, or has no time, ``late``. No row is dropped.

    Spark drops rows behind the watermark before a stateful operator sees them. So each row goes in twice: the row itself without a
    clock, which is never dropped, and an empty tick with the time, which moves the watermark and then goes. A key is remembered by its own
    time, so the state holds the keys of about one ``delay``, 24 bytes each. Keys are judged by the bucket, not one by one: a call and a state for each key
    would cost far more than the rows. Needs the state store of :func:`rocksdb_state`.
    """
    clock = F.col(time).cast("timestamp")
    key = _key_of(predictions, keys)
    facts = {
        _BUCKET: (F.pmod(F.hash(key), F.lit(BUCKETS)), "int"),
        _KEY: (key, "binary"),
        _AT: (F.coalesce(F.unix_micros(clock), F.lit(-(2**63))), "long"),
    }
    none = F.lit(None)
    data = F.struct(*predictions.columns, none.cast("timestamp").alias(_CLOCK), *[c.alias(name) for name, (c, _) in facts.items()])
    empty = [none.cast(f.dataType).alias(f.name) for f in predictions.schema]
    tick = F.struct(*empty, clock.alias(_CLOCK), *[none.cast(kind).alias(name) for name, (_, kind) in facts.items()])
    both = predictions.select(F.explode(F.when(clock.isNotNull(), F.array(data, tick)).otherwise(F.array(data))).alias("_r")).select("_r.*").withWatermark(_CLOCK, delay)
    # Asks for the clock, so that it stays behind the watermark, which has to see the ticks.
    marked = both.where(F.col(_CLOCK).isNull())
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in predictions.schema]).add("arrival", "string")
    delay_us = int(pd.Timedelta(delay).total_seconds() * 1_000_000)
    return marked.groupBy(_BUCKET).transformWithStateInPandas(
        _Arrivals(predictions.columns, delay_us), outputStructType=schema, outputMode="append", timeMode="EventTime"
    )


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Streams that are started inside keep their state in RocksDB, which timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def scored_arrivals(arrived: DataFrame, references: DataFrame) -> DataFrame:
    """Scores of every row of :func:`arrivals`, on time or not; ``status`` as in :func:`scored_stream`."""
    return _scored(arrived, references)


def stream_arrivals(scored: DataFrame, sink: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Write under ``sink``, a folder per arrival and micro-batch: ``arrival=on_time`` is the table of results, ``arrival=late`` and
    ``arrival=repeated`` are the side tables. A replayed batch overwrites what it wrote."""
    with rocksdb_state(scored.sparkSession):
        writer = scored.writeStream.foreachBatch(_store(sink, "arrival")).outputMode("append")
        return _trigger(writer.option("checkpointLocation", checkpoint), interval).start()


def _scored(predictions: DataFrame, references: DataFrame) -> DataFrame:
    found = with_answers(predictions).join(references.withColumn("_found", F.lit(True)), "example_id", "left")
    status = F.when(F.col("_found"), "ok").otherwise("missing_reference")
    return score_cls(found.withColumn("status", status).drop("_found"), strict=False)


def scored_stream(
    predictions: DataFrame, references: DataFrame, time: str = "ts", delay: str = "1 hour", keys=("run_id", "example_id", "step")
) -> DataFrame:
    """Score predictions as they land. Repeats of a key within the watermark are dropped;
    the state that remembers keys is bounded by the watermark.

    A prediction without a reference is kept with ``status`` ``missing_reference`` and NULL scores. Rows
    later than the watermark are dropped by Spark; :func:`arrivals` and :func:`scored_arrivals` keep them, and the repeats.
    """
    return _scored(predictions.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys)), references)


def stream_score(scored: DataFrame, sink: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Append per-example scores with exactly-once files."""
    writer = scored.writeStream.format("parquet").outputMode("append")
    return _trigger(writer.option("checkpointLocation", checkpoint).option("path", sink), interval).start()


def windowed_scores(scored: DataFrame, window: str = "10 minutes", time: str = "ts", groups=("run_id", "step")) -> DataFrame:
    """Live means per time window, for ``append`` mode: a window is emitted once it is closed."""
    span: Column = F.window(time, window)
    return scored.groupBy(span, *groups).agg(
        F.avg("accuracy").alias("accuracy"),
        F.avg("parse_success").alias("parse_success"),
        F.count(F.lit(1)).alias("n"),
    )
