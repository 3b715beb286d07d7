"""Running streams to their end and reading what they wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from emberwatch.session import scratch_path

#: Time of the row that closes a bounded stream, later than any event; the last century that nanoseconds reach.
END = "2261-01-01 00:00:00"

#: The store that holds several named states per key.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def is_marker(ts: str) -> Column:
    return F.coalesce(F.col(ts) >= F.lit(END).cast("timestamp"), F.lit(False))


def read_parquet_stream(spark: SparkSession, folder: str, pattern: str, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; the schema is that of the files there now."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)


def append_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Process all that is available in append mode; the result as a table in the shared folder."""
    spark = stream.sparkSession
    path, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path)
    writer.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def append_whole(
    log: DataFrame, ts: str, build: Callable[[DataFrame], DataFrame], name: str, settings: dict[str, str] | None = None
) -> DataFrame:
    """All results of a bounded stream, those too that wait for the watermark at the log's end.

    The log is read beside a second source, empty at first. When the log is through, a row with nothing but a
    time, ``END``, is put there and the same query goes on from its checkpoint: the watermark passes all open
    sessions, windows and timers, and what they hold comes out. ``build`` must let that row through to its watermark.
    """
    spark = log.sparkSession
    folder, path, state = (scratch_path(spark, f"{name}-{kind}") for kind in ("closing", "out", "state"))
    spark.createDataFrame([], log.schema).write.parquet(folder)
    found = build(log.unionByName(spark.readStream.schema(log.schema).parquet(folder)))
    before = {key: spark.conf.get(key, None) for key in settings or {}}

    def run() -> None:
        writer = found.writeStream.format("parquet").outputMode("append").option("path", path)
        writer.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    try:
        for key, value in (settings or {}).items():
            spark.conf.set(key, value)
        run()
        types = {field.name: field.dataType for field in log.schema}
        marker = [F.lit(END if c == ts else None).cast(types[c]).alias(c) for c in log.columns]
        spark.range(1).select(*marker).write.mode("append").parquet(folder)
        run()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(found.schema).parquet(path)


def write_with_progress(stream: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, DataFrame]:
    """Process all that is available batch by batch: what was written, and one row of progress per batch.

    ``measures`` are aggregates over a batch's rows, taken by ``observe`` while the batch is written. The sink is a
    folder per batch number that a batch run again overwrites, so nothing is written or counted twice.
    """
    spark = stream.sparkSession
    path, seen, state = (scratch_path(spark, f"{name}-{kind}") for kind in ("out", "progress", "state"))

    def write(batch: DataFrame, batch_id: int) -> None:
        observed = Observation(f"{name}-{batch_id}")
        columns = [measure.alias(key) for key, measure in measures.items()]
        batch.observe(observed, *columns).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        row = [(key, float(value or 0)) for key, value in observed.get.items()]
        spark.createDataFrame(row, "measure string, value double").write.mode("overwrite").parquet(f"{seen}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", state)
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path), spark.read.parquet(seen)


def latest_updates(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Process all that is available in update mode; the last update of each key.

    A batch that is run again overwrites its own folder, so nothing counts twice.
    """
    spark = stream.sparkSession
    path, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stream.writeStream.outputMode("update").foreachBatch(write)
    writer.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    updates = spark.read.parquet(path)
    values = [c for c in updates.columns if c not in keys and c != "batch"]
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_last"))
    return last.select(*keys, "_last.*")
