"""Streaming jobs: sources, stateless aggregates, sinks."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hammertrail.session import shared_dir

#: Event time of the row that ends a stream: the last year that fits the nanoseconds of pandas.
END_TIME = "2261-01-01"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(like: DataFrame, path: str, per_trigger: int | None = 100) -> DataFrame:
    """A table, one file or a folder of files, as a stream with the schema of ``like``.

    The path is a glob, since a stream takes a single file only by one; its last letter in brackets matches itself.
    ``per_trigger`` bounds the files of a micro-batch; None takes all there are into one.
    """
    reader = like.sparkSession.readStream.schema(like.schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def _end(where: str) -> str:
    return f"{where}/end"


def with_end(rows: DataFrame, where: str) -> DataFrame:
    """``rows`` of a stream and, once ``drain`` has written it, the row that ends them.

    The end has no id and an ``event_time`` in the far future: the watermark passes all rows held before it.
    """
    spark = rows.sparkSession
    spark.createDataFrame([], rows.schema).write.mode("append").parquet(_end(where))
    return rows.unionByName(spark.readStream.schema(rows.schema).parquet(_end(where)))


def folder(spark: SparkSession, name: str) -> str:
    """A new folder for a stream that all executors reach."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:8]}"


def drain(stream: DataFrame, name: str, mode: str = "append", where: str | None = None, ends: DataFrame | None = None) -> DataFrame:
    """Process what is there and return the written result.

    Append streams go to the file sink, which is exactly-once. Other modes
    write every micro-batch to a folder of its own number, so a repeated batch
    replaces itself; the column ``batch`` tells newer results from older.
    A stream over ``with_end(ends, where)`` is run again from its checkpoint
    with the end written, which folds the rows it holds; without ``ends`` they
    stay in the state, and a later run goes on.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    base = where or folder(spark, name)
    _run_once(stream, base, mode)
    if ends is not None:
        row = {c: F.lit(None).cast(t) for c, t in ends.dtypes} | {"event_time": F.lit(END_TIME).cast("timestamp")}
        spark.range(1).select(*[row[c].alias(c) for c in ends.columns]).write.mode("append").parquet(_end(base))
        _run_once(stream, base, mode)
    return spark.read.schema(_with_batch(stream, mode)).parquet(f"{base}/out")


def _run_once(stream: DataFrame, base: str, mode: str) -> None:
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", f"{base}/out").start()
    else:
        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

        query = writer.outputMode(mode).foreachBatch(write).start()
    query.awaitTermination()


def _with_batch(stream: DataFrame, mode: str):
    schema = stream.schema
    return schema if mode == "append" else schema.add("batch", "long")


def newest(results: DataFrame, keys: list[str]) -> DataFrame:
    """Latest update per key of an update-mode result."""
    rest = [c for c in results.columns if c not in keys]
    return results.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*").drop("batch")


def visit_stream(visits: DataFrame) -> DataFrame:
    """Running visit count per strongest key of a visit (update mode)."""
    key = F.coalesce(
        F.concat(F.lit("vehicle:"), F.col("vehicle_id").cast("string")),
        F.concat(F.lit("hash:"), F.col("hash_id")), F.concat(F.lit("ref:"), F.col("reference")),
    )
    return visits.groupBy(key.alias("visit_key")).agg(
        F.count("*").alias("visit_count"), F.max("visited_at").alias("last_visited_at")
    )


def _activity(rows: DataFrame, size: str, slide: str | None) -> DataFrame:
    window = F.window("scraped_at", size, slide) if slide else F.window("scraped_at", size)
    return (
        rows.groupBy(window, "status")
        .agg(
            F.count("*").alias("n"),
            F.count("starting_price").alias("n_priced"),
            F.sum("starting_price").alias("price_sum"),
        )
        .select(F.col("window.start").alias("start"), "status", "n", "n_priced", "price_sum")
    )


def windowed_activity(stream: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "6 hours") -> DataFrame:
    """Snapshots, sales and mean price per window and status, with bounded state.

    Rows more than ``late`` behind the newest one are not counted; ``drain_activity`` counts them.
    """
    return _activity(stream.withWatermark("scraped_at", late), size, slide)


def drain_activity(stream: DataFrame, name: str, size: str = "1 day", slide: str | None = None, where: str | None = None) -> DataFrame:
    """The same counts over everything there, however late.

    Every micro-batch writes its own counts to a folder of its number, so a
    repeated batch replaces itself; counts and sums of the batches add up.
    There is no state, and a late row adds to its window like any other.
    """
    spark = stream.sparkSession
    base = where or folder(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        _activity(batch, size, slide).write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    writer.foreachBatch(write).start().awaitTermination()
    schema = "start timestamp, status string, n long, n_priced long, price_sum long, batch long"
    parts = spark.read.schema(schema).parquet(f"{base}/out")
    return parts.groupBy("start", "status").agg(*[F.sum(c).alias(c) for c in ("n", "n_priced", "price_sum")])


def watchlist_alerts(price_moves: DataFrame, watch: DataFrame) -> DataFrame:
    """Price moves of watched entities whose watcher wants them.

    Stream-static join; the watchlist side stays as small or large as it is.
    """
    wanted = watch.filter("alert_on_price").select("vehicle_id")
    moved = price_moves.filter(F.col("price_changed").isNotNull())
    return moved.join(wanted, "vehicle_id").withColumn(
        "type", F.when(F.col("price_changed") < 0, F.lit("price_drop")).otherwise(F.lit("price_up"))
    )


def vanished_stream(batches: DataFrame, sink: Callable[[DataFrame, int], None], where: str) -> None:
    """Run the disappearance check on every list batch.

    ``sink`` gets each micro-batch of list items with its number; it joins the
    stored entities in batch form, where the seven-day rule lives.
    """
    query = (
        batches.writeStream.option("checkpointLocation", f"{where}/state").trigger(availableNow=True)
        .foreachBatch(sink).start()
    )
    query.awaitTermination()
