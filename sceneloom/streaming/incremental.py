"""Optional streaming: new videos as they come, and sessions of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sceneloom.operators.tables import upsert

COMPACT = 16  # batches after which the deltas are merged


def new_videos(stream: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, key: str, at: str, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(key, start, end, n): runs of events no further apart than ``gap``; with ``late`` set the input is a stream."""
    e = events.withWatermark(at, late) if late else events
    return e.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Work off what is there now into a parquet table, exactly once under the checkpoint; returns the table."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(path)


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: str) -> None:
    """Upsert micro-batches into a table of deltas: each writes its own rows only, one a key; ``latest`` merges them on read.

    A batch that is replayed overwrites its own delta. Every COMPACT batches the deltas so far are merged into one, so a
    read meets few of them and the table is rewritten once in so many batches, not with each.
    """

    def write(batch: DataFrame, version: int) -> None:
        spark = batch.sparkSession
        newest = batch.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in keys]), order).alias("_r")).select(*keys, "_r.*")
        if (version + 1) % COMPACT == 0:
            newest = upsert(latest(spark, path, batch.schema, keys, order, version - 1), newest, keys, order)
        newest.select(*batch.columns).write.mode("overwrite").parquet(f"{path}/{'full' if (version + 1) % COMPACT == 0 else 'delta'}={version}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, path: str, schema: StructType, keys: list[str], order: str, version: int) -> DataFrame:
    """The table after the ``version``-th batch: the last merged state and the deltas since, one row a key."""
    full = (version + 1) // COMPACT * COMPACT - 1
    parts = [f"{path}/full={full}"] if full >= 0 else []
    parts += [f"{path}/delta={v}" for v in range(full + 1, version + 1)]
    if not parts:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*parts)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), order).alias("_r")).select(*keys, "_r.*")
