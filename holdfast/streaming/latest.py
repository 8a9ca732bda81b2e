"""Extension: a stream of log rows kept as a table of the latest row for each key. The reference has no streams; this is its incremental store, fed by one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.operators.runs import latest
from holdfast.sources import shared


def upsert_latest(stream: DataFrame, path: str, keys: list[str], order: list[str], checkpoint: str):
    """Start a query that, batch by batch, keeps in path/v<batch> the row of each key with the greatest order. The newest version is named in path/current.json; a batch that is run again writes the same version."""
    spark = stream.sparkSession

    def fold(batch: DataFrame, number: int) -> None:
        now = shared.read_json(spark, f"{path}/current.json")
        before = [v for v in (now["version"], now["before"]) if v is not None and v < number] if now else []
        rows = batch
        if before:
            rows = spark.read.parquet(f"{path}/v{max(before)}").unionByName(batch)
        latest(rows, keys, order).write.mode("overwrite").parquet(f"{path}/v{number}")
        shared.write_json(spark, f"{path}/current.json", {"version": number, "before": max(before) if before else None})

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).start()


def current(spark, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/v{shared.read_json(spark, f'{path}/current.json')['version']}")


def windowed_counts(stream: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows for each key and window of event time; rows later than `late` are left out."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"))
