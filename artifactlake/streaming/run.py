"""Reading tables as streams and draining a stream into a table."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_dir


def table_stream(
    spark: SparkSession, folder: str, name: str, schema: T.StructType, files_per_trigger: int = 64
) -> DataFrame:
    """Parquet files of one table as a stream; the trigger size bounds a micro-batch."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", f"{name}.parquet")
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(folder)
    )


def drain(
    stream: DataFrame,
    mode: str = "append",
    keys: Sequence[str] | None = None,
    arrivals: Sequence[Callable[[], None]] = (),
) -> DataFrame:
    """Run a stream over all present data and return what it wrote.

    Each of ``arrivals`` brings more data; the stream runs on from its progress after each of them.

    Every micro-batch overwrites its own folder, so a batch that runs again after a failure is not
    written twice. With ``keys`` (update mode) the latest row per key is returned.
    """
    spark = stream.sparkSession
    root = f"{scratch_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    writer = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{root}/progress")
        .trigger(availableNow=True)
        .foreachBatch(write)
    )
    for arrive in arrivals or [lambda: None]:
        arrive()
        writer.start().awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    out = spark.read.schema(schema).parquet(f"{root}/out")
    if keys is None:
        return out.drop("batch")
    rest = [c for c in stream.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), "batch").alias("r")
    return out.groupBy(*keys).agg(newest).select(*keys, "r.*")
