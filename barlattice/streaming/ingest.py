"""Incremental landing of day files with a file stream that drains what is there and stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..schemas import LANDED
from ..sources.landing import ingest_days, path_exists, remove_path


def ingest_stream(
    spark: SparkSession, incoming: str, root: str, source: str, checkpoint: str, force: bool = False,
    files_per_trigger: int | None = None,
) -> None:
    """Land new files from `incoming`; the stream's checkpoint remembers which were taken.

    The files carry their date as a column or a `date=` directory. Batches are held below the checkpoint, one
    folder a batch, and landed together once the stream is drained, so a day whose files come in several batches is
    landed whole. A day that an earlier run landed is left alone unless `force`, which replaces it. After a failure
    the next run finds the held batches (a replayed batch overwrites its own folder) and lands them with its own.
    """
    schema = T.StructType(list(LANDED[source].fields) + [T.StructField("date", T.DateType())])
    held = f"{checkpoint.rstrip('/')}-held"

    def hold(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{held}/batch={batch_id}")

    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    query = (
        reader.parquet(incoming)
        .writeStream.foreachBatch(hold)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    if path_exists(spark, held):
        ingest_days(spark.read.schema(schema).parquet(held).drop("batch"), root, source, force)
        remove_path(spark, held)
