"""Running a stream to the end of its input, into a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StructField, StructType

from vitrine.fixtures import table
from vitrine.session import ensure_checkpoint_dir

BATCH = "batch_id"


def file_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Parquet files called ``name`` in ``folder`` as a stream."""
    schema = table(spark, folder, name.removesuffix(".parquet")).schema
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    )


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def run_to_end(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Process all available input and return what was written, with ``batch_id``.

    Each micro-batch overwrites a folder of its own, so a batch that is run again
    after a failure leaves no duplicates.
    """
    spark = stream.sparkSession
    folder = folder or scratch_folder(spark, "stream")
    schema = stream.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/{BATCH}={batch_id}")

    running = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    running.awaitTermination()
    whole = StructType([*schema.fields, StructField(BATCH, LongType())])
    return spark.read.schema(whole).parquet(f"{folder}/out")
