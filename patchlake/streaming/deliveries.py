"""Deliveries that keep arriving: routed, told apart by their id, and written to several sinks at once."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from patchlake.operators.deliveries import route

#: Sinks by name, each with the routed deliveries that it takes.
SINKS = {"reviews": "status = 'processing'", "rejected": "status = 'rejected'", "log": "true"}


def read_landing(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def distinct_deliveries(deliveries: DataFrame, delivery_id: str, arrived: str, within: str) -> DataFrame:
    """Of deliveries with one id the first, if the others arrive within that time after it. State is kept for as long, one row per id.

    A host sends a delivery again when it got no answer in time. A null id is one like others, so rows without an id should not come here."""
    return deliveries.withWatermark(arrived, within).dropDuplicatesWithinWatermark([delivery_id])


def write_routed(deliveries: DataFrame, path: str, checkpoint: str, secret: str = "", once: bool = False) -> StreamingQuery:
    """Route every delivery and write it below `path` in a folder per status.

    Routing keeps no state. The file sink's log makes each row land once, also after a restart.
    """
    routed = route(deliveries, secret).drop("payload")
    writer = (
        routed.writeStream.outputMode("append").format("parquet").partitionBy("status")
        .option("path", path).option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def put(rows: DataFrame, folder: str, sink: str, batch: int) -> None:
    """What a batch gives a sink, in a folder of its own: written again, it replaces what was there."""
    rows.write.mode("overwrite").parquet(f"{folder}/{sink}/batch={batch}")


def read_sink(spark: SparkSession, folder: str, sink: str) -> DataFrame:
    """All that a sink holds, with `batch`."""
    return spark.read.parquet(f"{folder}/{sink}")


def write_sinks(
    deliveries: DataFrame, folder: str, checkpoint: str, secret: str = "", sinks: dict[str, str | Column] = SINKS, once: bool = False
) -> StreamingQuery:
    """Route every delivery and write it to all sinks that take it, and the number of each status to the sink `counts`.

    A batch is done when all of its sinks are written. If one fails, or the driver is lost, the whole batch runs again and replaces what
    it wrote before, so the sinks always hold the same deliveries. A batch is routed once, and kept while its sinks are written.
    """
    routed = route(deliveries, secret).drop("payload")

    def split(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for name, taken in sinks.items():
                put(batch.where(taken), folder, name, number)
            put(batch.groupBy("status", "code").agg(F.count("*").alias("n")), folder, "counts", number)
        finally:
            batch.unpersist()

    writer = routed.writeStream.outputMode("append").foreachBatch(split).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
