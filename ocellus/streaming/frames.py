"""Frame directories and head tables as streams.

Suppression is inside one image, so a micro-batch that holds whole images needs no state: each one is decoded by the
same operators as a table, in foreachBatch, and results are appended by image.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ocellus.functions.config import InferenceConfig
from ocellus.operators import decode

IMAGE_SCHEMA = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"


def frame_stream(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """An unbounded source: the images that appear in a folder. Stands in for cameras and network streams, whose decoders are not here."""
    return spark.readStream.format("image").schema(IMAGE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).load(folder)


def head_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    """An unbounded source of head rows; every file holds whole images."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def detect_stream(stream: DataFrame, config: InferenceConfig, sink: str, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None, once: bool = True) -> StreamingQuery:
    """Decodes each micro-batch and writes it as sink/batch_id=n, so that a batch that is replayed replaces itself.

    each(detections, batch id) is called as well, after the write.
    """

    def handle(batch: DataFrame, number: int) -> None:
        path = f"{sink}/batch_id={number}"
        decode.detect(batch, config).write.mode("overwrite").parquet(path)
        if each:
            each(batch.sparkSession.read.parquet(path), number)

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def event_counts(events: DataFrame, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Windowed counts of a frame or event stream by type; rows later than `late` are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"))


#: Rows of a head table that one file of replay() holds, about; a task shuffles and writes one file.
ROWS_A_FILE = 500_000


def replay(head: DataFrame, config: InferenceConfig, files: int = 4) -> DataFrame:
    """Runs a head table through detect_stream() and returns what the stream wrote; equal to decode.detect(head).

    The table is counted and written as files of whole images: as many as its rows ask for, `files` at least. They arrive
    in as many micro-batches as `files` says, so that a batch grows with the table and is shared by more tasks.
    """
    from ocellus.sources.sinks import shared_folder

    spark = head.sparkSession
    base = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    parts = max(files, -(-head.count() // ROWS_A_FILE))
    head.repartition(parts, "image_id").write.parquet(f"{base}/in")
    detect_stream(head_stream(spark, f"{base}/in", head.schema, -(-parts // files)), config, f"{base}/out", f"{base}/state").awaitTermination()
    out = spark.read.parquet(f"{base}/out").drop("batch_id").checkpoint(eager=True)
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return out
