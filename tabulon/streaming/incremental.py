"""Incremental batches: what is there is read once as a stream and merged by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.session import checkpoint, shared_folder
from tabulon.sources.sinks import latest


def merged(spark: SparkSession, path: str, key: str, order: str, files: int = 16) -> DataFrame:
    """The last row of each key of the parquet files at path, read as a stream of so many files a batch.

    Each batch is reduced to the last row of each of its keys and written under its number, so that one that is run
    again replaces itself; a reader takes the last row of each key of all batches. The result is cut from the batches
    by a checkpoint, after which their folder is removed.
    """
    folder = shared_folder(spark, "stream")
    try:
        advance(spark, path, folder, files, key, order)
        return checkpoint(latest(spark.read.parquet(f"{folder}/batches").drop("batch"), key, order))
    finally:
        drop(spark, folder)


def advance(spark: SparkSession, path: str, folder: str, files: int = 16, key: str | None = None, order: str | None = None) -> None:
    """Read what has come to path since the last call and store it by batch, with a key only its last rows. The position is kept in the folder, so a later call goes on."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    # A stream reads folders; one file is the only one of its name in its folder.
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    alone = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile()
    stream = reader.option("pathGlobFilter", where.getName()).parquet(path.rpartition("/")[0]) if alone else reader.parquet(path)

    def store(batch: DataFrame, number: int) -> None:
        rows = latest(batch, key, order) if key and order else batch
        rows.write.mode("overwrite").parquet(f"{folder}/batches/batch={number}")

    run = stream.writeStream.foreachBatch(store).option("checkpointLocation", f"{folder}/position").trigger(availableNow=True).start()
    run.awaitTermination()


def windowed_counts(events: DataFrame, time: str, key: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts by key and window of time, rows later than `late` left out; for streams and batches alike."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select("w.start", "w.end", key, "n")


def drop(spark: SparkSession, folder: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
