"""Incremental cleaning of monthly raw files with Structured Streaming.

The stream is the list of files that arrive in a landing folder: the file source
notes each path once, in its checkpoint under the shared folder.  Each
micro-batch reads its files with the batch reader, so every file is read by its
own header (other column orders, other spellings, absent calendar columns), and
a file that lacks a required column stops the stream with that file's name; it
is taken up again when the file is mended.  ``availableNow`` processes the
backlog and stops, which is how a monthly schedule runs it.

A micro-batch writes its own folder, ``batch=<n>``, and a repeated one replaces
it, so each file's rows are in the table once.  Pairing stays a batch job over
the clean table or its new months (``operators.append``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from knockon.operators import clean as C
from knockon.sources import files as SRC


def arriving_files(spark: SparkSession, landing: str, max_files_per_trigger: int = 12,
                   glob: str = "*.csv") -> DataFrame:
    """Streaming DataFrame of the paths of files arriving in ``landing``; contents are not read."""
    schema = spark.read.format("binaryFile").load([]).schema
    return (spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob)
            .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files_per_trigger)
            .load(landing).select("path"))


def clean_files(spark: SparkSession, paths: list[str], out_path: str, batch: int) -> None:
    """Clean rows of the files as ``out_path/batch=<n>``, partitioned by year and month."""
    SRC.write_clean(C.clean_flights(SRC.read_month_csv(spark, paths)), f"{out_path.rstrip('/')}/batch={batch}")


def run_clean_ingest(spark: SparkSession, landing: str, out_path: str, checkpoint: str,
                     available_now: bool = True, max_files_per_trigger: int = 12):
    """Append cleaned rows of arriving files to ``out_path`` (Parquet, partitioned by batch, year, month)."""
    def one_batch(files: DataFrame, batch: int) -> None:
        paths = sorted(r.path for r in files.collect())  # at most max_files_per_trigger
        if paths:
            clean_files(files.sparkSession, paths, out_path, batch)

    query = (arriving_files(spark, landing, max_files_per_trigger).writeStream.foreachBatch(one_batch)
             .option("checkpointLocation", checkpoint))
    query = query.trigger(availableNow=True) if available_now else query.trigger(processingTime="1 hour")
    handle = query.start()
    if available_now:
        handle.awaitTermination()
    return handle
