"""Incremental ingest of arriving delimited files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators.columns import ColumnMeta
from ..operators.validate import ROW_NUMBER, SOURCE_FILE, annotate, clean_part, to_quarantine
from ..sources.csv import HeaderDiffers, check_headers, csv_options, text_schema
from ..sources.store import delete_path, path_exists

PROGRESS = "ingest_progress"


class IngestProgress(StreamingQueryListener):
    """Adds up the rows seen, valid and quarantined over all micro-batches.

    Register with ``spark.streams.addListener``.
    """

    def __init__(self):
        self.rows_seen = self.rows_valid = self.batches = 0

    @property
    def rows_quarantined(self) -> int:
        return self.rows_seen - self.rows_valid

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        row = event.progress.observedMetrics.get(PROGRESS)
        if row is not None and row["seen"]:
            self.rows_seen += row["seen"]
            self.rows_valid += row["valid"]
            self.batches += 1

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def stream_ingest(spark: SparkSession, in_dir: str, out_dir: str, schema: list[ColumnMeta],
                  delimiter: str = ",", max_files: int | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Clean and split CSV files as they arrive.

    Every micro-batch writes both halves in one pass to a folder named after the
    batch, and overwrites it when the batch is replayed, so a restart neither
    loses nor repeats rows. Row numbers are unique over all batches: each batch counts on from the last number of
    the batches before it.
    """
    names = [c.name for c in schema]
    # Spark compares headers. Names that may be blank in a file are compared here, one row per file of a batch.
    named = not any(re.fullmatch(r"column_\d+", n) for n in names)
    reader = spark.readStream.options(**csv_options(delimiter), enforceSchema=str(not named).lower()).schema(text_schema(names))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    raw = reader.csv(in_dir).withColumn(SOURCE_FILE, F.col("_metadata.file_path"))
    raw = raw.filter(F.coalesce(*(F.col(f"`{n}`") for n in (*names, "_corrupt_record"))).isNotNull())
    rows = annotate(raw, schema)
    rows = rows.observe(PROGRESS, F.count(F.lit(1)).alias("seen"), F.count_if(F.col("_valid")).alias("valid"))

    def store(batch: DataFrame, batch_id: int) -> None:
        numbers = f"{out_dir}/numbers"
        last = 0
        if batch_id and path_exists(batch.sparkSession, numbers):
            last = (batch.sparkSession.read.schema("last long, batch long").parquet(numbers)
                    .where(F.col("batch") < batch_id).agg(F.max("last")).first()[0]) or 0
        seen = Observation(f"numbers {batch_id}")
        (batch.withColumn(ROW_NUMBER, F.monotonically_increasing_id() + F.lit(last + 1))
         .observe(seen, F.max(ROW_NUMBER).alias("last"))
         .write.mode("overwrite").partitionBy("_valid").parquet(f"{out_dir}/records/batch={batch_id}"))
        if not named:  # from the stored rows: the batch itself is read, and its rows are observed, once
            written = f"{out_dir}/records/batch={batch_id}"
            files = batch.sparkSession.read.schema(f"{SOURCE_FILE} string").parquet(written).distinct().collect()
            try:
                check_headers(batch.sparkSession, [r[0] for r in files], names, delimiter)
            except HeaderDiffers:
                delete_path(batch.sparkSession, written)
                raise
        (batch.sparkSession.range(1).select(F.lit(seen.get["last"] or last).cast("long").alias("last"))
         .write.mode("overwrite").parquet(f"{numbers}/batch={batch_id}"))

    return (rows.writeStream.foreachBatch(store).option("checkpointLocation", f"{out_dir}/_checkpoint")
            .trigger(**(trigger or {"availableNow": True})).start())


def read_ingested(spark: SparkSession, out_dir: str, dataset: str = "") -> tuple[DataFrame, DataFrame]:
    """(clean rows, quarantine records) a stream has stored so far."""
    rows = spark.read.parquet(f"{out_dir}/records").withColumn("_valid", F.col("_valid").cast("boolean"))
    return clean_part(rows), to_quarantine(rows, dataset)
