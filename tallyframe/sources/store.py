"""Stored datasets: clean and quarantined rows, their resolutions and the catalog.

Layout under one root folder (all Parquet)::

    <root>/data/<dataset>/records/load=<id>/_valid=true|false   rows of one load, written in one pass
    <root>/data/<dataset>/resolutions-<first load>              what happened to quarantined rows
    <root>/catalog                                              one entry per change of a dataset
    <root>/edges                                                relationships, one set per change

The newest entry of a dataset is its catalog row. It names the loads that count, each with the types it
was stored with. A load is there from the moment its entry is written: one that died before is not
seen, and a run under the same ``load_id`` overwrites it. ``replace`` writes the new rows beside the old
ones and then switches. A change of a quarantined row is appended to its resolutions. A job that is run
again after a failure therefore adds nothing twice and loses nothing.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ..operators.columns import ColumnMeta, columns_from_json, columns_to_json, spark_type
from ..operators.dedupe import insert_idempotent
from ..operators.validate import (
    ERRORS, HISTORY, QUARANTINED, ROW_NUMBER, SOURCE_FILE, SYSTEM_COLUMNS, annotate, clean_part, to_quarantine,
)
from .csv import FIRST_DATA_ROW, compare_append_columns, unique_row_id

MODES = ("new", "replace", "append")
CATALOG_SCHEMA = (
    "dataset string, name string, mode string, columns string, row_count long, quarantined_count long, "
    "deleted boolean, changed_at timestamp, created_at timestamp, "
    "loads array<struct<id:string,columns:string>>"
)
EDGE_SCHEMA = ("from_dataset string, from_column string, to_dataset string, to_column string, "
               "confidence double, source string")
RESOLUTION_SCHEMA = "row_number long, status string, action string, at timestamp, user string"


@dataclass(frozen=True)
class IngestReport:
    """Counters of one load, observed while it was written."""

    rows_seen: int
    rows_valid: int
    rows_quarantined: int


class AppendRefused(ValueError):
    """The columns of an append differ from the stored ones; ``comparison`` says how."""

    def __init__(self, dataset: str, comparison: dict):
        super().__init__(f"columns of {dataset!r} do not fit: missing {comparison['missing_columns']}, "
                         f"unexpected {comparison['unexpected_columns']}")
        self.comparison = comparison


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def delete_path(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


class Store:
    """Datasets under one shared folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, dataset: str, part: str) -> str:
        return f"{self.root}/data/{dataset}/{part}"

    # --- rows ----------------------------------------------------------------

    def _records_schema(self, schema: list[ColumnMeta]) -> str:
        cols = [f"`{c.name}` {spark_type(c).simpleString()}" for c in schema]
        return ", ".join([f"{ROW_NUMBER} long", f"{SOURCE_FILE} string", *cols, "_raw map<string,string>",
                          f"_errors {ERRORS}", "_warnings array<string>", "_structural boolean", "_valid boolean"])

    def _loads(self, dataset: str) -> list[dict]:
        entry = self.entry(dataset)
        return [x.asDict() for x in (entry or {}).get("loads") or ()]

    def records(self, dataset: str, schema: list[ColumnMeta] | None = None) -> DataFrame:
        """All rows of the loads that count, clean and quarantined. Loads are read with the types they were
        stored with and cast to the dataset's present ones; a value that does not cast is null."""
        schema, loads = schema or self.columns(dataset), self._loads(dataset)
        base, out = self._path(dataset, "records"), None
        for stored in dict.fromkeys(x["columns"] for x in loads):
            own = columns_from_json(stored)
            paths = [f"{base}/load={x['id']}" for x in loads if x["columns"] == stored]
            df = self.spark.read.option("basePath", base).schema(self._records_schema(own)).parquet(*paths)
            types = {c.name: spark_type(c) for c in own}
            cells = [(F.col(f"`{c.name}`") if types.get(c.name) == spark_type(c) else
                      F.col(f"`{c.name}`").try_cast(spark_type(c)) if c.name in types else
                      F.lit(None).cast(spark_type(c))).alias(c.name) for c in schema]
            part = df.select(ROW_NUMBER, SOURCE_FILE, *cells, "_raw", "_errors", "_warnings", "_structural", "_valid")
            out = part if out is None else out.unionByName(part)
        return out if out is not None else self.spark.createDataFrame([], self._records_schema(schema))

    def load_dataset(self, dataset: str) -> DataFrame:
        """Clean rows of a dataset; only their partition is read."""
        return clean_part(self.records(dataset))

    def _resolutions_path(self, dataset: str) -> str:
        loads = self._loads(dataset)
        return self._path(dataset, f"resolutions-{loads[0]['id'] if loads else 'none'}")

    def resolutions(self, dataset: str) -> DataFrame:
        path = self._resolutions_path(dataset)
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], RESOLUTION_SCHEMA)
        return self.spark.read.schema(RESOLUTION_SCHEMA).parquet(path)

    def load_quarantine(self, dataset: str) -> DataFrame:
        """Quarantine records with their present status and history."""
        q = to_quarantine(self.records(dataset), dataset)
        done = self.resolutions(dataset).groupBy("row_number").agg(
            F.max_by("status", "at").alias("__status"),
            F.sort_array(F.collect_list(F.struct("at", "action", "user"))).alias("__history"))
        history = F.transform("__history", lambda h: F.struct(h["action"].alias("action"), h["at"].alias("at"),
                                                              h["user"].alias("user"))).cast(HISTORY)
        return (q.join(done, "row_number", "left")
                .withColumn("status", F.coalesce("__status", "status"))
                .withColumn("history", F.coalesce(history, F.col("history")))
                .select(*q.columns))

    def append_resolutions(self, dataset: str, rows: DataFrame, status: str, action: str,
                           user: str = "system") -> None:
        """Record that the rows (by ``row_number``) took a new status."""
        (rows.select("row_number", F.lit(status).alias("status"), F.lit(action).alias("action"),
                     F.current_timestamp().alias("at"), F.lit(user).alias("user"))
         .write.mode("append").parquet(self._resolutions_path(dataset)))

    def append_clean(self, dataset: str, rows: DataFrame) -> None:
        """Add clean rows; numbers already stored as clean are left out. ``recount`` shows them."""
        have = self.records(dataset).filter(F.col("_valid")).select(ROW_NUMBER)
        new = insert_idempotent(rows, have, [ROW_NUMBER])
        entry, load = self.entry(dataset), f"restored-{uuid.uuid4().hex}"
        (new.withColumn("_raw", F.lit(None).cast("map<string,string>"))
         .withColumn("_errors", F.array().cast(ERRORS)).withColumn("_warnings", F.array().cast("array<string>"))
         .withColumn("_structural", F.lit(False)).withColumn("_valid", F.lit(True))
         .write.partitionBy("_valid").parquet(self._path(dataset, f"records/load={load}")))
        self._update(entry, loads=[*self._loads(dataset), {"id": load, "columns": entry["columns"]}])

    def next_row_base(self, dataset: str, schema: list[ColumnMeta]) -> int:
        """Highest row number in use, over clean and quarantined rows."""
        return self.records(dataset, schema).agg(F.max(ROW_NUMBER)).first()[0] or 0

    def write_dataset(self, dataset: str, raw: DataFrame, schema: list[ColumnMeta] | None = None,
                      mode: str = "new", name: str | None = None, load_id: str | None = None) -> IngestReport:
        """Clean, validate and store a raw text frame; both halves in one pass.

        new: fails when the dataset exists. replace: drops the old rows once the new ones are stored.
        append: refuses other columns than the stored ones (``AppendRefused`` has the comparison) and
        numbers the rows after the last stored one. A frame without row numbers gets unique ones, so that its
        quarantined rows can be found and restored. A ``load_id`` makes a run repeatable: a load that is
        there already is reported and not written again.
        """
        if mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        entry, old = self.entry(dataset), self._loads(dataset)
        if load_id and any(x["id"] == load_id for x in old):
            return self._report(dataset, load_id)
        if mode == "new" and entry is not None:
            raise ValueError(f"dataset {dataset!r} exists")
        if mode == "append" and entry is None:
            raise ValueError(f"dataset {dataset!r} does not exist")
        if ROW_NUMBER not in raw.columns:
            raw = unique_row_id(raw, FIRST_DATA_ROW - 1)
        if mode == "append":
            schema = columns_from_json(entry["columns"])
            compared = compare_append_columns(schema, [c for c in raw.columns if c not in SYSTEM_COLUMNS])
            if not compared["is_match"]:
                raise AppendRefused(dataset, compared)
            raw = raw.withColumn(ROW_NUMBER, F.col(ROW_NUMBER) + F.lit(self.next_row_base(dataset, schema)))
        if not schema:
            raise ValueError("a schema is needed")
        absent = {c.name.lower() for c in schema} - {c.lower() for c in raw.columns}
        raw = raw.withColumns({c.name: F.lit(None).cast("string") for c in schema if c.name.lower() in absent})
        load = load_id or uuid.uuid4().hex
        seen = Observation(f"ingest {dataset}")
        rows = annotate(raw, schema).observe(
            seen, F.count(F.lit(1)).alias("seen"), F.count_if(F.col("_valid")).alias("valid"))
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("_valid")
         .parquet(self._path(dataset, f"records/load={load}")))
        counts = seen.get
        report = IngestReport(counts["seen"], counts["valid"], counts["seen"] - counts["valid"])
        before = (entry["row_count"], entry["quarantined_count"]) if mode == "append" else (0, 0)
        kept = old if mode == "append" else []
        self.update_catalog(dataset, name=name or (entry or {}).get("name") or dataset, mode=mode, columns=schema,
                            row_count=before[0] + report.rows_valid,
                            quarantined_count=before[1] + report.rows_quarantined,
                            created_at=(entry or {}).get("created_at"),
                            loads=[*kept, {"id": load, "columns": columns_to_json(schema)}])
        if mode == "replace":  # no entry names them any more
            for x in old:
                delete_path(self.spark, self._path(dataset, f"records/load={x['id']}"))
        return report

    def _report(self, dataset: str, load_id: str) -> IngestReport:
        """Counters of a load that is stored already."""
        base = self._path(dataset, "records")
        rows = self.spark.read.option("basePath", base).schema("_valid boolean").parquet(f"{base}/load={load_id}")
        n = rows.agg(F.count(F.lit(1)).alias("seen"), F.count_if("_valid").alias("valid")).first()
        return IngestReport(n["seen"], n["valid"], n["seen"] - n["valid"])

    # --- catalog -------------------------------------------------------------

    def _log(self) -> DataFrame:
        path = f"{self.root}/catalog"
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], CATALOG_SCHEMA)
        return self.spark.read.schema(CATALOG_SCHEMA).parquet(path)

    def catalog(self) -> DataFrame:
        """One row per dataset: its newest entry."""
        log = self._log()
        newest = log.groupBy("dataset").agg(F.max_by(F.struct(*log.columns), "changed_at").alias("e"))
        return newest.select("e.*").filter(~F.col("deleted")).drop("deleted")

    def entry(self, dataset: str) -> dict | None:
        row = self.catalog().filter(F.col("dataset") == dataset).first()
        return row.asDict() if row else None

    def columns(self, dataset: str) -> list[ColumnMeta]:
        entry = self.entry(dataset)
        return columns_from_json(entry["columns"]) if entry else []

    def update_catalog(self, dataset: str, *, name: str, mode: str, columns: list[ColumnMeta],
                       row_count: int, quarantined_count: int, deleted: bool = False,
                       created_at: datetime | None = None, loads: list[dict] = ()) -> None:
        """Append the dataset's new entry; ``created_at`` is that of its first one."""
        now = F.current_timestamp()
        values: dict[str, Column] = {
            "dataset": F.lit(dataset), "name": F.lit(name), "mode": F.lit(mode),
            "columns": F.lit(columns_to_json(columns)), "row_count": F.lit(int(row_count)).cast("long"),
            "quarantined_count": F.lit(max(0, int(quarantined_count))).cast("long"), "deleted": F.lit(deleted),
            "changed_at": now, "created_at": F.lit(created_at) if created_at else now,
            "loads": F.array(*(F.struct(F.lit(x["id"]).alias("id"), F.lit(x["columns"]).alias("columns")) for x in loads))
                      .cast("array<struct<id:string,columns:string>>"),
        }
        (self.spark.range(1).select(*(c.alias(n) for n, c in values.items())).coalesce(1)
         .write.mode("append").parquet(f"{self.root}/catalog"))

    def _update(self, entry: dict, **changes) -> None:
        """A new entry that differs from the given one in some values."""
        values = {"name": entry["name"], "mode": entry["mode"], "columns": columns_from_json(entry["columns"]),
                  "row_count": entry["row_count"], "quarantined_count": entry["quarantined_count"],
                  "created_at": entry["created_at"], "loads": [x.asDict() for x in entry["loads"] or ()]}
        self.update_catalog(entry["dataset"], **values | changes)

    def recount(self, dataset: str) -> dict:
        """Row counts from the stored rows, written to the catalog."""
        rows = self.load_dataset(dataset).count()
        left = self.load_quarantine(dataset).filter(F.col("status") == QUARANTINED).count()
        self._update(self.entry(dataset), row_count=rows, quarantined_count=left)
        return {"row_count": rows, "quarantined_count": left}

    def set_columns(self, dataset: str, columns: list[ColumnMeta]) -> None:
        """Change the stored metadata only. Rows stay as they were stored and are cast when they are read."""
        self._update(self.entry(dataset), columns=columns)

    def drop_datasets(self, datasets: list[str]) -> dict:
        """Remove datasets with their rows; reports how many were there."""
        present = [d for d in dict.fromkeys(datasets) if self.entry(d) is not None]
        for d in present:
            e = self.entry(d)
            delete_path(self.spark, f"{self.root}/data/{d}")
            self.update_catalog(d, name=e["name"], mode=e["mode"], columns=[], row_count=0,
                                quarantined_count=0, deleted=True, created_at=e["created_at"])
        return {"requested_count": len(datasets), "deleted_count": len(present)}

    # --- relationships -------------------------------------------------------

    def edges(self) -> DataFrame:
        path = f"{self.root}/edges"
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], EDGE_SCHEMA)
        log = self.spark.read.schema(EDGE_SCHEMA + ", version long").parquet(path)
        newest = log.agg(F.max("version")).first()[0]
        return log.filter((F.col("version") == newest) & F.col("from_dataset").isNotNull()).drop("version")

    def save_edges(self, edges: DataFrame) -> None:
        """Store the given set of relationships as the newest one."""
        path = f"{self.root}/edges"
        last = 0
        if path_exists(self.spark, path):
            last = self.spark.read.parquet(path).agg(F.max("version")).first()[0] or 0
        marker = self.spark.createDataFrame([(None,) * 6], EDGE_SCHEMA)  # keeps an empty set readable
        (edges.select(*marker.columns).union(marker).withColumn("version", F.lit(last + 1).cast("long"))
         .coalesce(1).write.mode("append").partitionBy("version").parquet(path))
