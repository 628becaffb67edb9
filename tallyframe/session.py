"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every session of this library wants. Shuffle partitions are left to
# adaptive execution: the initial number is generous and small ones are merged.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Expressions over many columns are built call by call; do not record a stack trace for each.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # The JVM never compiles methods above 8000 bytes of bytecode. Cleaning many columns makes
    # such methods when fused into one stage; below the limit Spark splits them instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(app: str = "tallyframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = DEFAULTS | {k.replace("__", "."): str(v) for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session. Only a local-mode session
    without that setting falls back to a temporary folder of the machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="tallyframe-")
    return f"{base.rstrip('/')}/tallyframe/{name}-{uuid.uuid4().hex}"
