"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

_local_base: dict[str, str] = {}


def build_session(app: str = "tripmart", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job here assumes; `conf` overrides (dots as `__`)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "static",
        # Generated methods above 8 kB of bytecode are never compiled by the JVM; wide rows run faster split.
        "spark.sql.codegen.hugeMethodLimit": "8000",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared folder that the cluster names.

    Written tables cut lineage here, so the folder must outlive an executor. Without the setting only
    local mode may fall back to a temporary folder of this machine.
    """
    base = spark.conf.get(CHECKPOINT_CONF, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local_base:
            _local_base[app] = tempfile.mkdtemp(prefix="tripmart-", dir="/tmp")
        base = _local_base[app]
    return f"{base.rstrip('/')}/tripmart/{name}-{uuid.uuid4().hex[:12]}"
