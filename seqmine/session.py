"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
import zipfile

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.checkpoint.compress": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def builder(app: str = "seqmine") -> SparkSession.Builder:
    b = SparkSession.builder.appName(app)
    for key, value in RECOMMENDED.items():
        b = b.config(key, value)
    return b


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a
    machine-local folder would be lost with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="seqmine-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def ship(spark: SparkSession) -> str:
    """Gives the package to the Python workers of a session whose machines do not have it installed.

    The source files go as one archive into the shared folder, from where the workers import it; workers that start later or again
    get it too.  Call it before the first query that runs Python.  Repeated calls in one application ship nothing again.
    """
    context = spark.sparkContext
    known = [f for f in context._python_includes if f.startswith("seqmine-package-")]
    if known:
        return known[0]
    here = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, files in os.walk(here):
            for name in sorted(files):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("seqmine", os.path.relpath(path, here)))
    path = scratch_path(spark, "seqmine-package") + ".zip"
    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    system.create_dir(os.path.dirname(inner), recursive=True)
    with system.open_output_stream(inner) as out:
        out.write(packed.getvalue())
    context.addPyFile(path)
    return os.path.basename(path)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from there.

    Used where an intermediate table feeds several consumers or a loop, so its
    lineage is neither recomputed nor lost with an executor.
    """
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
