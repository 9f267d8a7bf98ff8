"""Session helpers: making the package importable on executors, and the shared folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_LOCAL: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="loomtext-ship-")
    atexit.register(shutil.rmtree, folder, True)
    archive = os.path.join(folder, "loomtext.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder is made for local masters; on a
    cluster an unset folder is an error, for no machine-local folder would do.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(folder)
        return folder
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _LOCAL:
        made = tempfile.mkdtemp(prefix="loomtext-shared-")
        atexit.register(shutil.rmtree, made, True)
        sc.setCheckpointDir(made)
        _LOCAL[sc.applicationId] = "file://" + made
    return _LOCAL[sc.applicationId]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    if path.startswith("file:"):
        shutil.rmtree(path[5:].replace("//", "/", 1), ignore_errors=True)
    else:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended; whoever owns the folder clears it
            return


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it again.

    This cuts the lineage and, other than ``checkpoint()``, computes the rows
    only once; a lost executor costs nothing that was written.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
