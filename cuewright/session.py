"""What every query needs of its session: the tables, the code on the executors, a place to cut lineage."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables; a Parquet file or a folder of them."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers (once a context).

    Executors of a cluster need not have the repository; the zip goes out through Spark's own file server.
    """
    sc = spark.sparkContext
    if getattr(sc, "_cuewright_shipped", False):
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, f"{_PACKAGE.name}/{p.relative_to(_PACKAGE).as_posix()}")
    folder = tempfile.mkdtemp(prefix="cuewright")
    path = os.path.join(folder, "cuewright_code.zip")
    Path(path).write_bytes(data.getvalue())
    sc.addPyFile(path)
    sc._cuewright_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate results that all machines see: the session's spark.checkpoint.dir.

    On one machine (a local master), where that is unset, a temporary folder of our own that goes with the process; on a cluster there is no such folder, and this raises.
    What is cut there can be deleted by Spark itself (spark.cleaner.referenceTracking.cleanCheckpoints) or with the folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = sc.getConf().get("spark.checkpoint.dir")
        if given is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all machines share")
            given = tempfile.mkdtemp(prefix="cuewright-checkpoint")
            atexit.register(shutil.rmtree, given, ignore_errors=True)
        sc.setCheckpointDir(given)
    return sc.getCheckpointDir()


def scratch(spark: SparkSession) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the folder the cluster shares."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
