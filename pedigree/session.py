"""Session helpers: a local session for tests and benches, shipping the package to the workers, checkpoints."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cpus: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with adaptive execution and as many shuffle partitions as cores."""
    os.environ["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([ROOT, *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]))
    conf = {"spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": memory, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"}
    return SparkSession.builder.master(f"local[{cpus}]").appName("pedigree").config(map=conf).getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers of this machine import the package; on a cluster it is installed or sent with --py-files."""
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, known]))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (`spark.checkpoint.dir`); only a local session may go without, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder.

    What several branches of a query share is computed once, and a lost executor costs no recomputation.
    """
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
