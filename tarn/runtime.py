"""Getting this package to the executors, and tables to the folder that all of them share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()

#: Bytes of an Arrow batch between the JVM and a Python worker; both ends hold a batch or two, for each running task.
BATCH_BYTES = "8m"


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers of ``spark``, once for each application, so that they need no copy of their own.

    It also bounds the session's Arrow batches by ``BATCH_BYTES``, unless the session already asks for smaller ones than Spark's default.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, "67108864b") in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(name, BATCH_BYTES)
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(), "tarn.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(here)))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` as the session names it. Where it names none, one of this machine if all runs on it, as in tests; on a cluster it raises."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), "tarn-checkpoints")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: its lineage is cut, and what is used twice is made once."""
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
