"""Session settings and the shared scratch folder."""

from __future__ import annotations

import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the folder named by ``spark.checkpoint.dir``.

    A cluster must name a shared folder. Only a local master may fall back to
    a temporary one, since all its tasks run on this machine.
    """
    base = spark.conf.get(CHECKPOINT_KEY, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="alertmill-")
        spark.conf.set(CHECKPOINT_KEY, base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str = "settled") -> DataFrame:
    """Write ``df`` once to the scratch folder and read it back.

    Cuts the lineage, so that values which may change when a task is run
    again (range bounds, seeded draws) are fixed for every later reader, and
    so that loops do not grow their plan.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Needed where it is not installed on the executors.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = pathlib.Path(__file__).resolve().parent
    target = pathlib.Path(tempfile.mkdtemp(prefix="alertmill-package-")) / "alertmill.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)
