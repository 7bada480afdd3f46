"""Session settings and durable cut points for long lineages."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path
from weakref import WeakSet

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SHIPPED: WeakSet = WeakSet()  # contexts whose workers got the package

# Settings that suit both a laptop run and a cluster. Parallelism, memory and the
# broadcast limit are left to the cluster; AQE sizes the shuffles at run time.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app_name: str = "ruleharbor", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**DEFAULTS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster or the session names for data that outlives executors.

    Without one a local session gets a new temporary folder, and a cluster is asked to name one.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get(CHECKPOINT_KEY, None)
        if folder is None:
            if context.master != "local" and not context.master.startswith("local["):
                raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written rows.

    A lost executor then costs no more than the step at work. Shuffle files of the steps before are not needed any more
    and go at once. Spark removes the written files when the frame is no longer used
    (``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    shared_folder(df.sparkSession)
    settings = df.sparkSession.conf
    before = settings.get(CLEANUP_KEY, None)
    settings.set(CLEANUP_KEY, "true")
    try:
        once = df.select("*")  # a frame takes up the setting when it is made; this one runs only here
    finally:
        if before is None:
            settings.unset(CLEANUP_KEY)
        else:
            settings.set(CLEANUP_KEY, before)
    return once.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package where they would not find it by themselves, once per context.

    An installed package, one on ``PYTHONPATH`` and one in the working folder of a local session are found.
    """
    root = Path(__file__).resolve().parents[1]
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    context = spark.sparkContext
    if root.name in ("site-packages", "dist-packages") or str(root) in known or context in _SHIPPED:
        return
    packed = Path(tempfile.mkdtemp(prefix="package-")) / "ruleharbor.zip"
    with zipfile.ZipFile(packed, "w") as archive:
        for module in sorted((root / "ruleharbor").rglob("*.py")):
            archive.write(module, module.relative_to(root))
    context.addPyFile(str(packed))
    _SHIPPED.add(context)
