"""The folder for tables between steps: one that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_roots: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session. Unset, a folder of our own will do only where driver and executors are one process, as in tests; a cluster is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = f"local-{spark.sparkContext.applicationId}"
    if app not in _roots:
        folder = tempfile.mkdtemp(prefix="braidwork-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _roots[app] = f"file://{folder}"
    return _roots[app]


def root(spark: SparkSession) -> str:
    """The application's own folder in the shared one; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/braidwork-{spark.sparkContext.applicationId}"
    if path not in _roots:
        _roots[path] = path
        atexit.register(_forget, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path)
    return path


def _forget(jvm, conf, path: str) -> None:
    try:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    except Exception:  # the JVM may have ended before: then there is no one to delete it
        return


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the application's folder that nothing else has: the name, with something of its own before the extension."""
    stem, dot, ext = name.partition(".")
    return f"{root(spark)}/{stem}-{uuid.uuid4().hex}{dot}{ext}"
