"""Where operators keep intermediate tables, how they cut lineage, and how one of several writers wins.

Every intermediate goes to the shared folder named by ``spark.checkpoint.dir`` so that the loss of
an executor never loses data. Only where that setting is absent (local tests) a folder of our own is used.
Intermediates are removed when the driver ends; results are lazy and need them until then.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; one of our own for local masters without the setting."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.getCheckpointDir():
        return spark.sparkContext.getCheckpointDir()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        folder = tempfile.mkdtemp(prefix="pathweave-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _OWN[app] = "file://" + folder
    return _OWN[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/pathweave/{name}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(_clean)
    _MADE.append(path)
    return path


def _clean() -> None:
    sc = SparkContext._active_spark_context
    if sc is not None and sc._jsc is not None:
        try:
            clean(SparkSession(sc))
        except Exception:  # the JVM is gone: nothing more can be done here
            pass


def clean(spark: SparkSession) -> None:
    """Removes all intermediates; results that were not read until now are lost."""
    while _MADE:
        remove(spark, _MADE.pop())


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends here and sizes are known."""
    spark = df.sparkSession
    path = path or scratch(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fs(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as an object of that file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    system, p = fs(spark, path)
    system.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str:
    system, p = fs(spark, path)
    stream = system.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a small file, whole or not at all; False if it exists already. Of several writers exactly one gets True.

    On POSIX file systems a link to a draft, which fails where the name is taken (a rename would overwrite); on HDFS a rename, which fails there; on
    object stores a conditional creation.
    """
    system, final = fs(spark, path)
    scheme = system.getUri().getScheme()
    system.mkdirs(final.getParent())
    draft_path = f"{path}.{uuid.uuid4().hex}.draft"
    if scheme == "file":
        local = urlparse(path).path if path.startswith("file:") else path
        draft = urlparse(draft_path).path if path.startswith("file:") else draft_path
        with open(draft, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(draft, local)
        except FileExistsError:
            return False
        finally:
            os.remove(draft)
        return True
    if scheme in ("hdfs", "viewfs", "webhdfs"):
        _, draft = fs(spark, draft_path)
        _write(system.create(draft, False), text)
        if system.rename(draft, final):
            return True
        system.delete(draft, False)
        return False
    if system.exists(final):
        return False
    _write(system.create(final, False), text)
    return True


def _write(stream, text: str) -> None:
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
