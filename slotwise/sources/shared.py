"""Tables in the folder that the cluster shares, where lineage is cut."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scopes = threading.local()
_lock, _inside, _before = threading.Lock(), [], []
#: Whether Spark removes the shuffle files of a statement when it ends. Otherwise they stay until
#: the driver's garbage is collected, long after what they led to is in a table.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares for cut lineage: ``spark.checkpoint.dir``.

    Only a local session (tests, one machine) may go without that setting; it then gets a
    temporary folder. On a cluster a missing setting is an error, since executors don't see
    each other's local folders.
    """
    sc = spark.sparkContext
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    own = sc._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="slotwise-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


@contextmanager
def _tidied(spark: SparkSession) -> Iterator[None]:
    """With ``_TIDY`` set; several threads may be within, and the last one out puts it back."""
    with _lock:
        if not _inside:
            _before[:] = [spark.conf.get(_TIDY, None)]
            spark.conf.set(_TIDY, "true")
        _inside.append(1)
    try:
        yield
    finally:
        with _lock:
            _inside.pop()
            if not _inside:
                spark.conf.unset(_TIDY) if _before[0] is None else spark.conf.set(_TIDY, _before[0])


def cut(df: DataFrame, keep: bool = False) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder: lineage ends there, so a
    lost executor costs a reread and not a recomputation. The shuffle files of the writing are
    removed when it ends. ``keep``: beyond the innermost ``scratch``, to the end of the next one."""
    at = f"{shared_dir(df.sparkSession)}/slotwise-{uuid.uuid4().hex}"
    with _tidied(df.sparkSession):
        df.write.parquet(at)
    scopes = getattr(_scopes, "open", [])
    for scope in scopes[-2:-1] if keep else scopes[-1:]:
        scope.append(at)
    found = df.sparkSession.read.schema(df.schema).parquet(at)
    found._cut_at = at
    return found


def drop(df: DataFrame) -> None:
    """Removes the table of a result of ``cut`` that nothing reads any more."""
    _remove(df.sparkSession, df._cut_at)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes, at the end, the tables that this thread has cut within: for a caller that has
    written by then what it computed from them."""
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    _scopes.open.append([])
    try:
        yield
    finally:
        for at in _scopes.open.pop():
            _remove(spark, at)


def _remove(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
