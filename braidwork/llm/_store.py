"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []
_own: list[str] = []
_open = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset a local session (in tests) has a folder of its own, a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        if not _own:
            _own.append(f"file://{tempfile.mkdtemp(prefix='braidwork-')}")
        folder = _own[0]
    return folder.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Table:
    """A written DataFrame. The files stay until release(), the end of the scratch() it was written in, or that of the driver's Python."""

    def __init__(self, df: DataFrame) -> None:
        self._spark = df.sparkSession
        self.path = f"{shared_folder(self._spark)}/braidwork-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        _written.append(self.path)
        self._schema = df.schema
        if scopes := getattr(_open, "scopes", None):
            scopes[-1].append(self)

    @property
    def df(self) -> DataFrame:
        return self._spark.read.schema(self._schema).parquet(self.path)

    def release(self) -> None:
        if self.path in _written:
            _written.remove(self.path)
            _delete(self._spark, self.path)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """All tables written within are released at its end. What the given function gets is written to a table that outlives it."""
    scopes = _open.__dict__.setdefault("scopes", [])
    own: list[Table] = []
    scopes.append(own)

    def settle(df: DataFrame) -> DataFrame:
        table = Table(df)
        own.remove(table)
        if len(scopes) > 1:
            scopes[-2].append(table)
        return table.df

    try:
        yield settle
    finally:
        scopes.pop()
        for table in own:
            table.release()


def _release_all() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    for path in list(_written):
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone already; the shared folder is then the cluster's to clean
            return
        _written.remove(path)


atexit.register(_release_all)


def write(df: DataFrame) -> DataFrame:
    """df, read from a table in the shared folder."""
    return Table(df).df
