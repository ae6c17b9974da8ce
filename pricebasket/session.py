"""What a session needs for this package: its sources in Python workers, and tables in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_LOCAL: dict[str, str] = {}
_RUN: ContextVar[str | None] = ContextVar("run", default=None)


def ship_package(spark: SparkSession) -> None:
    """Sends this package's sources to the executors, once a Spark application, so that workers can import it wherever they run."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="package-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session names it. Where it names none: a new one if all run
    in one process (local runs, tests), else the warehouse if that is in a store, else an error."""
    context, found = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if not found and re.match(r"local(\[|$)", context.master):
        if context.applicationId not in _LOCAL:
            _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        found = _LOCAL[context.applicationId]
    elif not found:
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
        if urlparse(found).scheme in ("", "file"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A path of its own in the shared folder, or in that of the run it belongs to."""
    return f"{_RUN.get() or shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """What is stored inside goes to one folder, which is deleted at the end, however that comes; frames over it can't be read after."""
    folder = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    token = _RUN.set(folder)
    try:
        yield folder
    finally:
        _RUN.reset(token)
        discard(spark, folder)


def stored(spark: SparkSession, df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read back: the lineage ends here, and a lost executor costs no recomputation."""
    path = new_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a stored table that nothing reads any more, in whatever file system it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
