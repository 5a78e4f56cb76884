"""Making a session ready: executors get this package, whatever their working folder holds, and Arrow batches a size
that bounds a Python worker's memory even where texts are long.  And staged tables: what is read more than once is
written as Parquet into the folder that all executors share, so a lost executor costs a re-read only."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SENT: set[str] = set()
_STAGED: dict[str, set[str]] = {}
#: Rows and bytes that a Python worker gets at a time.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def ship(spark: SparkSession) -> None:
    """Send the package to the executors of this application and bound the session's Arrow batches, once: what a caller
    sets later stays."""
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    for key, value in ARROW.items():
        spark.conf.set(key, value)
    home = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="lodestead-")) / "lodestead.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    spark.sparkContext.addPyFile(str(to))
    _SENT.add(app)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the session.  Where none is named, a local master (tests) gets a temporary one; a cluster is
    refused, as its executors would each write to a folder of their own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if not held:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestead-"))
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


def stage(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and return (the table read back, its path)."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/lodestead-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return spark.read.schema(df.schema).parquet(path), path


def unstage(spark: SparkSession, path: str) -> None:
    """Delete a staged table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _STAGED.get(spark.sparkContext.applicationId, set()).discard(path)


def release(spark: SparkSession, since: frozenset[str] = frozenset()) -> None:
    """Delete all staged tables but those of ``since``: for callers whose results are written."""
    for path in staged(spark) - since:
        unstage(spark, path)


def settle(spark: SparkSession) -> None:
    """Have all JVMs collect, between steps: a heap keeps the size that a finished step made it grow to, and would hold it
    beside what the next one and its Python workers need; and shuffle files stay until the driver finds them unused.  As
    many tasks as cores, at a time, so that each executor gets some; with DisableExplicitGC nothing happens."""
    context, n = spark.sparkContext, 1
    if not context.master.startswith("local[") and context.master != "local":
        context._jvm.System.gc()
        n = context.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


def staged(spark: SparkSession) -> frozenset[str]:
    """Paths of the tables staged by this application and not deleted yet."""
    return frozenset(_STAGED.get(spark.sparkContext.applicationId, ()))
