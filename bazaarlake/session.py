"""Session helpers: the shared checkpoint folder and shipping of this package to the executors."""

from __future__ import annotations

import atexit
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PACKAGE = Path(__file__).resolve().parent
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes the package importable by the Python workers of every executor; once per application.

    On a cluster it goes as an archive through the shared folder. Also sets the session's zone to UTC, in which
    all times of the tables are meant.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    if sc.master.startswith("local["):
        return  # the workers of a local session see the driver's files
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, f"{_PACKAGE.name}/{p.relative_to(_PACKAGE)}")
    path = f"{checkpoint_dir(spark)}/{_PACKAGE.name}-{uuid.uuid4().hex}.zip"
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(archive.getvalue()))
    out.close()
    sc.addPyFile(path)
    remove_at_exit(spark, path)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder shared by all executors, from the session. Only a local session without one gets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="bazaarlake-checkpoint-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and goes on from there, so that a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the shared folder and read again: narrower on disk than a checkpoint.

    The table is removed when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/bazaarlake-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared folder when the driver's process ends."""
    atexit.register(_remove, spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended already; the cluster clears its folder
        pass


#: Rows and bytes up to which a side of a join is sent to all tasks.
SMALL, SMALL_BYTES = 20_000, 8 << 20


def small(df: DataFrame, rows: int = SMALL, size: int = SMALL_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows and ``size`` bytes, else as it is, for a shuffle.

    Rows are counted and the bytes of their text form are summed over as many rows as may be sent, in one pass.
    """
    width = F.octet_length(F.to_csv(F.struct(*(F.col(f"`{c}`").cast("string") for c in df.columns)))) if df.columns else F.lit(0)
    counted = df.limit(rows + 1).select(F.coalesce(width, F.lit(0)).cast("bigint").alias("w")).agg(F.count(F.lit(1)), F.coalesce(F.sum("w"), F.lit(0))).first()
    return F.broadcast(df) if counted[0] <= rows and counted[1] <= size else df
