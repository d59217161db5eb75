"""Tables written to the folder that driver and executors share, to end a lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder is set only where there is none and all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="sparkwhy-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_paths: dict[str, SparkSession] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    """A name in the shared folder that nothing has yet; what is written there is deleted as ``written`` tables are."""
    path = f"{shared_folder(spark)}/sparkwhy-{name}-{uuid.uuid4().hex}"
    _paths[path] = spark
    return path


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """The same rows read back from Parquet: stable against recomputation and lost executors.

    What nothing discards is deleted when the process ends.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(path: str) -> None:
    spark = _paths.pop(path, None)
    if spark is not None:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Delete the tables from ``written`` that a table reads."""
    folders = {f.rpartition("/")[0] for f in df.inputFiles()}
    for path in [p for p in _paths if any(f.endswith(p.rpartition("/")[2]) for f in folders)]:
        _delete(path)


@atexit.register
def discard_all() -> None:
    """Delete every table that is still there; results that read them must be consumed before."""
    for path in list(_paths):
        try:
            _delete(path)
        except Exception:  # noqa: BLE001  the session may be gone
            _paths.pop(path, None)
