"""Session helpers: reading tables, spreading small scans, cutting lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan with at least one partition per core, if it is far from that.

    A small file is one input split, so everything up to the first shuffle
    would run in one task. Scans that fill a quarter of the cores stay as they
    are: moving all their rows would cost more than idle cores do.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if 4 * scan.rdd.getNumPartitions() > cores else scan.repartition(cores)


def by_key(scan: DataFrame, key: str) -> DataFrame:
    """``scan`` dealt by ``key`` in one shuffle that later groupings and windows by it share; rows of one key are re-deliveries and become one."""
    spark = scan.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return scan.repartition(parts, key).dropDuplicates([key])


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where it is unset a temporary folder serves, but only in a local session:
    on a cluster a machine-local folder would lose data with its executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="scriven-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: its lineage is cut.

    Unlike a cached plan the table survives the loss of executors, and unlike
    an RDD checkpoint it is columnar, compressed and computed once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _STORED.append(path)
    # shuffle files stay until the driver collects what they were for
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


_STORED: list[str] = []


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        _STORED.remove(path)


def drop(table: DataFrame) -> None:
    """Removes the files of a stored table that nothing reads any more."""
    names = {p.rsplit("/", 2)[-2] for p in table.inputFiles()}
    _remove(table.sparkSession, [p for p in _STORED if p.rsplit("/", 1)[-1] in names])


def alone(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, stored; tables that it stores on the way are removed, so nothing else may read them."""
    before = len(_STORED)
    out = stored(make())
    _remove(spark, _STORED[before:-1])
    return out


def clean(spark: SparkSession) -> int:
    """Removes the tables that this program has stored so far; their number. Results that were not read yet are lost."""
    for path in _STORED:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    n = len(_STORED)
    _STORED.clear()
    return n


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that its functions can be loaded there."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="scriven-")) / f"{package.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(path))
    _SHIPPED.add(context.applicationId)
