"""Session, table access and lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: Folder of the vocabulary files, read on the driver only.
TOKENIZERS = os.environ.get("CORPUSMILL_TOKENIZERS", "/opt/tokenizers")

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once an application."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="corpusmill-ship-")  # served from there for as long as the application runs
        atexit.register(shutil.rmtree, folder, True)
        shutil.copytree(root, Path(folder, "in", root.name), ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(os.path.join(folder, f"{root.name}-{uuid.uuid4().hex[:8]}"), "zip", Path(folder, "in")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Only where nothing is set (tests on one machine) a temporary folder takes its place.
    """
    sc = spark.sparkContext
    given = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        given = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(given)
    return given.rstrip("/")


_folders: set[str] = set()


def own_folder(spark: SparkSession) -> str:
    """The application's part of the shared folder; removed when the driver ends."""
    folder = f"{shared_folder(spark)}/corpusmill/{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_remove, spark, folder)
    return folder


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone; the folder is then left to its owner
        pass


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes df as Parquet into the shared folder and reads it again.

    Unlike a cached table it outlives lost executors, and unlike checkpoint() it is
    compressed and columnar.
    """
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Removes the files of a table made by written(), once nothing reads it any more."""
    spark = df.sparkSession
    own = own_folder(spark)
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if own.split(":", 1)[-1].lstrip("/") in folder:
            _remove(spark, folder)
