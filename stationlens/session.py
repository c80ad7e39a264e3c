"""Sessions for local runs, and shipping the package to executors that cannot import it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[1]


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "stationlens", **conf: str) -> SparkSession:
    """A local session with what the engine expects: UTC, AQE, and a state store that keyed streams can use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once a context, unless PYTHONPATH leads them to it already."""
    context = spark.sparkContext
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_stationlens_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="stationlens-code-")
    path = os.path.join(folder, "stationlens_package.zip")
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted((ROOT / "stationlens").rglob("*.py")):
            out.write(source, source.relative_to(ROOT))
    context.addPyFile(path)
    context._stationlens_shipped = True


def work_dir(spark: SparkSession) -> str:
    """The folder that all executors see: the one in ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a folder of its own; on a cluster executors would each write to their own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="stationlens-work-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system; one that is gone already is no error."""
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session is gone: the folder's owner cleans it
        pass


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, so that what follows neither repeats nor loses its lineage."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)
