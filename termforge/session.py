"""Session set-up and intermediate tables that survive the loss of an executor."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []
_shipped: set[str] = set()
_tables: set[str] = set()


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    """A session for tests and the benchmark; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("termforge")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a folder of our own if all tasks run on this machine, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share: intermediate tables go there")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="termforge-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return _own_dir[0]


def ship(spark: SparkSession) -> None:
    """Sends this package to the session's workers, once, so that they need no installation and no particular working folder."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="termforge-code-")) / "termforge.zip"
    atexit.register(shutil.rmtree, at.parent, ignore_errors=True)
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(at))
    _shipped.add(sc.applicationId)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/termforge/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back: cuts the lineage, and a lost executor loses nothing of it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over at least as many partitions as there are cores, for work that costs far more than a shuffle of its input.

    Only tables of fewer files than cores are moved; larger ones have splits enough.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def external_table(spark: SparkSession, name: str, columns: str, path: str, bucket_by: list[str], buckets: int) -> DataFrame:
    """The bucketed Parquet files under a path as a table of this session's catalogue, which remove_intermediates() drops from it."""
    if name not in _tables:
        by = ", ".join(bucket_by)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
        _tables.add(name)
    return spark.table(name)


def drop_table(spark: SparkSession, name: str) -> None:
    """Forgets a table; its files stay."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    _tables.discard(name)


def remove_intermediates(spark: SparkSession) -> None:
    """Drops every intermediate table under the shared folder, and their entries in the catalogue; call it when no lazy result needs them any more."""
    for name in list(_tables):
        drop_table(spark, name)
    remove(spark, shared_dir(spark) + "/termforge")


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at, jvm


def remove(spark: SparkSession, path: str) -> None:
    """Removes a file or folder of any file system that Spark reads; one that isn't there is no error."""
    fs, at, _ = _fs(spark, path)
    fs.delete(at, True)


def names_in(spark: SparkSession, folder: str) -> list[str]:
    fs, at, _ = _fs(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, at, jvm = _fs(spark, path)
    stream = fs.open(at)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> None:
    """A small file that appears whole under its name or not at all; a FileExistsError if the name is taken."""
    fs, at, jvm = _fs(spark, path)
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex[:8]}.part")
    stream = fs.create(part, True)
    stream.write(text.encode())
    stream.close()
    if fs.exists(at) or not fs.rename(part, at):
        fs.delete(part, False)
        raise FileExistsError(path)


def cpu_count() -> int:
    return int(os.environ.get("BENCH_CPUS", "8"))
