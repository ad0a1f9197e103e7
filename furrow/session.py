"""Session helpers: a sensible local session and a shared scratch location."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Scratch root of a local session that names none, one for each process.
_LOCAL_ROOT: list[str] = []


def get_session(master: str = "local[8]", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own session."""
    return (
        SparkSession.builder.master(master)
        .appName("furrow")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def shared_root(spark: SparkSession, location: str | None = None) -> str:
    """The folder that every executor and the driver can reach.

    ``location`` if the caller names one, else ``spark.checkpoint.dir``. A
    session on one machine (master ``local``) may do without; on any other
    master a missing folder is an error, never a machine-local folder.
    """
    root = location or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(
            f"set spark.checkpoint.dir to a folder that all executors of {master} share"
        )
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append(tempfile.mkdtemp(prefix="furrow-"))
    return _LOCAL_ROOT[0]


def shared_folder(spark: SparkSession, location: str | None = None) -> str:
    """A fresh folder visible to every executor."""
    return f"{shared_root(spark, location)}/furrow/{uuid.uuid4().hex}"


def checkpoint_folder(spark: SparkSession) -> None:
    """See to it that ``DataFrame.checkpoint`` has a folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))


def has_files(spark: SparkSession, folder: str) -> bool:
    """Whether a folder is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def release(spark: SparkSession, folder: str) -> bool:
    """Delete a scratch folder made by ``shared_folder``; True if it is gone."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return not files.exists(path) or files.delete(path, True)


def open_store(uri: str):
    """(file system, path) of a folder of the shared store, for files that tasks write themselves."""
    from pyarrow import fs

    for scheme in ("s3a://", "s3n://"):  # the names that Hadoop has for it
        if uri.startswith(scheme):
            uri = "s3://" + uri[len(scheme) :]
    return fs.FileSystem.from_uri(uri)


def materialise(df: DataFrame, location: str | None = None) -> DataFrame:
    """Write a result once to the shared folder and go on from the files.

    Cuts the lineage of inputs that several jobs read (model fitting); the
    files survive the loss of any executor. ``release`` deletes them again.
    """
    folder = shared_folder(df.sparkSession, location)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
