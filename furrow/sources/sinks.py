"""Keyed upserts, replacements and file sinks."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

from pyspark import RDD, TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from furrow.operators.series import latest_per_key
from furrow.session import has_files, open_store, release

PRICE_KEY = ["crop", "state", "fetch_date"]
WEATHER_KEY = ["district", "date"]
DIAGNOSTIC_KEY = ["crop", "mandi", "test_name", "stage"]


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Current rows with incoming ones inserted or replacing their key.

    Incoming wins over current; among incoming rows of one key the largest
    ``order`` wins.  Each map task keeps one row per key before the shuffle.
    """
    both = current.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    return latest_per_key(both, keys, ["_new", *order]).drop("_new")


def upsert_prices(
    current: DataFrame, incoming: DataFrame, keys: list[str] | None = None, order=("id",)
) -> DataFrame:
    """Price upsert; the key is a parameter so that markets can be kept apart."""
    return upsert(current, incoming, keys or PRICE_KEY, list(order))


def upsert_weather(current: DataFrame, incoming: DataFrame, order: list[str]) -> DataFrame:
    return upsert(current, incoming, WEATHER_KEY, order)


def replace_by_key(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Delete every row whose key comes in, then insert the incoming rows."""
    untouched = current.join(incoming.select(*keys).distinct(), keys, "left_anti")
    return untouched.unionByName(incoming)


def append_log(df: DataFrame, path: str, run: str) -> None:
    """Append the rows of one run: written beside the log, then published as a whole.

    A run that is repeated replaces its own rows; one that was killed half-way
    has left nothing that ``read_log`` sees.
    """
    if not run or not all(c.isalnum() or c in "-_." for c in run):
        raise ValueError("a run is named by letters, digits, - _ .")
    spark = df.sparkSession
    staged, place = f"{path}/_staged/{run}", f"{path}/run={run}"
    df.write.mode("overwrite").parquet(staged)
    release(spark, place)
    of = spark._jvm.org.apache.hadoop.fs.Path
    if not of(path).getFileSystem(spark._jsc.hadoopConfiguration()).rename(of(staged), of(place)):
        raise OSError(f"cannot publish {place}")


def read_log(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of all published runs, without the runs' names."""
    names = [f.name for f in schema.fields]
    if not has_files(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(path).select(*names)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_documents(docs: DataFrame, path: str, per_folder: int | None = None) -> None:
    """One text file of each row of the one column, ending in a line feed.

    Tasks write the files themselves: Spark's writer took 19 ms a file on a local
    disk. A task that is repeated has the same rows in the same order, so it writes
    its own files again. With ``per_folder`` the files lie in folders ``part=`` of
    at most so many: listed one by one, no folder grows with the table.
    """
    column = docs.columns[0]
    store, base = open_store(path)
    store.create_dir(base, recursive=True)

    def put(rows) -> None:
        store, base = open_store(path)
        store.create_dir(base, recursive=True)
        part, folder = TaskContext.get().partitionId(), base
        for i, (text,) in enumerate(rows):
            if per_folder and i % per_folder == 0:
                folder = f"{base}/part={part:06d}-{i // per_folder:06d}"
                store.create_dir(folder)
            with store.open_output_stream(f"{folder}/part-{part:06d}-{i:09d}.txt") as out:
                out.write(((text or "") + "\n").encode())

    tasks = docs.sparkSession.sparkContext.defaultParallelism
    docs.repartition(tasks).sortWithinPartitions(column).foreachPartition(put)


def _hidden(name: str) -> bool:
    """Whether Spark's readers pass over a name."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _listed(store, folder: str) -> list[tuple[str, bool]]:
    """(path, whether a folder) of what is not hidden in a folder."""
    from pyarrow.fs import FileSelector, FileType

    return sorted(
        (x.path, x.type == FileType.Directory)
        for x in store.get_file_info(FileSelector(folder))
        if not _hidden(x.base_name)
    )


def _below(store, folder: str, counts: bool = False) -> Iterator[str]:
    """The files of a folder in the one that is read: as with Spark's readers
    those that have a key=value on their way."""
    counts = counts or "=" in folder.rsplit("/", 1)[-1]
    for path, is_folder in _listed(store, folder):
        if is_folder:
            yield from _below(store, path, counts)
        elif counts:
            yield path


def _content(store, path: str) -> bytes:
    """The bytes of a file, uncompressed as its name says."""
    end = path[path.rfind(".") :].lower()
    if end in (".lz4", ".snappy"):  # Hadoop frames them in its own way
        raise ValueError(f"{path}: files of this kind are not read")
    with store.open_input_stream(path, compression={".gz": "gzip", ".bz2": "bz2", ".zst": "zstd"}.get(end)) as file:
        return zlib.decompress(file.read()) if end == ".deflate" else file.read()


def read_documents(spark: SparkSession, path: str) -> RDD[bytes] | None:
    """The bytes of each file in a folder, or of the files that a pattern names.

    Tasks list the folders and read the files: the driver, which holds an entry a
    file with Spark's readers, sees none. None if there is nothing of that name, or
    in a store that ``open_store`` does not reach.
    """
    of = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = of.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(of)
    roots = [x.getPath().toUri().toString() for x in found or []]
    if not roots:
        return None
    try:
        open_store(roots[0])
    except (OSError, ValueError, NotImplementedError):
        return None
    tasks = 4 * spark.sparkContext.defaultParallelism

    def inside(uris):
        for uri in uris:
            store, at = open_store(uri)
            if not store.get_file_info(at).is_file:
                yield from ((uri, *x) for x in _listed(store, at))
            elif not _hidden(at.rsplit("/", 1)[-1]):
                yield uri, at, False

    def below(entries):
        stores = functools.cache(lambda uri: open_store(uri)[0])
        for uri, at, is_folder in entries:
            yield from ((uri, x) for x in (_below(stores(uri), at) if is_folder else [at]))

    def contents(files):
        stores = functools.cache(lambda uri: open_store(uri)[0])
        for uri, at in files:
            yield _content(stores(uri), at)

    entries = spark.sparkContext.parallelize(roots, min(len(roots), tasks)).mapPartitions(inside)
    files = entries.repartition(tasks).mapPartitions(below)
    return files.repartition(tasks).mapPartitions(contents)


def current_rows(table: DataFrame, partition: str) -> DataFrame:
    """Newest version of every partition value of a versioned table.

    Versions are partition columns: the newest ones are found from file paths,
    and dynamic partition pruning skips the files of older versions.
    """
    newest = table.groupBy(partition).agg(F.max("version").alias("version"))
    return table.join(newest, [partition, "version"], "left_semi").drop("version")


def _has_rows(spark: SparkSession, folder: str) -> bool:
    """Whether the table has been written with at least one partition."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*=*")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def merge_partitions(
    incoming: DataFrame, folder: str, version: int, keys: list[str], partition: str, order: list[str]
) -> None:
    """Upsert into a table stored as ``partition=.../version=...``.

    Only the partition values present in ``incoming`` are rewritten, under a
    new version; readers keep seeing the older one until the write commits.
    Stored and incoming rows of a key are ranked together by ``order``; incoming
    wins only a tie. A batch without rows leaves the table as it is.
    Re-running a version replaces exactly its own files.
    """
    spark = incoming.sparkSession
    if _has_rows(spark, folder):
        table = spark.read.parquet(folder).filter(F.col("version") < version)
        touched = incoming.select(partition).distinct()
        old = current_rows(table.join(touched, partition, "left_semi"), partition)
        both = old.select(incoming.columns).withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
        out = latest_per_key(both, keys, [*order, "_new"]).drop("_new")
    else:
        out = latest_per_key(incoming, keys, order)
    (
        out.withColumn("version", F.lit(version))
        # adaptive rebalance: big dates split over tasks, small ones share one
        .hint("rebalance", partition)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition, "version")
        .parquet(folder)
    )
