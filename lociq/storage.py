"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_dirs: dict[str, tempfile.TemporaryDirectory] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session in local mode without that setting gets a temporary folder of its own, which is
    removed when Python ends; on a cluster the missing setting is an error.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not (context.master or "").startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.TemporaryDirectory(prefix="lociq-", ignore_cleanup_errors=True)
    return _local_dirs[context.applicationId].name


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; what is written there goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    The written table cuts the lineage: a later stage that loses an executor rereads the table and
    does not rerun what made it. The files go when the driver's JVM ends, or by ``discard``.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stashed = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``stash`` returned and that no later plan reads."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(df._stashed)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _children(spark: SparkSession, path: str) -> list[str]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in system.listStatus(where)) if system.exists(where) else []


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Rows (path, length) of the files below a folder of any store that Spark reads; their contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return found.select("path", "length")


def compact(spark: SparkSession, folder: str, into: str, file_bytes: int = 128 << 20, one_file: bool = False) -> int:
    """Write a Parquet table of many small files as files of about that size; returns their number.

    With ``one_file`` these are parts, whose encoded row groups are then copied behind each other into one file of any size.
    """
    total = files(spark, folder, "*.parquet").agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    n = max(1, -(-total // file_bytes))
    parts = scratch(spark, "parts") if one_file else into
    spark.read.parquet(folder).repartition(n).write.option("compression", "zstd").parquet(parts)
    if not one_file:
        return n
    _append(spark, [f"{parts}/{name}" for name in _children(spark, parts) if name.endswith(".parquet")], f"{into}/part-00000.zstd.parquet")
    return 1


def _append(spark: SparkSession, paths: list[str], into: str) -> None:
    """One Parquet file of the row groups of others of the same schema, as they are: nothing is decoded and only footers are held."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path
    inputs = [jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(at(path), conf) for path in paths]
    first = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(inputs[0])
    about = first.getFooter().getFileMetaData()
    first.close()
    out = jvm.org.apache.parquet.hadoop.util.HadoopOutputFile.fromPath(at(into), conf)
    mode = jvm.org.apache.parquet.hadoop.ParquetFileWriter.Mode.CREATE
    writer = jvm.org.apache.parquet.hadoop.ParquetFileWriter(out, about.getSchema(), mode, 128 << 20, 8 << 20)
    writer.start()
    for each in inputs:
        writer.appendFile(each)
    writer.end(about.getKeyValueMetaData())


def back_up(df: DataFrame, folder: str, name: str) -> None:
    """Write a table as the backup ``name``; a backup of that name is replaced. Names order backups."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}")


def backups(spark: SparkSession, folder: str) -> list[str]:
    """The names of complete backups, in order; one that was cut off has no _SUCCESS file and doesn't count."""
    return [name for name in _children(spark, folder) if "_SUCCESS" in _children(spark, f"{folder}/{name}")]


def restore(spark: SparkSession, folder: str, name: str | None = None) -> DataFrame:
    """The backup of that name, or the newest."""
    found = backups(spark, folder)
    if not found or (name is not None and name not in found):
        raise FileNotFoundError(f"no backup {name or ''} in {folder}")
    return spark.read.parquet(f"{folder}/{name or found[-1]}")


def purge(spark: SparkSession, folder: str, keep: int) -> list[str]:
    """Delete all but the newest ``keep`` backups; returns the names of those deleted."""
    gone = backups(spark, folder)[: -keep or None]
    for name in gone:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return gone
