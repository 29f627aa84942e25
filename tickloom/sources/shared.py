"""Tables of one job in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; one of our own only where none is set and everything runs in one process."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="spark-shared-")


class Folder:
    """A folder in whatever file system it lies."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path_of = spark._jvm.org.apache.hadoop.fs.Path
        self.root = path
        self.fs = self.path_of(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, *parts: str):
        """The path of something below the folder, or of the folder itself."""
        return self.path_of("/".join([self.root, *parts]))

    def has(self, *parts: str) -> bool:
        return self.fs.exists(self.at(*parts))

    def size(self, *parts: str) -> int:
        """Bytes of all files below."""
        return self.fs.getContentSummary(self.at(*parts)).getLength()

    def delete(self, *parts: str) -> None:
        self.fs.delete(self.at(*parts), True)

    def move(self, source: str, target: str) -> None:
        """A folder to another place, whose old content goes."""
        self.delete(target)
        self.fs.mkdirs(self.at(target).getParent())
        if not self.fs.rename(self.at(source), self.at(target)):
            raise OSError(f"{self.root}/{source} cannot be moved to {target}")

    def write(self, name: str, text: str) -> None:
        """A small file that is there as a whole or not at all."""
        out = self.fs.create(self.at(f"{name}.part"), True)
        out.write(bytearray(text.encode()))
        out.close()
        self.fs.delete(self.at(name), False)
        if not self.fs.rename(self.at(f"{name}.part"), self.at(name)):
            raise OSError(f"{self.root}/{name} cannot be written")

    def read(self, name: str) -> str:
        file = self.fs.open(self.at(name))
        try:
            return bytes(file.readAllBytes()).decode()
        finally:
            file.close()


#: Bytes of a written step beyond which it is never broadcast: as rows in memory it takes some fifty times as many.
BROADCAST_BYTES = 1 << 20


class Tables:
    """Steps of a job, written as they are taken: what reads them plans from a table of known size, not from all that led there.

    The planner goes by the bytes of the files, which are compressed, so a step of over ``BROADCAST_BYTES`` is marked as one to be
    shuffled: a broadcast would take it through the driver. The tables go when ``release`` is called, or else when the session ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder = spark, f"{shared_folder(spark)}/steps-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        delete_at_end(self.spark, self.folder)
        rows = self.spark.read.schema(df.schema).parquet(path)
        return rows.hint("merge") if Folder(self.spark, path).size() > BROADCAST_BYTES else rows

    def release(self) -> None:
        """Deletes the tables; nothing that reads them may be run after that."""
        Folder(self.spark, self.folder).delete()


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Has a folder that is there deleted when the driver ends, also after a query that failed."""
    folder = Folder(spark, path)
    folder.fs.deleteOnExit(folder.at())
