"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only separator the word contracts know.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; a folder of our own only where none is set and everything runs in one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise to the shared checkpoint folder and cut the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables of one job in the shared folder: they cut the lineage as checkpoints do, but are compressed, read by column and can be freed."""

    def __init__(self, spark: SparkSession) -> None:
        ensure_checkpoint_dir(spark)
        self.spark, self.folder = spark, f"{spark.sparkContext.getCheckpointDir()}/scratch-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.held: list[DataFrame] = []  # an id stands for one table as long as that lives

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` written as a table and read back."""
        path = f"{self.folder}/{len(self.paths)}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").parquet(path)
        if not self.paths:  # what is not freed goes when the driver ends
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = path
        self.held.append(table)
        return table

    def free(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for table in tables:
            delete(self.spark, self.paths[id(table)])


def forget_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files behind tables that are written: it does so when the driver's garbage is collected."""
    gc.collect()
    spark._jvm.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of our own in whatever file system it lies."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def once(rows: DataFrame, keys: list[str], repeated: bool) -> DataFrame:
    """Rows without repeats by ``keys``; the shuffle is spared where the caller knows that there are none."""
    return rows.dropDuplicates(keys) if repeated else rows


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


#: Places of a key's three slots in a filter: how far the key, itself a hash, is shifted.
SLOT_SHIFTS = (0, 18, 37)


def bit_filter(keys: DataFrame, bits_log2: int):
    """A Bloom filter over the 64-bit hashes ``key`` as a numpy array of 2**(bits_log2 - 6) words.

    Its size is fixed by ``bits_log2`` (27 at most), so it may be broadcast whatever the input; as it fills up
    it only lets more keys through, never fewer.
    """
    import numpy as np

    slots = F.array(*[F.shiftrightunsigned("key", n).bitwiseAND(F.lit((1 << bits_log2) - 1)) for n in SLOT_SHIFTS])
    words = (
        keys.select(F.explode(slots).alias("slot"))
        .select(F.shiftright("slot", 6).alias("word"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
    )
    found = words.toArrow()
    out = np.zeros(1 << (bits_log2 - 6), dtype=np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def in_filter(words, keys, bits_log2: int):
    """Boolean array: may ``keys`` (uint64) be in the filter?"""
    import numpy as np

    found = np.ones(len(keys), bool)
    for n in SLOT_SHIFTS:
        slot = (keys >> np.uint64(n)) & np.uint64((1 << bits_log2) - 1)
        found &= (words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
    return found


def slices(batches, rows: int = 256):
    """Arrow batches in small slices, so that a worker holds the objects of few rows at a time."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)
