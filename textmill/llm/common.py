"""What the training-data operators share: reading, scratch tables on the shared folder, row keys."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. On one machine it may be unset (tests), and is set here."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="textmill-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


class Scratch:
    """Intermediate tables, written once in the shared folder.

    A written table cuts lineage, so a lost executor costs at most the tasks of
    the stage at hand. `drop` deletes tables that no later step reads; what a
    lazy result still reads goes when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        fs, path = self._at("")
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _at(self, name: str) -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def write(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        schema = df.schema
        del df
        self.release()
        return self.spark.read.schema(schema).parquet(path)

    def release(self) -> None:
        """Lets the context cleaner delete shuffle files of finished steps; it acts on the driver's garbage only."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *names: str) -> None:
        for name in names:
            fs, path = self._at(name)
            fs.delete(path, True)


def row_digest(doc_id: Column, text: Column) -> Column:
    """128 bits over id and text as "k1" and "k2" of a struct: rows with equal keys have equal ids and texts."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    known = F.coalesce(doc_id.cast("string"), F.lit("\0"))
    return F.struct(F.xxhash64(known, t).alias("k1"), F.xxhash64(F.lit(7), t, known).alias("k2"))


def without_rows(docs: DataFrame, gone: DataFrame, doc_id: str, text: str) -> DataFrame:
    """docs without the rows whose row_digest is in `gone` (k1, k2): few keys go to the texts, many meet them in an exchange.

    All columns stay as they are; the key is one struct, under a name that docs don't have.
    """
    key = fresh("key", docs.columns)
    left = docs.withColumn(key, row_digest(F.col(doc_id), F.col(text)))
    keys = gone.select(F.struct("k1", "k2").alias(key))
    return left.join(broadcast_if_small(keys), key, "left_anti").select(*docs.columns)


def fresh(name: str, taken: list[str]) -> str:
    """A column name that isn't taken, whatever the case of letters."""
    known = {c.lower() for c in taken}
    while name in known:
        name += "_"
    return name


#: Rows of a few numbers each that may be broadcast: about 50 MB as a hash table.
BROADCAST_ROWS = 500_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a written table of short rows for broadcast if a count proves that it is small; else the join shuffles it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def labelled_fold(doc_id: Column | str = "doc_id") -> Column:
    """True for held-out rows: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))

