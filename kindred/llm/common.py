"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, a temporary one in local mode and an error elsewhere."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """`df` with its lineage cut by a checkpoint in the cluster's shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run inside send texts to Python in batches of so many rows, which bounds what a worker holds."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Tables:
    """Tables of an operator's own in the shared folder: compressed columns, read again from there."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.held: dict[int, tuple[DataFrame, str]] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{shared_folder(self.spark)}/table-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held[id(out)] = (out, path)
        return out

    def seen_as(self, df: DataFrame, out: DataFrame) -> DataFrame:
        """`out`, a view of the kept `df`, which stands for it from now on."""
        self.held[id(out)] = (out, self.held.pop(id(df))[1])
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes the tables behind these frames; nothing may read them afterwards."""
        for df in frames:
            if id(df) in self.held:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(self.held.pop(id(df))[1])
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop_all_but(self, *frames: DataFrame) -> None:
        kept = {id(df) for df in frames}
        self.drop(*(df for key, (df, _) in list(self.held.items()) if key not in kept))


def n_words(text: str = "text") -> F.Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def held_out_remainder(key: str, modulus: int) -> F.Column:
    """crc32 of the key as text, modulo `modulus`; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


def fresh_name(stem: str, *taken: list[str]) -> str:
    """`stem`, with underscores before it until it is none of the names taken (in any case)."""
    used = {c.lower() for names in taken for c in names}
    while stem.lower() in used:
        stem = f"_{stem}"
    return stem
