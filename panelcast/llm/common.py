"""What the text operators share: reading a table, scratch tables in the shared folder, the words of a text."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words in the contracts.
WHITE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it. Where that is unset, one of this machine
    will do for a local master (tests); a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.gettempdir()}/panelcast-checkpoints"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


BATCH_SETTING, BATCH_SIZE = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Python workers get texts in batches of BATCH_SIZE bytes, so that what a task holds outside the heap follows its
    longest text and not thousands of rows. Spark's default of 64 MB is replaced in this session, any other kept."""
    if spark.conf.get(BATCH_SETTING, None) in ("64MB", f"{64 << 20}b", str(64 << 20)):
        spark.conf.set(BATCH_SETTING, f"{BATCH_SIZE}b")


#: Shuffle files of a query go when it has ended, where this version of Spark can do that.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write the rows once, as Parquet in the shared folder, and read them back: later steps don't compute them
    again, and a lost executor loses nothing of them. The shuffles that made them are of no more use and go."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    try:
        spark.conf.set(CLEANUP, "true")
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
