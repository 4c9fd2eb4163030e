"""Where tables between two steps are stored: the folder that all executors share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session without the setting gets one of its own."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "/tmp/checkpoints/tallystone"
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """The table written to the shared folder and read back: work that several branches of a plan need is done once."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_blocks(df: DataFrame, block: Column, parts: int, tag: str) -> str:
    """A folder of the table's blocks by number, below `parts`: tasks that need many blocks read them there, so that no copies of a block are shuffled."""
    path = new_path(df.sparkSession, tag)
    df.withColumn("__block", block.cast("int")).repartition(parts, "__block").write.partitionBy("__block").parquet(path)
    return path


def read_block(path: str, number: int) -> Iterator[pa.Table]:
    """In a task: the files of a block, in the order of their names."""
    system, at = fs.FileSystem.from_uri(path if "://" in path else path.replace(":/", ":///", 1)) if re.match(r"^[a-z][a-z0-9+.-]*:/", path) else (fs.LocalFileSystem(), path)
    for info in sorted(system.get_file_info(fs.FileSelector(f"{at}/__block={number}", allow_not_found=True)), key=lambda i: i.path):
        if info.is_file and info.base_name.endswith(".parquet"):
            with system.open_input_file(info.path) as f:
                yield pq.ParquetFile(f).read()
