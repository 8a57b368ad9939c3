"""Steps cut by files in shared storage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Write df to the folder that spark.checkpoint.dir names (our own where it is unset and all is one machine) and read it again."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "/tmp/checkpoints/litloom"
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(table: DataFrame) -> DataFrame:
    """A table just read, dealt out evenly where it has fewer partitions than there are cores (one small file with one row
    group): heavy work on each row would keep a few cores busy only. Larger tables pass as they are, without a shuffle.
    Not for results of joins and aggregations: asking for their partitions would compute them."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table
