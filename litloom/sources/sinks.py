"""Sinks: partitioned JSON and Parquet, versioned snapshots (SNK1-SNK11)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def raw_json(df: DataFrame, path: str, by: str = "source") -> None:
    """SNK1, SNK2: appended JSON lines, a folder a source."""
    df.write.mode("append").partitionBy(by).json(path)


def parquet(df: DataFrame, path: str, fill: dict | None = None) -> None:
    """SNK4, SNK7, SNK11: Parquet, nulls filled as asked."""
    (df.na.fill(fill) if fill else df).write.mode("overwrite").parquet(path)


def snapshot(tables: dict[str, DataFrame], root: str) -> str:
    """SNK6, SNK8: all tables under a new version; readers follow the version that is returned last, after all are
    written. An interrupted snapshot leaves the one before as it is."""
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{root}/{version}/{name}")
    return f"{root}/{version}"


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """SNK5: name, rows of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def corpus(documents: DataFrame, chunks: dict[str, DataFrame], root: str) -> DataFrame:
    """SNK9: documents as JSON, each strategy's chunks as Parquet, a review sheet as CSV; returns the manifest."""
    documents.write.mode("overwrite").json(f"{root}/documents")
    for name, df in chunks.items():
        parquet(df, f"{root}/chunks_{name}")
    return manifest({"documents": documents, **{f"chunks_{name}": df for name, df in chunks.items()}})


def extraction(records: DataFrame, relations: DataFrame, rejected: DataFrame, root: str) -> None:
    """SNK10: three folders of JSON lines."""
    for name, df in {"records": records, "relations": relations, "rejected": rejected}.items():
        df.write.mode("overwrite").json(f"{root}/{name}")


def sheet(df: DataFrame, path: str, blank: list[str]) -> None:
    """SNK12: CSV with empty columns for annotators."""
    df.withColumns({name: F.lit(None).cast("string") for name in blank}).write.mode("overwrite").csv(path, header=True)
