"""Exact dedup on a persistent digest index.

The index is a table bucketed and sorted by the digest of the normalised text, with as many buckets as its first batch
needs (ROWS_A_BUCKET each; they are kept in a file beside it). New rows are first reduced to one row a digest
(pre-aggregated before the shuffle, so a group of copies of any size is a few partial rows), anti-joined with the index
by sort-merge, without an exchange of the index, and appended. The index lives by its files: a later application whose
catalog doesn't know it finds them. Decisions, one row a digest, go back to the rows by a join whose hot digests Spark
may split.

Defined results: a null text counts as empty; of equal texts the row with most code points, then the smallest id
(null last) stays; of rows that repeat id and text exactly one stays; very long texts are digested whole; other columns
may be of any type and have any names; an empty table gives no rows and an empty index.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import repeated, scratch, settle, shared_dir, whole_row, without_blanks

ROWS_A_BUCKET, LEAST_BUCKETS = 4_000_000, 8
COLUMNS = ["digest", "keep_id", "keep_size", "group_size", "batch"]


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text as 32 bytes."""
    return F.unhex(F.sha2(without_blanks(text), 256))


def facts(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """digest, id, size of each row; the text goes no further."""
    return docs.select(digest(F.col(text)).alias("digest"), F.col(id).alias("id"), F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("size"))


def groups(rows: DataFrame) -> DataFrame:
    """One row a digest: keep_id, keep_size, group_size."""
    best = F.min(F.struct((-F.col("size")).alias("size"), F.col("id").isNull().alias("none"), "id")).alias("best")
    return rows.groupBy("digest").agg(best, F.count(F.lit(1)).alias("group_size")).select("digest", F.col("best.id").alias("keep_id"), (-F.col("best.size")).alias("keep_size"), "group_size")


class DigestIndex:
    """A bucketed table (digest, keep_id, keep_size, group_size, batch) in the shared folder."""

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int | None = None):
        shared_dir(spark)
        self.spark, self.buckets = spark, buckets
        self.name = name or f"digests_{uuid.uuid4().hex}"
        self.path = path or scratch(spark, self.name)

    def _files(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def _open(self, first: DataFrame) -> None:
        """Make the table known to the catalog: over its files if there are any, else an empty one with buckets for first."""
        if self.spark.catalog.tableExists(self.name):
            return
        system, note = self._files("_buckets")
        if system.exists(note):
            stream = system.open(note)
            self.buckets = stream.readInt()
            stream.close()
        else:
            rows = first.count() if self.buckets is None else 0
            self.buckets = self.buckets or max(LEAST_BUCKETS, 1 << (rows // ROWS_A_BUCKET).bit_length())
            stream = system.create(note)
            stream.writeInt(self.buckets)
            stream.close()
        kind = first.schema["keep_id"].dataType.simpleString()
        columns = f"digest BINARY, keep_id {kind}, keep_size BIGINT, group_size BIGINT, batch STRING"
        self.spark.sql(f"CREATE TABLE {self.name} ({columns}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")

    def admit(self, found: DataFrame) -> DataFrame:
        """Append the digests the index doesn't hold. found: groups(). Returns found with keep_id and keep_size of the row
        that stays and whether it is fresh, that is of this batch."""
        found = settle(found, "groups")
        self._open(found)
        batch = uuid.uuid4().hex
        known = self.spark.table(self.name).hint("merge")
        fresh = settle(found.hint("merge").join(known.select("digest"), "digest", "left_anti"), "fresh")
        seen = found.join(fresh.select("digest"), "digest", "left_anti").select("digest", "group_size")
        seen = settle(seen.join(known.select("digest", "keep_id", "keep_size"), "digest").withColumn("fresh", F.lit(False)), "seen")
        self._append(fresh, batch)
        return fresh.withColumn("fresh", F.lit(True)).unionByName(seen)

    def _append(self, fresh: DataFrame, batch: str) -> None:
        """Rows dealt out like the buckets, so that a batch adds one sorted file to each."""
        fresh.repartition(self.buckets, "digest").withColumn("batch", F.lit(batch)).select(COLUMNS).write.insertInto(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)


def dedup(docs: DataFrame, index: DigestIndex, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Admit docs to the index; a row for each row of docs: id, keep_id, group_size, kept, digest.

    group_size counts the rows of this batch. A row is kept if its text was not in the index before and it stays of
    its group.
    """
    rows = settle(facts(docs, text, id), "facts")
    decided = settle(index.admit(groups(rows)), "decided")  # so that both sides of the join are exchanged
    counted = rows.groupBy("digest", "id", "size").agg(F.count(F.lit(1)).alias("times"))
    stays = F.col("fresh") & F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("size") == F.col("keep_size"))
    own = counted.join(decided, "digest").select("id", "keep_id", "group_size", "times", stays.alias("stays"), "digest")
    every = repeated(own, "times")
    return every.select(F.col("id").alias(id), "keep_id", "group_size", (F.col("stays") & (F.col("copy") == 1)).alias("kept"), "digest")


def keep_one(docs: DataFrame, text: str = "text", id: str = "doc_id", index: DigestIndex | None = None) -> DataFrame:
    """The rows of docs that stay, with docs' own columns; without an index docs is one batch, with a fresh one.

    Rows are reduced to one a digest in the tasks that read them, so texts are dealt out once and no group of copies
    meets in one task. Of rows that repeat id and text the first by their other columns stays.
    """
    decided = (index or DigestIndex(docs.sparkSession)).admit(groups(facts(docs, text, id)))
    row, order = whole_row(docs, text)
    size = F.length(F.coalesce(F.col(text), F.lit("")))
    best = F.struct((-size).alias("size"), F.col(id).isNull().alias("none"), F.col(id).alias("id"), order.alias("order"))
    rows = docs.select(digest(F.col(text)).alias("__digest"), row.alias("__row"), best.alias("__best"))
    once = rows.groupBy("__digest").agg(F.min_by("__row", "__best").alias("__row"))
    fresh = decided.where("fresh").select(F.col("digest").alias("__digest"))
    return once.join(fresh, "__digest", "left_semi").select("__row.*")
