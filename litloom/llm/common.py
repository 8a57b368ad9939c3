"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ship
from ..storage import spread

#: The characters of [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
#: Bytes of an Arrow batch that are turned into Python objects at once.
SLICE_BYTES = 8 << 20
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where it is unset and all is one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "/tmp/checkpoints/litloom"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def settle(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it again: later stages start from files that outlive executors."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def map_columns(df: DataFrame, schema: str, make, *args) -> DataFrame:
    """Arrow batches through make(*args)(*columns) -> columns, about SLICE_BYTES at once, one row at least.

    make runs once a task; columns are Python lists, and results may be numpy arrays.
    """
    struct = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)

    def run(batches):
        step = make(*args)
        for batch in batches:
            for part in parts(batch):
                out = step(*(c.to_pylist() for c in part.columns))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow)], schema=arrow)

    return map_arrow(df, run, struct)


def parts(batch: pa.RecordBatch):
    """Slices of a batch of about SLICE_BYTES each, so that what is made of them stays bounded."""
    rows = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def release() -> None:
    """Give memory that a finished task leaves free back to the system: idle workers stay beside the next stage's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow with this package sent to the workers and their memory given back after each task.

    The session's bound on the bytes of an Arrow batch is lowered to SLICE_BYTES where it is higher or absent.
    """
    ship(df.sparkSession)
    bound = df.sparkSession.conf.get(BATCH_BYTES)
    if not bound.rstrip("b").isdigit() or not 0 < int(bound.rstrip("b")) <= SLICE_BYTES:
        df.sparkSession.conf.set(BATCH_BYTES, str(SLICE_BYTES))

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(whole, schema)


class Memo:
    """A dictionary of bounded size. When it is full, what has not been asked for since the last time is forgotten.

    weigh(key) is what an entry counts for; most is the bound of a generation, of which there are two. The keys of one
    call are all kept, so a call's own keys are to be bounded by the caller.
    """

    def __init__(self, most: int, weigh=lambda key: 1):
        self.most, self.weigh, self.size, self.young, self.old = most, weigh, 0, {}, {}

    def fill(self, keys: set, make) -> None:
        """Afterwards young has all the keys."""
        new = keys - self.young.keys()
        more = sum(map(self.weigh, new))
        if self.size + more > self.most and self.young:
            self.old, self.young, new = self.young, {}, keys
            self.size, more = 0, sum(map(self.weigh, new))
        self.size += more
        again = new & self.old.keys()
        self.young.update((k, self.old.pop(k)) for k in again)
        self.young.update(make(list(new - again)))


def without_blanks(text):
    """text without the characters of [\\x20\\x09-\\x0D]; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def whole_row(docs: DataFrame, text: str):
    """The row as a struct, and a string that orders rows of equal keys: their other columns as JSON and a hash of the
    text. Columns that have no order themselves (maps) may be among them."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    order = F.struct((F.to_json(F.struct(*others)) if others else F.lit("")).alias("others"), F.xxhash64(F.col(f"`{text}`")).alias("hash"))
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]), order


#: Copies of one row that a task writes out at once.
COPIES = 1 << 16


def repeated(rows: DataFrame, times: str) -> DataFrame:
    """Each row as often as its long column times says, with copy 1, 2, ... Copies of one row by the million are dealt
    out before they are written."""
    n = F.col(times).cast("long")
    few = rows.where(n.between(1, COPIES)).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), n)))
    part = rows.where(n > COPIES).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({times} - 1) div {COPIES}")))).repartition(F.col("part"))
    many = part.withColumn("copy", F.explode(F.expr(f"sequence(part * {COPIES} + 1, least({times}, (part + 1) * {COPIES}))"))).drop("part")
    return few.unionByName(many)
