"""Record linkage: keys, components, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """A2: the first row of each key in an explicit order; reduced in the tasks before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("row")
    return df.groupBy(*key).agg(best).select(*key, "row.*").select(*df.columns)


def groups_of(df: DataFrame, key: Column, least: int = 2) -> DataFrame:
    """Keys that least rows or more share, with their number."""
    return df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def match_edges(records: DataFrame, keys: list[str], id: str = "id") -> DataFrame:
    """Each key's rows joined to the key's least id: one edge a row, however large the group."""
    edges = None
    for key in keys:
        own = records.where(F.col(key).isNotNull()).select(F.col(id).alias("b"), F.col(key).alias("k"))
        heads = own.groupBy("k").agg(F.min("b").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        some = own.join(heads, "k").where("a <> b").select("a", "b")
        edges = some if edges is None else edges.unionByName(some)
    return edges.distinct()


def components(nodes: DataFrame, edges: DataFrame, cut) -> DataFrame:
    """id, component: least id of the connected component. cut(df) writes and rereads a step in shared storage."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")))
    while True:
        near = both.join(labels.select(F.col("a").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("m"))
        step = labels.join(near, "a").select("a", F.least("c", "m").alias("n"), "c")
        jump = labels.select(F.col("a").alias("n"), F.col("c").alias("far"))
        step = cut(step.join(jump, "n", "left").select("a", F.least("n", F.coalesce("far", "n")).alias("c"), F.col("c").alias("was")))
        if step.where("c <> was").isEmpty():
            break
        labels = step.select("a", "c")
    found = labels.select(F.col("a").alias("id"), F.col("c").alias("component"))
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def author_overlap(a: Column, b: Column) -> Column:
    """Last names meet; a missing list matches."""
    return F.when(F.coalesce(F.size(a) * F.size(b), F.lit(0)) <= 0, True).otherwise(F.coalesce(F.arrays_overlap(a, b), F.lit(False)))


def years_agree(a: Column, b: Column) -> Column:
    """A year apart at most; a missing year matches."""
    return a.isNull() | b.isNull() | (F.abs(a - b) <= 1)


def count_years_agree(records: DataFrame, key: str, id: str, year: str, missing: bool = True) -> DataFrame:
    """J9 over a table: n, the number of pairs of rows with one key and different ids whose years (whole numbers) agree, from
    the numbers of rows by key and year: no pair is made. missing: a missing year matches."""
    rows = records.where(F.col(key).isNotNull() & F.col(id).isNotNull()).select(F.col(key).alias("k"), F.col(id).alias("i"), F.col(year).cast("long").alias("y"))
    each = rows.groupBy("k", "i", "y").agg(F.count(F.lit(1)).alias("n"))
    all_of, own = (_agreeing(g, by, missing) for g, by in ((each.groupBy("k", "y").agg(F.sum("n").alias("n")), ["k"]), (each, ["k", "i"])))
    return all_of.unionByName(own.select((-F.col("n")).alias("n"))).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def _agreeing(groups: DataFrame, by: list[str], missing: bool) -> DataFrame:
    """n in parts, to be summed: pairs of the n rows of each y, of neighbouring y and, if asked for, with a missing one, within by."""
    pairs = lambda n: F.expr(f"{n} * ({n} - 1) div 2")
    known = groups.where("y is not null")
    after = known.select(*by, (F.col("y") - 1).alias("y"), F.col("n").alias("m"))
    parts = known.select(pairs("n").alias("n")).unionByName(known.join(after, [*by, "y"]).select((F.col("n") * F.col("m")).alias("n")))
    if missing:
        sums = groups.groupBy(by).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("y").isNull(), F.col("n"))), F.lit(0)).alias("m"))
        parts = parts.unionByName(sums.select((pairs("m") + F.expr("m * (n - m)")).alias("n")))
    return parts


def best_row(df: DataFrame, key: str, order: list) -> DataFrame:
    rank = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(rank)).where("_rank = 1").drop("_rank")
