"""Choosing rows: relevance, scored candidates, stratified and multi-query samples, first-wins spans, listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Levels of the relevance score, its thresholds, weights of a candidate's fields, shares of a sample's strata.
CATEGORY, TOPIC, CUSTOM_TOPIC, ONE_TERM, MORE_TERMS, ADJACENT, CUSTOM_TERM = 0.85, 0.75, 0.70, 0.65, 0.85, 0.35, 0.65
STRICT, BROAD = 0.60, 0.30
FIELDS = {"title": 0.55, "abstract": 0.30, "topic": 0.15}
SHARES = {"ABSTRACT": 0.16, "INTRO_BACKGROUND": 0.20, "METHODS": 0.24, "RESULTS": 0.20, "CONCLUSION_LIMITATIONS": 0.13}


def relevance(topics: Column, text: Column, core: list[str], adjacent: list[str], categories: list[str] = (), custom: list[str] = ()) -> Column:
    """0 to 1, the best of what topics and text say. Adjacent terms count only where no core term does."""
    core, adjacent = (["(?U)" + p for p in own] for own in (core, adjacent))  # word boundaries of all scripts
    names = F.transform(F.coalesce(topics, F.array().cast("array<string>")), lambda t: F.lower(F.trim(t)))
    blob = F.lower(F.coalesce(text, F.lit("")))
    known, own = F.array(*map(F.lit, categories)).cast("array<string>"), F.array(*map(F.lit, custom)).cast("array<string>")
    any_core = lambda t: reduce(lambda a, b: a | b, [t.rlike(p) for p in core], F.lit(False))
    each = F.transform(names, lambda t: F.when(F.array_contains(known, t), CATEGORY).when(any_core(t), TOPIC).when(F.array_contains(own, t), CUSTOM_TOPIC).otherwise(0.0))
    hits = reduce(lambda a, b: a + b, [blob.rlike(p).cast("int") for p in core], F.lit(0))
    near = reduce(lambda a, b: a | b, [blob.rlike(p) for p in adjacent], F.lit(False))
    named = reduce(lambda a, b: a | b, [blob.rlike(rf"(?U)\b\Q{k.lower()}\E\b") for k in custom], F.lit(False))
    said = F.when(hits > 1, MORE_TERMS).when(hits == 1, ONE_TERM).when(near, ADJACENT).otherwise(0.0)
    return F.round(F.greatest(F.coalesce(F.array_max(each), F.lit(0.0)), said, F.when(named, CUSTOM_TERM).otherwise(0.0)), 3)


def relevant(df: DataFrame, score: Column, least: float | None) -> tuple[DataFrame, DataFrame]:
    """Rows at least so relevant (None: all), and one row of statistics."""
    keep = F.lit(True) if least is None else score >= least
    n = F.count(F.lit(1))
    stats = df.agg(n.alias("total"), F.count_if(keep).alias("kept"), F.count_if(~keep).alias("rejected"), F.round(F.coalesce(F.count_if(keep) / F.nullif(n, F.lit(0)), F.lit(0.0)), 4).alias("pass_rate"))
    return df.where(keep), stats


def field_score(parts: dict[str, tuple[Column, Column]]) -> Column:
    """Similarity of each field, (present, similarity); the weights of present fields are scaled to 1."""
    weight = sum(F.when(here, FIELDS[f]).otherwise(0.0) for f, (here, _) in parts.items())
    return F.round(sum(F.when(here, F.round(s, 4) * FIELDS[f]).otherwise(0.0) for f, (here, s) in parts.items()) / weight, 4)


def quota(df: DataFrame, by: list, order: list, most: int, rank: str = "rank") -> DataFrame:
    """The first most rows of each group, numbered. Spark prunes groups to most rows before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= most)


def stratified(chunks: DataFrame, size: int, seed: int, id: str = "id", paper: str = "paper") -> DataFrame:
    """Chunks (id, paper, bucket, edge) to a sample of size rows with its stratum.

    Quotas are size times each bucket's share, rounded down; edge cases get what is left over and are drawn first.
    Within a bucket papers take turns: the first of each paper, then the second. All else is in the order of a hash of id
    and seed, so that the sample is the same on any cluster. What is still open is filled in that order.
    """
    hashed = F.sha2(F.concat_ws("|", F.col(id).cast("string"), F.lit(str(seed))), 256)
    quotas = {b: int(size * s) for b, s in SHARES.items()}
    rows = chunks.withColumn("_h", hashed)
    edge = rows.where("edge").orderBy("_h").limit(size - sum(quotas.values())).select(id, F.lit("EDGE").alias("stratum"))
    rest = rows.join(F.broadcast(edge.select(id)), id, "left_anti")
    limits = F.element_at(F.create_map(*[F.lit(x) for pair in quotas.items() for x in pair]), F.col("bucket"))
    turn = Window.partitionBy("bucket", paper).orderBy("_h")
    own = rest.where(F.col("bucket").isin(*quotas)).withColumn("_turn", F.row_number().over(turn)).where(F.col("_turn") <= max(quotas.values()))
    own = quota(own, ["bucket"], ["_turn", "_h"], max(quotas.values()), "_r").where(F.col("_r") <= limits)
    drawn = edge.unionByName(own.select(id, F.col("bucket").alias("stratum")))
    open_ = rows.join(F.broadcast(drawn.select(id)), id, "left_anti").orderBy("_h").limit(size).select(id, F.lit("FILL").alias("stratum"))
    every = drawn.select(id, "stratum", F.lit(0).alias("late")).unionByName(open_.select(id, "stratum", F.lit(1).alias("late")))
    return every.withColumn("_h", hashed).orderBy("late", "_h").limit(size).select(id, "stratum")


def pilot(scored: DataFrame, strata: DataFrame, per_query: int, per_stratum: int, target: int) -> DataFrame:
    """(qid, id, score) and (id, stratum): the first per_query of each query, an id once (its least query), then per_stratum of each stratum among the others, target rows."""
    top = quota(scored, ["qid"], [F.desc("score"), "id"], per_query)
    once = top.groupBy("id").agg(F.min_by(F.struct("qid", "rank"), F.struct("qid", "rank")).alias("m")).select("id", F.col("m.qid").cast("string").alias("origin"), F.lit(0).alias("late"), F.col("m.rank").alias("at"))
    more = quota(strata.join(once.select("id"), "id", "left_anti"), ["stratum"], ["id"], per_stratum)
    more = more.groupBy("id").agg(F.min_by(F.struct("stratum", "rank"), "stratum").alias("m")).select("id", F.col("m.stratum").alias("origin"), F.lit(1).alias("late"), F.col("m.rank").alias("at"))
    return once.unionByName(more).orderBy("late", "at", "origin", "id").limit(target).select("id", "origin")


def first_spans(spans: DataFrame, key: list[str], priority: list[str]) -> DataFrame:
    """Of spans with the same key, the one of the first category of priority, then least text."""
    order = F.array_position(F.array(*map(F.lit, priority)), F.col("category"))
    order = F.when(order == 0, len(priority) + 1).otherwise(order)
    rest = [x for x in spans.columns if x not in key]
    best = spans.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(order, "category", "text")).alias("m"))
    return best.select(*key, "m.*").select(*spans.columns)
