"""Quality and agreement metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def precision_recall(pairs: DataFrame, by: str | None = None) -> DataFrame:
    """Pairs has booleans predicted and actual. One row, or one a value of by."""
    tp, p, a = (F.sum(c.cast("long")) for c in (F.col("predicted") & F.col("actual"), F.col("predicted"), F.col("actual")))
    grouped = pairs.groupBy(by) if by else pairs.groupBy()
    own = grouped.agg(tp.alias("tp"), p.alias("predicted"), a.alias("actual"))
    precision, recall = (F.coalesce(F.col("tp") / F.nullif(F.col(c), F.lit(0)), F.lit(0.0)) for c in ("predicted", "actual"))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return own.select(*([by] if by else []), "tp", F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(f1, 4).alias("f1"))


def kappa(pairs: DataFrame) -> DataFrame:
    """Cohen's kappa of the columns a and b; 1 where both always say one and the same thing."""
    n = pairs.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("po"))
    of_a, of_b = (pairs.groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias(f"n{c}")) for c in "ab")
    pe = of_a.join(of_b, "v").agg(F.coalesce(F.sum(F.col("na").cast("double") * F.col("nb")), F.lit(0.0)).alias("both"))
    out = n.join(F.broadcast(pe)).withColumn("pe", F.col("both") / (F.col("n").cast("double") * F.col("n")))
    value = F.when(F.col("pe") >= 1, 1.0).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe")))
    return out.select("n", F.round("po", 4).alias("po"), F.round("pe", 4).alias("pe"), F.round(value, 4).alias("kappa"))


def completeness(df: DataFrame, **present: Column) -> DataFrame:
    """Percent of rows with each thing present, in one pass."""
    n = F.count(F.lit(1))
    return df.agg(n.alias("n"), *[F.round(100 * F.count_if(p) / n, 2).alias(name) for name, p in present.items()])


def overlap_matrix(df: DataFrame, key: str, value: str) -> DataFrame:
    """Number of keys that have both values, for each pair of values."""
    own = df.select(key, value).distinct()
    other = own.select(key, F.col(value).alias("other"))
    return own.join(other, key).groupBy(value, "other").agg(F.count(F.lit(1)).alias("n"))


def chunk_stats(df: DataFrame, size: Column, by: list[str]) -> DataFrame:
    """A10: mean (1 digit), lower median, least, most, over 2000, under 150."""
    own = df.withColumn("_size", size)
    out = own.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("_size"), 1).alias("mean"), F.floor(F.expr("percentile(_size, 0.5)")).cast("long").alias("median"), F.min("_size").alias("least"), F.max("_size").alias("most"), F.count_if(F.col("_size") > 2000).alias("oversized"), F.count_if(F.col("_size") < 150).alias("tiny"))
    return out


def manifest(papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A5: one row of conditional counts of canonical papers, and a histogram (kind, value, n) of document types, sources (a
    paper's provenance counts each) and years.

    papers: abstract, doi, arxiv_id, authors, references, topics (arrays), venue, published_date, publication_year,
    citation_count, fulltext_status, fulltext_path, document_type, sources (array)."""
    filled = lambda name: F.coalesce(F.length(F.col(name).cast("string")) > 0, F.lit(False))
    some = lambda name: F.coalesce(F.size(F.col(name)) > 0, F.lit(False))
    counts = {
        "with_abstracts": F.length("abstract") > 20, "with_doi": filled("doi"), "with_arxiv": filled("arxiv_id"), "with_authors": some("authors"),
        "with_date": filled("published_date") | F.coalesce(F.col("publication_year") != 0, F.lit(False)), "with_citations": F.col("citation_count").isNotNull(),
        "with_references": some("references"), "with_venue": filled("venue"), "with_topics": some("topics"),
        "discoverable": F.col("fulltext_status") == "DISCOVERABLE", "downloaded": (F.col("fulltext_status") == "DOWNLOADED") | filled("fulltext_path"),
    }
    row = papers.agg(F.count(F.lit(1)).alias("papers"), *[F.count_if(F.coalesce(x, F.lit(False))).alias(k) for k, x in counts.items()])
    values = F.concat(
        F.array(F.struct(F.lit("document_type").alias("kind"), F.coalesce("document_type", F.lit("None")).alias("value"))),
        F.transform(F.coalesce("sources", F.array().cast("array<string>")), lambda x: F.struct(F.lit("source").alias("kind"), x.alias("value"))),
        F.when(F.col("publication_year") != 0, F.array(F.struct(F.lit("year").alias("kind"), F.col("publication_year").cast("string").alias("value")))).otherwise(F.array().cast("array<struct<kind:string,value:string>>")),
    )
    return row, papers.select(F.explode(values).alias("x")).groupBy("x.kind", "x.value").agg(F.count(F.lit(1)).alias("n"))
