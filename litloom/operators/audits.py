"""Roll-ups that describe a corpus, a run or a store: manifests, document audits, evaluation counters, parity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The ladder of a document audit.
LEAST_CHARS, LEAST_PAGE_RATE, MOST_CORRUPT, SHORT_LINE = 100, 0.8, 0.02, 8


def counters(df: DataFrame, by: Column) -> DataFrame:
    """One row, counts: a map from each value of by (null: 'NONE') to its number of rows."""
    own = df.groupBy(F.coalesce(by.cast("string"), F.lit("NONE")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return own.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "n")))).alias("counts"))


def shown(counts: Column) -> Column:
    """A map of counts as text, 'key:n' in key order."""
    entries = F.array_sort(F.map_entries(counts))
    return F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")


def manifest(df: DataFrame, by: Column, valid: Column) -> DataFrame:
    """A4: total, counts by category, integrity: the measured rate of valid rows (1.0 for none)."""
    total = df.agg(F.count(F.lit(1)).alias("total"), F.round(F.coalesce(F.avg(valid.cast("double")), F.lit(1.0)), 4).alias("integrity"))
    return total.crossJoin(F.broadcast(counters(df, by)))  # one row by one row


def document_audit(docs: DataFrame, text: Column, pages: Column, extracted: Column) -> DataFrame:
    """Docs with char_count, word_count, page_rate, corrupt, anomaly (half of the lines are short) and status."""
    own = F.coalesce(text, F.lit(""))
    chars = F.length(own)
    odd = F.length(own) - F.length(F.regexp_replace(own, r"[\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F]", ""))
    lines = F.filter(F.transform(F.split(own, "\n"), F.trim), lambda x: F.length(x) > 0)
    short = F.size(F.filter(lines, lambda x: F.length(x) < SHORT_LINE))
    rate = extracted / F.greatest(pages, F.lit(1))
    corrupt = odd / F.greatest(chars, F.lit(1)) > MOST_CORRUPT
    status = F.when((pages == 0) | (chars < LEAST_CHARS), "FAILED").when(corrupt | (rate < LEAST_PAGE_RATE), "PARTIAL").otherwise("SUCCESS")
    return docs.withColumns({
        "char_count": chars.cast("long"), "word_count": F.regexp_count(own, F.lit(r"\S+")).cast("long"), "page_rate": F.round(rate, 4),
        "corrupt": corrupt, "anomaly": short / F.greatest(F.size(lines), F.lit(1)) > 0.5, "status": status,
    })


def corpus_audit(audits: DataFrame, *by: str) -> DataFrame:
    """What the audits of documents add up to."""
    n = F.count(F.lit(1))
    status = [F.count_if(F.col("status") == s).alias(s.lower()) for s in ("SUCCESS", "PARTIAL", "FAILED")]
    return audits.groupBy(*by).agg(n.alias("documents"), *status, F.sum("char_count").alias("chars"), F.sum("word_count").alias("words"), F.round(F.count_if(F.col("status") == "SUCCESS") / n, 4).alias("success_rate"))


def run_metrics(records: DataFrame, chunks: Column | int) -> DataFrame:
    """Records has kind (ENTITY, STATEMENT, RELATION), status, grounded, chunk_id, paper_id. One row; rates to 4 digits."""
    n, share = F.count(F.lit(1)), lambda part, whole, none: F.round(F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(none)), 4)
    is_ = lambda s: F.count_if(F.col("status") == s)
    kept = F.coalesce(F.col("status"), F.lit("")) != "REJECTED"
    statement = F.col("kind") == "STATEMENT"
    chunks = F.lit(chunks) if isinstance(chunks, int) else chunks
    empty = F.greatest(F.lit(0), chunks - F.count_distinct(F.when(kept, F.col("chunk_id"))))
    return records.agg(
        n.alias("candidates"), is_("VALIDATED").alias("validated"), is_("NEEDS_REVIEW").alias("needs_review"), is_("REJECTED").alias("rejected"),
        share(is_("VALIDATED"), n, 1.0).alias("pass_rate"), share(is_("REJECTED"), n, 0.0).alias("rejection_rate"), share(is_("NEEDS_REVIEW"), n, 0.0).alias("review_rate"),
        share(F.count_if(kept & F.col("grounded")), F.count_if(kept), 1.0).alias("grounding"),
        share(F.count_if(kept & F.col("paper_id").isNotNull() & F.col("chunk_id").isNotNull()), F.count_if(kept), 1.0).alias("provenance"),
        share(F.count_if(statement & (F.col("status") != "VALIDATED")), F.count_if(statement), 0.0).alias("unsupported_rate"),
        empty.cast("long").alias("empty_chunks"), share(empty, chunks, 0.0).alias("empty_rate"),
    )


def evidence_correctness(predicted: DataFrame, truth: DataFrame, key: list[str]) -> DataFrame:
    """Of predictions whose first truth row of the same key (by ord) has a span: the share where one span holds the other; 1.0 for none."""
    first = truth.groupBy(*key).agg(F.min_by(F.coalesce("span", F.lit("")), "ord").alias("true_span")).where("true_span <> ''")
    met = predicted.join(first, key)
    good = F.contains("true_span", "span") | F.contains("span", "true_span")
    return met.agg(F.count(F.lit(1)).alias("n"), F.count_if(good).alias("correct"), F.round(F.coalesce(F.avg(good.cast("double")), F.lit(1.0)), 4).alias("rate"))


def reconcile(pairs: DataFrame) -> DataFrame:
    """Outcome of two annotations a and b: MISSING, AGREED, DISPUTED, with counts."""
    out = F.when(F.col("a").isNull() | F.col("b").isNull(), "MISSING").when(F.col("a") == F.col("b"), "AGREED").otherwise("DISPUTED")
    return pairs.groupBy(out.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def graph_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (id, kind), edges (src, dst, predicate): sizes, counts by kind and predicate, dangling edges, repeated edges, integrity."""
    ends = nodes.select("id").distinct()
    whole = edges.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")
    once = edges.groupBy("src", "dst", "predicate").agg(F.count(F.lit(1)).alias("n"))
    parts = [
        nodes.agg(F.count(F.lit(1)).alias("nodes")), counters(nodes, F.col("kind")).select(shown(F.col("counts")).alias("by_kind")),
        once.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("edges"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated")),
        counters(edges, F.col("predicate")).select(shown(F.col("counts")).alias("by_predicate")), whole.agg(F.count(F.lit(1)).alias("whole")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(F.broadcast(part))  # all have one row
    rate = F.round(F.coalesce(F.col("whole") / F.nullif("edges", F.lit(0)), F.lit(1.0)), 4)
    return out.withColumn("dangling", F.col("edges") - F.col("whole")).withColumn("integrity", rate).drop("whole")


def parity(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Row counts of two forms of one table, keys on one side only, whether their columns are the same."""
    sides = left.select(*key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(*key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    own = sides.groupBy(*key).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    same = sorted(left.dtypes) == sorted(right.dtypes)
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    return own.agg(total("l").alias("left_rows"), total("r").alias("right_rows"), F.count_if(F.col("r") == 0).alias("left_only"), F.count_if(F.col("l") == 0).alias("right_only")).withColumn("same_columns", F.lit(same))
