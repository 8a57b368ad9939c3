"""Knowledge base: validation ladders with a quarantine branch, alias resolution, consolidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import short_id

# Types of records and reasons of quarantine.
ENTITY_TYPES = ["METHOD", "PROBLEM", "BOTTLENECK", "METRIC", "DATASET", "TASK", "ASSUMPTION", "DOMAIN"]
STATEMENT_TYPES = ["CLAIM", "RESULT", "LIMITATION", "FUTURE_DIRECTION", "FAILURE_MODE"]
RELATION_TYPES = ["ADDRESSES", "USES", "IMPROVES", "OUTPERFORMS", "LIMITED_BY", "EVALUATED_ON", "ASSUMES", "REPORTS", "SUGGESTS", "CONTRADICTS"]
SCHEMA, BOUNDS, UNGROUNDED, NO_PROVENANCE, DANGLING = "SCHEMA_VALIDATION_ERROR", "INVALID_SPAN_BOUNDS", "UNGROUNDED_EVIDENCE", "MISSING_PROVENANCE_FIELD", "DANGLING_RELATION_ENDPOINT"


def blank(x: Column) -> Column:
    return ~F.coalesce(x.rlike(r"\S"), F.lit(False))


def chain_error(evidence: Column, provenance: Column) -> Column:
    """The end of every ladder. evidence: struct with text, start_char, end_char; provenance: with canonical_id, chunk_id,
    document_id. Bounds may be equal; offsets count from 0."""
    start, end = evidence["start_char"], evidence["end_char"]
    lost = blank(provenance["canonical_id"]) | blank(provenance["chunk_id"]) | blank(provenance["document_id"])
    return F.when(blank(evidence["text"]), UNGROUNDED).when(start.isNull() | (start < 0) | end.isNull() | (end < start), BOUNDS).when(lost, NO_PROVENANCE)


def validate_records(records: DataFrame) -> DataFrame:
    """Records (record_id, category, surface_text, evidence, provenance) with record_type (ENTITY, STATEMENT, or
    UNKNOWN for a category of neither) and reason, the first that holds, null for valid ones."""
    kind = F.when(F.col("category").isin(ENTITY_TYPES), "ENTITY").when(F.col("category").isin(STATEMENT_TYPES), "STATEMENT").otherwise("UNKNOWN")
    out = records.withColumn("record_type", kind)
    first = F.when((F.col("record_type") == "UNKNOWN") | blank(F.col("record_id")) | blank(F.col("surface_text")), SCHEMA)
    return out.withColumn("reason", F.coalesce(first, chain_error(F.col("evidence"), F.col("provenance"))))


def quarantined(checked: DataFrame, id: str = "record_id") -> DataFrame:
    """The rejected rows with an id made of their own and the reason."""
    return checked.where("reason is not null").withColumn("quarantine_id", short_id("quar_", F.coalesce(F.col(id).cast("string"), F.lit("unknown")), F.col("reason")))


def references(entities: DataFrame, statements: DataFrame, upstream: DataFrame) -> DataFrame:
    """ref, kb_id, kind: what an endpoint may name. An entity's id goes before a statement's, that before an upstream id
    (upstream: id, kb_id)."""
    own = entities.select("id").withColumn("kb_id", F.col("id")).withColumn("kind", F.lit("ENTITY")).withColumn("rank", F.lit(0))
    own = own.unionByName(statements.select("id").withColumn("kb_id", F.col("id")).withColumn("kind", F.lit("STATEMENT")).withColumn("rank", F.lit(1)))
    named = upstream.join(statements.select(F.col("id").alias("kb_id"), F.lit("STATEMENT").alias("kind")).distinct(), "kb_id", "left")
    own = own.unionByName(named.select("id", "kb_id", F.coalesce("kind", F.lit("ENTITY")).alias("kind"), F.lit(2).alias("rank")))
    return own.groupBy(F.col("id").alias("ref")).agg(F.min_by(F.struct("kb_id", "kind"), F.struct("rank", "kb_id")).alias("m")).select("ref", "m.*")


def validate_relations(relations: DataFrame, known: DataFrame) -> DataFrame:
    """Relations (relation_id, relation_type, source_id, target_id, evidence, provenance) with source_kb, target_kb,
    their kinds and reason: id, type, endpoints there, endpoints resolved, evidence, provenance. known: references()."""
    out = relations
    for side in ("source", "target"):
        out = out.join(known.select(F.col("ref").alias(f"{side}_id"), F.col("kb_id").alias(f"{side}_kb"), F.col("kind").alias(f"{side}_kind")), f"{side}_id", "left")
    schema = blank(F.col("relation_id")) | ~F.coalesce(F.col("relation_type").isin(RELATION_TYPES), F.lit(False)) | blank(F.col("source_id")) | blank(F.col("target_id"))
    reason = F.when(schema, SCHEMA).when(F.col("source_kb").isNull() | F.col("target_kb").isNull(), DANGLING)
    return out.withColumn("reason", F.coalesce(reason, chain_error(F.col("evidence"), F.col("provenance"))))


def versions(*runs: DataFrame) -> DataFrame:
    """The records of extraction runs, the first run's first: src_order numbers the runs."""
    out = None
    for k, run in enumerate(runs):
        run = run.withColumn("src_order", F.lit(k))
        out = run if out is None else out.unionByName(run, allowMissingColumns=True)
    return out


def later_wins(*hits: DataFrame, key: str = "id") -> DataFrame:
    """The union of hit lists, of rows with one key that of the last list (of several there, any order's least)."""
    every = versions(*hits)
    rest = [c for c in every.columns if c not in (key, "src_order")]
    return every.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("src_order", *rest)).alias("m")).select(key, "m.*")


def entities_of(mentions: DataFrame) -> DataFrame:
    """A1: one entity a (category, canonical): mentions_count, distinct papers, chunks, mention ids and aliases in order, the
    least version, status CONFIRMED if any mention's alias is. Distinct values are found by two aggregations, each reduced
    in the tasks first; only what an entity's own row holds meets in one place.

    mentions: mention_id, category, canonical, surface_text, aliases (array), status, paper_id, chunk_id, version."""
    key = ["category", "canonical"]
    base = mentions.groupBy(*key).agg(
        F.count(F.lit(1)).alias("mentions_count"), F.min("version").alias("first_seen_version"),
        F.when(F.max((F.col("status") == "CONFIRMED").cast("int")) == 1, "CONFIRMED").otherwise(F.min("status")).alias("alias_status"),
    )
    names = F.concat(F.array("surface_text"), F.coalesce("aliases", F.array().cast("array<string>")))
    parts = F.array(F.struct(F.lit("paper_ids").alias("part"), F.array("paper_id").alias("of")), F.struct(F.lit("chunk_ids").alias("part"), F.array("chunk_id").alias("of")), F.struct(F.lit("mention_ids").alias("part"), F.array("mention_id").alias("of")), F.struct(F.lit("aliases").alias("part"), names.alias("of")))
    long = mentions.select(*key, F.explode(parts).alias("x")).select(*key, "x.part", F.explode("x.of").alias("value")).where("value is not null").distinct()
    wide = long.groupBy(*key).pivot("part", ["paper_ids", "chunk_ids", "mention_ids", "aliases"]).agg(F.sort_array(F.collect_list("value")))
    return base.join(wide, key, "left")


def records_of_chunk(chunk_id: str, **tables: DataFrame) -> dict[str, DataFrame]:
    """KBQ: of each given table (mentions, statements, relationships) the rows of a chunk."""
    return {name: rows.where(F.col("chunk_id") == chunk_id) for name, rows in tables.items()}


def filter_records(tables: dict[str, DataFrame], limit: int = 100, extractor_version: str | None = None, validation_status: str | None = None, **only_relations: str | None) -> dict[str, DataFrame]:
    """KBQ: rows of each table by version and status; only_relations (structural_validity, evidence_support,
    human_verification) filter tables that have those columns. limit is the report's length."""
    out = {}
    for name, rows in tables.items():
        rows = all_of(rows, extraction_version=extractor_version, validation_status=validation_status.strip().upper() if validation_status else None)
        out[name] = all_of(rows, **{k: v.strip().upper() for k, v in only_relations.items() if v and k in rows.columns}).limit(limit)
    return out


def quarantine_log(rows: DataFrame, limit: int | None = None, at: str = "created_at", id: str = "quarantine_id") -> DataFrame:
    """Quarantined records, the latest first."""
    out = rows.orderBy(F.desc(at), id)
    return out if limit is None else out.limit(limit)


def alias_listing(aliases: DataFrame, limit: int | None = None) -> DataFrame:
    """Alias mappings by canonical name, then alias."""
    out = aliases.orderBy("canonical", "alias")
    return out if limit is None else out.limit(limit)


def listing(rows: DataFrame, by: str, name: str, limit: int) -> DataFrame:
    """The first rows by a number, largest first, then name."""
    return rows.orderBy(F.desc(by), name).limit(limit)


def recurring(rows: DataFrame, category: str, limit: int) -> DataFrame:
    """The most frequent categories and their numbers."""
    return listing(rows.groupBy(category).agg(F.count(F.lit(1)).alias("n")), "n", category, limit)


def compare_runs(a: DataFrame, b: DataFrame, category: str) -> DataFrame:
    """Category, a, b (numbers of rows in two runs, 0 where it is absent) and delta."""
    x, y = (run.groupBy(category).agg(F.count(F.lit(1)).alias(n)) for run, n in ((a, "a"), (b, "b")))
    both = x.join(y, category, "full").select(category, F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    return both.withColumn("delta", F.col("b") - F.col("a"))


def span_error(text: Column, start: Column, end: Column) -> Column:
    """The first thing wrong with an evidence span, or null."""
    return (
        F.when(text.isNull() | (F.trim(text) == ""), "EMPTY_EVIDENCE").when(start.isNull() | end.isNull(), "MISSING_OFFSETS")
        .when((start < 0) | (end <= start), "INVALID_SPAN_BOUNDS").when(end - start != F.length(text), "SPAN_LENGTH_MISMATCH")
    )


def provenance_error(*ids: Column) -> Column:
    """An id of the chain is missing."""
    missing = F.lit(False)
    for x in ids:
        missing = missing | x.isNull() | (F.trim(x.cast("string")) == "")
    return F.when(missing, "MISSING_PROVENANCE")


def split(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and quarantined rows with their reason. One pass over df each, or one if it is kept."""
    checked = df.withColumn("reason", reason)
    return checked.where("reason is null").drop("reason"), checked.where("reason is not null")


def resolve(df: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    """Canonical name by alias table (key, canonical, status); the name itself without one."""
    return df.join(aliases, key, "left").withColumn("canonical", F.when(F.col("status") == "CONFIRMED", F.col("canonical")).otherwise(F.col(key)))


def endpoints(rels: DataFrame, known: DataFrame) -> DataFrame:
    """Relationships with what each endpoint resolves to; dangling ones have a reason."""
    out = rels
    for side in ("source", "target"):
        out = out.join(known.select(F.col("id").alias(side), F.col("kind").alias(f"{side}_kind")), side, "left")
    return out.withColumn("reason", F.when(F.col("source_kind").isNull(), "DANGLING_SOURCE").when(F.col("target_kind").isNull(), "DANGLING_TARGET"))


def consolidate(mentions: DataFrame, key: list[str], member: str, alias: str) -> DataFrame:
    """A1 for any columns: number, distinct members in order, aliases in order. Rows are made distinct, reduced in the tasks,
    before an entity's own values meet."""
    counts = mentions.groupBy(*key).agg(F.count(F.lit(1)).alias("mentions"))
    for column, name in ((member, "members"), (alias, "aliases")):
        own = mentions.select(*key, column).distinct().groupBy(*key).agg(F.sort_array(F.collect_list(column)).alias(name))
        counts = counts.join(own, key, "left")
    return counts


def trusted(df: DataFrame, status: str | None = None, trusted_only: bool = False, include_unsupported: bool = True) -> DataFrame:
    """An explicit status goes before trusted_only, that before include_unsupported."""
    if status:
        return df.where(F.col("support") == status)
    if trusted_only:
        return df.where(F.col("support") == "SUPPORTED")
    return df if include_unsupported else df.where(F.col("support") != "UNSUPPORTED")


def all_of(df: DataFrame, **equal) -> DataFrame:
    """AND of the given equalities; None is no filter."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df
