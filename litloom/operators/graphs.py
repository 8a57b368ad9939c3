"""Typed graph: building, neighbourhoods, bounded simple paths, bridges, candidate scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights and levels of the candidate score.
WEIGHTS = {"similarity": 0.25, "evidence": 0.25, "diversity": 0.20, "distance": 0.20, "mechanism": 0.10}
CONTRADICTION, REDUNDANCY = 0.30, 0.40
# Kinds of nodes and edges, states of support, and what stands for a kind that is none of them.
NODE_TYPES = ["PAPER", "METHOD", "PROBLEM", "BOTTLENECK", "TASK", "DATASET", "METRIC", "ASSUMPTION", "LIMITATION", "FUTURE_DIRECTION", "CLAIM", "RESULT", "STATEMENT", "CHUNK"]
PREDICATES = ["ADDRESSES", "LIMITED_BY", "EVALUATED_ON", "ASSUMES", "IMPROVES", "CONTRADICTS", "EXTENDS", "DERIVED_FROM", "USES", "REPORTS", "SUGGESTS", "CONTAINS", "MENTIONS", "ANALOGOUS_TO"]
SUPPORT = ["NOT_ASSESSED", "SUPPORTED", "UNSUPPORTED", "AMBIGUOUS"]
NAME_LENGTH = 80
#: Configurations of the ablation: components that are off.
CONFIGURATIONS = {"full_model": (), "ablation_no_distance": ("distance",), "ablation_no_redundancy_penalty": ("redundancy",), "ablation_no_evidence": ("evidence",), "ablation_no_contradiction": ("contradiction",)}


def either(x: Column, known: list[str], default: str) -> Column:
    """x in upper case if it is known, else the default."""
    return F.when(F.upper(x).isin(known), F.upper(x)).otherwise(default)


def build(papers: DataFrame, entities: DataFrame, statements: DataFrame, relationships: DataFrame, include_unsupported: bool = True, max_papers: int | None = None) -> dict[str, DataFrame]:
    """Nodes (id, kind, name, description, paper_ids, chunk_ids) and edges (edge_id, src, dst, predicate, paper_id,
    chunk_id, support, confidence, evidence_text) of a knowledge base, and report (one row).

    Papers CONTAIN statements, statements REPORT the entities and papers they name, relationships keep their predicate. Of
    relationships with equal ends, type, paper and chunk the first (ord) counts, before their ends are looked up; without
    include_unsupported only SUPPORTED ones do. max_papers keeps the first papers by id.

    papers: paper_id, title, abstract; entities: entity_id, category, canonical_name, description, paper_ids, chunk_ids;
    statements: statement_id, category, normalized_statement, surface_text, paper_id, chunk_id, confidence_score,
    related_entity_ids; relationships: ord, relationship_id, source_id, target_id, relation_type, paper_id, chunk_id,
    evidence_support, confidence_score, evidence_text.
    """
    if max_papers is not None:
        papers = papers.orderBy("paper_id").limit(max_papers)
    no_chunks = F.array().cast("array<string>")
    p = papers.select(F.col("paper_id").alias("id"), F.lit("PAPER").alias("kind"), F.col("title").alias("name"), F.col("abstract").alias("description"), F.array("paper_id").alias("paper_ids"), no_chunks.alias("chunk_ids"))
    e = entities.select(F.col("entity_id").alias("id"), either(F.col("category"), NODE_TYPES, "METHOD").alias("kind"), F.col("canonical_name").alias("name"), "description", "paper_ids", "chunk_ids")
    said = F.col("normalized_statement")
    s = statements.select(F.col("statement_id").alias("id"), either(F.col("category"), NODE_TYPES, "STATEMENT").alias("kind"), F.left(said, F.lit(NAME_LENGTH)).alias("name"), said.alias("description"), F.array("paper_id").alias("paper_ids"), F.array("chunk_id").alias("chunk_ids"))
    nodes = p.unionByName(e).unionByName(s)

    def edge(id, src, dst, predicate, support, confidence, evidence):
        return [id.alias("edge_id"), src.alias("src"), dst.alias("dst"), predicate.alias("predicate"), F.col("paper_id"), F.col("chunk_id"), support.alias("support"), confidence.cast("double").alias("confidence"), evidence.alias("evidence_text")]

    ok, text = F.lit("SUPPORTED"), F.col("surface_text")
    contains = statements.select(edge(F.concat(F.lit("edge_contain_"), "statement_id"), F.col("paper_id"), F.col("statement_id"), F.lit("CONTAINS"), ok, F.lit(1.0), text))
    contains = contains.join(p.select(F.col("id").alias("src")), "src", "left_semi")
    named = statements.withColumn("named", F.explode(F.array_distinct("related_entity_ids")))
    reports = named.select(edge(F.concat_ws("_", F.lit("edge_stmt_ent"), "statement_id", "named"), F.col("statement_id"), F.col("named"), F.lit("REPORTS"), ok, F.coalesce("confidence_score", F.lit(1.0)), text))
    reports = reports.join(p.unionByName(e).select(F.col("id").alias("dst")), "dst", "left_semi")
    support = F.when(F.col("evidence_support").isin(SUPPORT), F.col("evidence_support")).otherwise("NOT_ASSESSED")
    rels = relationships.withColumn("support", support)
    rels = rels if include_unsupported else rels.where("support = 'SUPPORTED'")
    key = ["source_id", "target_id", "relation_type", "paper_id", "chunk_id"]
    rest = [c for c in rels.columns if c not in (*key, "ord")]
    first = rels.groupBy(*key).agg(F.min_by(F.struct(*rest), "ord").alias("m"), F.count(F.lit(1)).alias("times")).select(*key, "times", "m.*")
    semantic = first.select(*edge(F.col("relationship_id"), F.col("source_id"), F.col("target_id"), either(F.col("relation_type"), PREDICATES, "ADDRESSES"), F.col("support"), F.coalesce("confidence_score", F.lit(1.0)), F.col("evidence_text")), "times")
    whole = referential(semantic, nodes)
    columns = contains.columns
    edges = contains.unionByName(reports).unionByName(whole.select(columns))
    report = nodes.agg(F.count(F.lit(1)).alias("nodes")).join(F.broadcast(semantic.agg(F.sum(F.col("times") - 1).alias("duplicates"), F.count(F.lit(1)).alias("distinct"))))
    total = edges.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("support") == "SUPPORTED").alias("trusted"))
    report = report.join(F.broadcast(total)).join(F.broadcast(whole.agg(F.count(F.lit(1)).alias("whole"))))  # one row each
    lost = F.col("distinct") - F.col("whole")
    rate = F.when(F.col("edges") + lost == 0, 1.0).otherwise(F.round(F.col("edges") / (F.col("edges") + lost), 4))
    return {"nodes": nodes, "edges": edges, "report": report.select("nodes", "edges", "trusted", (F.col("edges") - F.col("trusted")).alias("untrusted"), F.coalesce("duplicates", F.lit(0)).alias("duplicates"), lost.alias("dangling"), rate.alias("integrity"))}


def ablation(candidates: DataFrame, *args: Column, name: str = "name", top: int = 5) -> DataFrame:
    """Configuration, candidates, top_candidate, top_score, scores of the best candidates under each configuration. args:
    those of score()."""
    every = F.array(*[F.struct(F.lit(k).alias("configuration"), score(*args, off=off).alias("score")) for k, off in CONFIGURATIONS.items()])
    rows = candidates.select(F.col(name).alias("name"), F.explode(every).alias("x")).select("name", "x.*")
    best = rows.withColumn("rank", F.row_number().over(Window.partitionBy("configuration").orderBy(F.desc("score"), "name"))).where(F.col("rank") <= top)
    out = best.groupBy("configuration").agg(F.sort_array(F.collect_list(F.struct("rank", "name", "score"))).alias("best"))
    return out.select("configuration", F.size("best").alias("candidates"), F.col("best")[0]["name"].alias("top_candidate"), F.col("best")[0]["score"].alias("top_score"), F.transform("best", lambda x: x["score"]).alias("scores"))


def referential(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")


def visual(nodes: DataFrame, edges: DataFrame, trusted_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, kind) and edges for drawing. trusted_only drops edges that are not SUPPORTED; nodes all stay."""
    kept = edges.where(F.col("support") == "SUPPORTED") if trusted_only else edges
    return nodes.select("id", F.col("name").alias("label"), "kind"), kept.select("src", "dst", "predicate")


def edge_evidence(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends' names and kinds, null where an end is missing."""
    out = edges
    for side in ("src", "dst"):
        out = out.join(nodes.select(F.col("id").alias(side), F.col("name").alias(f"{side}_name"), F.col("kind").alias(f"{side}_kind")), side, "left")
    return out


def of_kind(nodes: DataFrame, kind: str) -> DataFrame:
    """Nodes of a kind by id."""
    return nodes.where(F.col("kind") == kind).orderBy("id")


def neighbourhood(edges: DataFrame, start: DataFrame, depth: int, cut) -> DataFrame:
    """Id, hops from the start nodes, edges taken both ways. Only the frontier is joined each hop."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = start.select("id").withColumn("hops", F.lit(0))
    frontier = seen
    for hop in range(1, depth + 1):
        step = frontier.join(both, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        frontier = cut(step.join(seen, "id", "left_anti").withColumn("hops", F.lit(hop)))
        seen = seen.unionByName(frontier)
    return seen


def paths(edges: DataFrame, src: Column, dst: Column, depth: int, most: int) -> DataFrame:
    """Directed simple paths from src to dst of depth edges at most, the most first by length, then nodes."""
    step = edges.where(F.col("src") == src).select(F.array("src", "dst").alias("path"), F.col("dst").alias("at"))
    found = step.where(F.col("at") == dst)
    for _ in range(depth - 1):
        step = step.where(F.col("at") != dst).join(edges, F.col("at") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        step = step.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at"))
        found = found.unionByName(step.where(F.col("at") == dst))
    return found.distinct().orderBy(F.size("path"), "path").limit(most).select("path")


def bridges(edges: DataFrame) -> DataFrame:
    """A -> b -> c with another c than a."""
    first = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return first.join(edges.select(F.col("src").alias("b"), F.col("dst").alias("c")), "b").where("a <> c")


def score(similarity: Column, evidence: Column, papers: Column, other_domain: Column, mechanism: Column, contradictions: Column, shared: Column, off: tuple = ()) -> Column:
    """Weighted positives less penalties, 0 to 1, 4 digits. off: components replaced by their neutral value."""
    parts = {
        "similarity": similarity, "evidence": F.least(F.lit(1.0), evidence / 4), "diversity": F.least(F.lit(1.0), papers / 3),
        "distance": F.when(other_domain, 0.9).otherwise(0.3), "mechanism": F.when(mechanism, 0.85).otherwise(0.40),
    }
    total = sum(WEIGHTS.values())
    out = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        value = F.lit(0.40 if name == "mechanism" else 0.5) if name in off else parts[name]
        out = out + value * weight
    out = out / total
    if "contradiction" not in off:
        out = out - F.least(F.lit(1.0), contradictions * 0.35) * CONTRADICTION
    if "redundancy" not in off:
        out = out - F.when(shared, 0.8).otherwise(0.0) * REDUNDANCY
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), out)), 4)
