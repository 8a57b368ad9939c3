"""Queries over dossiers, negative knowledge and graph listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dossiers, graphs, retrieval
from .catalog import query
from .engine import BM25, RANK, asked
from .scalars import read, tokens_sql

c = F.col


def parts(spark, sf_dir):
    nodes = read(spark, sf_dir, "part").select(c("p_partkey").cast("string").alias("id"), c("p_name").alias("name"), c("p_type").alias("kind"))
    support = F.when(c("l_discount") > 0.05, "SUPPORTED").otherwise("UNSUPPORTED")
    edges = read(spark, sf_dir, "lineitem").select(c("l_suppkey").cast("string").alias("src"), c("l_partkey").cast("string").alias("dst"), c("l_returnflag").alias("predicate"), support.alias("support"))
    return nodes, edges


@query("G2_trusted_export", "SELECT predicate, sum(n)::BIGINT AS n FROM (SELECT l_returnflag AS predicate, count(*) AS n FROM lineitem WHERE l_discount > 0.05 GROUP BY ALL UNION ALL SELECT 'NODE', count(*) FROM part) GROUP BY predicate")
def g2(spark, sf_dir):
    nodes, edges = graphs.visual(*parts(spark, sf_dir), trusted_only=True)
    return edges.select("predicate").unionByName(nodes.select(F.lit("NODE").alias("predicate"))).groupBy("predicate").agg(F.count(F.lit(1)).alias("n"))


@query("G5_edge_evidence", "SELECT s.p_type AS src_kind, d.p_type AS dst_kind, count(*) AS n FROM lineitem LEFT JOIN part s ON l_suppkey = s.p_partkey LEFT JOIN part d ON l_partkey = d.p_partkey GROUP BY ALL")
def g5(spark, sf_dir):
    nodes, edges = parts(spark, sf_dir)
    return graphs.edge_evidence(edges, nodes).groupBy("src_kind", "dst_kind").agg(F.count(F.lit(1)).alias("n"))


@query("G6_nodes_of_kind", "SELECT p_partkey::VARCHAR AS id, p_name AS name FROM part WHERE p_type = 'ECONOMY'")
def g6(spark, sf_dir):
    return graphs.of_kind(parts(spark, sf_dir)[0], "ECONOMY").select("id", "name")


CATEGORIES = ["LIMITATION", "FAILURE_MODE", "RESULT", "CLAIM"]


def statements(spark, sf_dir):
    category = F.element_at(F.array(*map(F.lit, CATEGORIES)), (c("doc_id") % 4 + 1).cast("int"))
    related = F.when(c("doc_id") % 7 == 0, F.array(c("doc_id").cast("string"))).otherwise(F.array().cast("array<string>"))
    return read(spark, sf_dir, "documents").select(c("doc_id").cast("string").alias("id"), c("source").alias("paper"), category.alias("category"), "text", related.alias("related"))


def records(spark, sf_dir):
    entities = read(spark, sf_dir, "part").select(c("p_partkey").alias("id"), c("p_name").alias("name"))
    kind = F.expr("case l_returnflag when 'R' then 'LIMITED_BY' when 'A' then 'CONTRADICTS' else 'USES' end")
    ident = F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey")
    rel = read(spark, sf_dir, "lineitem").select(ident.alias("id"), c("l_orderkey").alias("paper"), kind.alias("kind"), (c("l_suppkey") * 30).cast("string").alias("source"), c("l_partkey").cast("string").alias("target"), F.lit(None).cast("string").alias("evidence"))
    return dossiers.negative_index(statements(spark, sf_dir), rel, entities)


ANY = lambda x, words: "(" + " OR ".join(f"contains(lower({x}), '{w}')" for w in words) + ")"
NEGATIVE = f"""s AS (SELECT doc_id, doc_id::VARCHAR AS id, ['LIMITATION', 'FAILURE_MODE', 'RESULT', 'CLAIM'][doc_id % 4 + 1] AS category, text, source AS paper FROM documents),
neg AS (SELECT 'neg_stmt_' || id AS record_id, coalesce(CASE WHEN doc_id % 7 = 0 THEN p_name END, 'scientific method') AS concept,
  CASE WHEN {ANY('text', dossiers.COSTLY)} THEN 'COMPUTATIONAL_BOTTLENECK' WHEN {ANY('text', dossiers.ASSUMING)} THEN 'ASSUMPTION_FAILURE' WHEN category = 'LIMITATION' THEN 'METHOD_LIMITATION' ELSE 'EMPIRICAL_REGRESSION' END AS category, text AS description
  FROM s LEFT JOIN part ON p_partkey = doc_id WHERE category IN ('LIMITATION', 'FAILURE_MODE')
UNION ALL SELECT concat_ws('_', 'neg_rel', l_orderkey, l_linenumber, l_partkey), sn, CASE WHEN l_returnflag = 'A' THEN 'CONTRADICTION' WHEN {ANY('tn', dossiers.COSTLY[:2])} THEN 'COMPUTATIONAL_BOTTLENECK' ELSE 'METHOD_LIMITATION' END, sn || ' is held back by ' || tn
  FROM (SELECT *, coalesce(a.p_name, (l_suppkey * 30)::VARCHAR) AS sn, coalesce(b.p_name, l_partkey::VARCHAR) AS tn FROM lineitem LEFT JOIN part a ON a.p_partkey = l_suppkey * 30 LEFT JOIN part b ON b.p_partkey = l_partkey WHERE l_returnflag IN ('A', 'R')))"""


@query("G14_negative_index", f"WITH {NEGATIVE} SELECT concept, category, count(*) AS n, min(sha256(description)) AS least FROM neg GROUP BY ALL")
def g14(spark, sf_dir):
    return records(spark, sf_dir).groupBy("concept", "category").agg(F.count(F.lit(1)).alias("n"), F.min(F.sha2("description", 256)).alias("least"))


MET = """m AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS method FROM part), met AS (SELECT * FROM neg JOIN m ON contains(lower(trim(concept)), lower(trim(method))) OR contains(lower(trim(method)), lower(trim(concept))))"""


def met(spark, sf_dir):
    return dossiers.limitations(records(spark, sf_dir), read(spark, sf_dir, "part").select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("method")))


@query("G15_limitations", f"WITH {NEGATIVE}, {MET} SELECT method, category, count(*) AS n FROM met GROUP BY ALL")
def g15(spark, sf_dir):
    return met(spark, sf_dir).groupBy("method", "category").agg(F.count(F.lit(1)).alias("n"))


@query("G16_contradiction_risk", f"WITH {NEGATIVE}, {MET} SELECT method, count(*) AS n FROM met WHERE contains(lower(description), 'small') OR contains(lower(description), 'widget') GROUP BY ALL")
def g16(spark, sf_dir):
    return dossiers.contradiction_risk(met(spark, sf_dir), F.lit("Small and widget")).groupBy("method").agg(F.count(F.lit(1)).alias("n"))


SOLVED, STILL, FAILED = ["there", "dans"], ["ouron", "que"], ["haus", "der"]
GAPS = f"""WITH {BM25}, s AS (SELECT doc_id, ['LIMITATION', 'FAILURE_MODE', 'RESULT', 'CLAIM'][doc_id % 4 + 1] AS category, text FROM documents),
g AS (SELECT item_id AS gid, {tokens_sql('text')} AS t FROM benchmark),
h AS (SELECT qid AS gid, id, score FROM scores QUALIFY {RANK} <= 10),
f AS (SELECT gid, CASE WHEN len(list_filter(t[1:3], lambda x: contains(lower(text), x))) >= 2 AND {ANY('text', SOLVED)} AND score > 0.65 THEN 'P' WHEN {ANY('text', STILL)} THEN 'S' END AS r FROM h JOIN g USING (gid) JOIN documents ON doc_id = id
UNION ALL SELECT gid, CASE WHEN category <> 'RESULT' THEN 'S' WHEN {ANY('text', FAILED)} THEN 'C' END FROM s JOIN g ON len(list_filter(t, lambda x: contains(lower(text), x))) >= 2 WHERE category <> 'CLAIM'),
n AS (SELECT gid, count(*) FILTER (r = 'P') AS precedents, count(*) FILTER (r = 'C') AS contradictions, count(*) FILTER (r = 'S') AS supporting FROM f GROUP BY gid)
SELECT gid, coalesce(precedents, 0) AS precedents, coalesce(contradictions, 0) AS contradictions, coalesce(supporting, 0) AS supporting, coalesce(hits, 0) AS hits,
  CASE WHEN precedents > 0 THEN 'EVIDENCE_AGAINST_GAP' WHEN contradictions > 0 THEN 'REQUIRES_REVIEW' WHEN coalesce(supporting, 0) = 0 AND coalesce(hits, 0) < 2 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'POSSIBLE_GAP' END AS status
FROM g LEFT JOIN n USING (gid) LEFT JOIN (SELECT gid, count(*) AS hits FROM h GROUP BY gid) USING (gid)"""


@query("G13_gap_dossiers", GAPS.replace("SELECT gid, coalesce(precedents", "SELECT g.gid, coalesce(precedents"))
def g13(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", c("source").alias("paper"))
    hits = retrieval.top_k(retrieval.bm25(docs.select("doc_id", "text"), asked(spark, sf_dir)), 10).select(c("qid").alias("gid"), "id", "score")
    titles = spark.createDataFrame([("src0", "First source")], "paper string, title string")
    gaps = read(spark, sf_dir, "benchmark").select(c("item_id").alias("gid"), "text")
    return dossiers.verify_gaps(gaps, hits, docs.withColumnRenamed("doc_id", "id"), statements(spark, sf_dir), titles, SOLVED, STILL, FAILED)[0]


PROBLEM = "patient heinre ouron thtion"
NAME = "lower(regexp_extract(text, '[A-Za-z]+', 0))"
ASKS = BM25.replace(f"unnest({tokens_sql('text')}) AS term FROM benchmark", "unnest(" + tokens_sql(f"{NAME} || ' {PROBLEM}'") + f") AS term FROM benchmark WHERE item_id % 3 > 0")


def methods(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select(c("item_id").alias("id"), F.expr(NAME).alias("name"), F.expr("if(item_id % 3 = 0, 'Healthcare & Oncology', 'GENERAL')").alias("domain"), F.expr("concat('src', item_id % 5)").alias("paper"), (c("item_id") % 4).alias("evidence"))


@query("G9_G11_transfers", f"""WITH {ASKS}, h AS (SELECT qid, id FROM scores QUALIFY {RANK} <= 3), m AS (SELECT item_id AS id, {NAME} AS name, 'src' || (item_id % 5) AS paper, item_id % 4 AS evidence FROM benchmark WHERE item_id % 3 > 0),
o AS (SELECT m.id, name, evidence + count(documents.doc_id) AS evidence, coalesce(bool_or(contains(lower(documents.text), name)), false) AS named, coalesce(bool_or(source = paper), false) AS shared, count(DISTINCT source) + CASE WHEN coalesce(bool_or(source = paper), false) THEN 0 ELSE 1 END AS papers
  FROM m LEFT JOIN h ON qid = m.id LEFT JOIN documents ON doc_id = h.id GROUP BY m.id, name, evidence),
x AS (SELECT id, name, evidence, round(greatest(0, least(1, 0.25 * CASE WHEN named THEN 0.75 ELSE 0.45 END + 0.25 * least(1, evidence / 4) + 0.2 * least(1, papers / 3) + 0.2 * 0.9 + 0.1 * 0.85 - CASE WHEN shared THEN 0.32 ELSE 0 END)), 4)::DOUBLE AS score FROM o)
SELECT id, name, evidence, score FROM x WHERE score >= 0.35 ORDER BY score DESC, id LIMIT 5""")
def g9(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", c("source").alias("paper"))
    return dossiers.transfers(methods(spark, sf_dir), PROBLEM, docs).select("id", "name", "evidence", "score")


@query("G8_rationale", "SELECT l_orderkey, l_linenumber, l_partkey, concat_ws(' ', CASE WHEN l_returnflag = 'R' THEN 'The fields lie far apart.' ELSE 'Both lie in one field.' END, CASE WHEN l_linestatus = 'O' THEN 'A paper already has both.' ELSE 'No paper has both yet.' END, CASE WHEN l_tax > 0 THEN printf('Contradictions cost %.2f.', l_tax) END, printf('Evidence: %d excerpts of %d papers.', l_linenumber, l_linenumber + 1)) AS why FROM lineitem")
def g8(spark, sf_dir):
    why = dossiers.rationale(c("l_returnflag") == "R", c("l_linestatus") == "O", c("l_tax"), c("l_linenumber"), c("l_linenumber") + 1)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", why.alias("why"))


REVIEW = """WITH x AS (SELECT o_orderkey, o_orderkey % 6 AS ev, length(trim(o_orderpriority)) > 8 AND o_orderkey % 5 > 0 AS specific, o_orderkey % 2 = 0 AS base, o_orderkey % 11 > 0 AS far, o_orderkey % 7 > 0 AS assumed, o_orderkey % 13 > 0 AS mech, o_orderkey % 17 > 0 AS fails, o_orderkey % 19 > 0 AS vars, o_orderkey % 3 > 0 AS rigor FROM orders),
y AS (SELECT *, (ev < 2)::INT + (NOT fails)::INT AS critical, (NOT specific)::INT + (NOT far)::INT + (NOT assumed)::INT + (NOT mech)::INT + (NOT vars)::INT AS major, (NOT base)::INT + (NOT rigor)::INT AS minor FROM x)
SELECT o_orderkey, critical + major + minor AS weaknesses, CASE WHEN critical > 0 THEN 'CRITICAL' WHEN major > 0 THEN 'MAJOR' WHEN minor > 0 THEN 'MINOR' END AS worst,
  round((CASE WHEN specific THEN 8.5 ELSE 4 END + CASE WHEN ev >= 4 THEN 9 WHEN ev >= 2 THEN 7 ELSE 3.5 END + CASE WHEN base THEN 7.5 ELSE 6 END + CASE WHEN far THEN 8 ELSE 4 END + CASE WHEN assumed THEN 8 ELSE 5 END + CASE WHEN mech THEN 8.5 ELSE 4.5 END + CASE WHEN fails THEN 8 ELSE 4 END + CASE WHEN vars THEN 9 ELSE 5 END + 7.5 + CASE WHEN rigor THEN 9.5 ELSE 6 END) / 10, 2)::DOUBLE AS overall,
  CASE WHEN critical > 0 THEN 'REJECTED' WHEN major >= 2 THEN 'MAJOR_REVISION' WHEN ev < 3 THEN 'NEEDS_MORE_EVIDENCE' ELSE 'PROMISING_BUT_UNVERIFIED' END AS verdict FROM y"""


@query("G18_A23_review", REVIEW)
def g18(spark, sf_dir):
    rows, e = read(spark, sf_dir, "orders"), F.expr
    some = lambda k: e(f"if(o_orderkey % {k} > 0, array('a', 'b'), array())")
    out = dossiers.review(
        rows, e("if(length(trim(o_orderpriority)) > 8 and o_orderkey % 5 > 0, 'a problem of some length', 'short')"), c("o_orderkey") % 6, e("if(o_orderkey % 2 = 0, array('Standard'), array('other'))"), F.lit("Method"), e("if(o_orderkey % 11 > 0, 'target', 'method')"),
        some(7), e("if(o_orderkey % 13 > 0, 'a Gradient step', 'likeness')"), some(17), some(19), some(19), e("if(o_orderkey % 3 > 0, '5% at p < 0.05', 'none')"),
    )
    return out.select("o_orderkey", F.size("weaknesses").alias("weaknesses"), F.try_element_at("weaknesses", F.lit(1))["severity"].alias("worst"), "overall", "verdict")


@query("G17_G19_G20_workflow")
def g20(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", c("source").alias("paper"))
    titles = spark.createDataFrame([("src0", "First source")], "paper string, title string")
    out = dossiers.workflow(methods(spark, sf_dir), PROBLEM, docs, statements(spark, sf_dir), titles, records(spark, sf_dir))
    return out.select("id", "hypothesis_id", "title", "score", "gap_status", "verdict", "overall", F.col("plan.plan_id").alias("plan_id"), "final_status")
