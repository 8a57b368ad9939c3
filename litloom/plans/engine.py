"""Queries over retrieval, linkage, knowledge base, graph and metric operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import documents, graphs, knowledge, linkage, metrics, retrieval
from ..storage import cut
from .catalog import query
from .scalars import LIST, read, tokens_sql, whole_texts

c = F.col
ASK = "SELECT item_id AS qid, text FROM benchmark"


def asked(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select(c("item_id").alias("qid"), "text")


BM25 = f"""
d AS (SELECT doc_id AS id, {tokens_sql('text')} AS terms FROM documents),
corpus AS (SELECT count(*) AS n, avg(len(terms)) AS mean FROM d),
tf AS (SELECT id, size, term, count(*) AS tf FROM (SELECT id, len(terms) AS size, unnest(terms) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT qid, term, count(*) AS times FROM (SELECT item_id AS qid, unnest({tokens_sql('text')}) AS term FROM benchmark) GROUP BY ALL),
scores AS (
  SELECT qid, id, sum(greatest(ln((n - df + 0.5) / (df + 0.5) + 1), 0) * times * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / mean))) AS score
  FROM q JOIN df USING (term) JOIN tf USING (term), corpus GROUP BY qid, id
)"""
RANK = "row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id)"


def lexical(spark, sf_dir, k):
    return retrieval.top_k(retrieval.bm25(whole_texts(spark, sf_dir), asked(spark, sf_dir)), k)


@query("W1_bm25_topk", f"WITH {BM25} SELECT qid, id, rank, round(score, 4) AS score FROM (SELECT *, {RANK} AS rank FROM scores) WHERE rank <= 10")
def w1(spark, sf_dir):
    return lexical(spark, sf_dir, 10).select("qid", "id", "rank", F.round("score", 4).alias("score"))


@query("J12_A13_bm25_scores", f"WITH {BM25} SELECT qid, count(*) AS hits, round(sum(score), 3) AS total FROM scores GROUP BY qid")
def j12(spark, sf_dir):
    return retrieval.bm25(whole_texts(spark, sf_dir), asked(spark, sf_dir)).groupBy("qid").agg(F.count(F.lit(1)).alias("hits"), F.round(F.sum("score"), 3).alias("total"))


@query("A12_term_statistics", f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT id, term, count(*) AS tf FROM (SELECT doc_id AS id, unnest({tokens_sql('text')}) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def a12(spark, sf_dir):
    return retrieval.postings(whole_texts(spark, sf_dir)).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").cast("long").alias("cf"))


VECTORS = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings), near AS (SELECT a.id AS qid, b.id, round(list_cosine_similarity(a.e, b.e), 9) AS score, a.label = b.label AS hit FROM v a JOIN v b ON a.id % 50 = 0)"


def vectors(spark, sf_dir):
    docs = read(spark, sf_dir, "embeddings").select(c("vec_id").alias("id"), c("embedding").alias("vector"), "label")
    return docs, docs.where("id % 50 = 0").select(c("id").alias("qid"), "vector", c("label").alias("of"))


@query("W2_dense_topk", f"WITH {VECTORS} SELECT qid, id, rank, round(score, 4) AS score FROM (SELECT *, {RANK} AS rank FROM near) WHERE rank <= 10")
def w2(spark, sf_dir):
    docs, asks = vectors(spark, sf_dir)
    return retrieval.top_k(retrieval.dense(docs, asks), 10).select("qid", "id", "rank", F.round("score", 4).alias("score"))


HALF = "SELECT qid, id, score FROM scores"


@query("W3_J13_rank_fusion", f"""WITH {BM25}, a AS (SELECT qid, id, {RANK} AS r FROM scores QUALIFY r <= 20),
b AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY id) AS r FROM scores QUALIFY r <= 20),
f AS (SELECT qid, id, round(sum(1.0 / (60 + r)), 5) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY qid, id)
SELECT qid, id, score, {RANK} AS rank FROM f QUALIFY rank <= 10""")
def w3(spark, sf_dir):
    scores = retrieval.bm25(whole_texts(spark, sf_dir), asked(spark, sf_dir))
    by_id = retrieval.top_k(scores.withColumn("score", F.lit(0.0)), 20)
    return retrieval.fuse(retrieval.top_k(scores, 20), by_id, k=10).select("qid", "id", "score", "rank")


@query("W4_list_overlap", f"""WITH {BM25}, a AS (SELECT qid, id, {RANK} AS r FROM scores QUALIFY r <= 10),
b AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY id) AS r FROM scores QUALIFY r <= 10)
SELECT qid, round(count(*) FILTER (n = 2) / count(*), 6) AS jaccard FROM (SELECT qid, id, count(*) AS n FROM (SELECT qid, id FROM a UNION ALL SELECT qid, id FROM b) GROUP BY ALL) GROUP BY qid""")
def w4(spark, sf_dir):
    scores = retrieval.bm25(whole_texts(spark, sf_dir), asked(spark, sf_dir))
    return retrieval.overlap(retrieval.top_k(scores, 10), retrieval.top_k(scores.withColumn("score", F.lit(0.0)), 10))


@query("A20_ranking_metrics", f"""WITH {VECTORS}, r AS (SELECT *, {RANK} AS rank FROM near), t AS (SELECT qid, count(*) FILTER (hit) AS total FROM near GROUP BY qid),
x AS (SELECT qid, count(*) FILTER (hit) AS hits, sum(CASE WHEN hit THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, min(rank) FILTER (hit) AS first FROM r WHERE rank <= 10 GROUP BY qid)
SELECT qid, round(hits / 10, 6) AS precision, round(hits / total, 6) AS recall,
  round(CASE WHEN hits > 0 THEN dcg / list_sum(list_transform(range(1, hits + 1), lambda i: 1 / log2(i + 1))) ELSE 0.0 END, 6) AS ndcg, round(coalesce(1 / first, 0.0), 6)::DOUBLE AS rr
FROM x JOIN t USING (qid)""")
def a20(spark, sf_dir):
    docs, asks = vectors(spark, sf_dir)
    labels = docs.select("id", "label")
    top = retrieval.top_k(retrieval.dense(docs, asks), 10).join(labels, "id").join(asks.select("qid", "of"), "qid")
    top = top.withColumn("hit", (c("label") == c("of")).cast("int"))
    total = labels.groupBy("label").agg(F.count(F.lit(1)).alias("total")).join(asks.select("qid", c("of").alias("label")), "label").select("qid", "total")
    return retrieval.ranking_metrics(top, total, 10)


KEY = r"trim(regexp_replace(regexp_replace(replace(lower(strip_accents(text)), '-', ' '), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'))"


@query("J6_components", f"""WITH RECURSIVE k AS (SELECT doc_id AS id, {KEY} AS t, n_chars::VARCHAR || lang AS s FROM documents),
g AS (SELECT id, min(id) OVER (PARTITION BY t) AS a FROM k)
SELECT id, a AS component FROM g""")
def j6(spark, sf_dir):
    docs = cut(whole_texts(spark, sf_dir).select(c("doc_id").alias("id"), F.sha2(T.title_key(c("text")), 256).alias("k")))
    return linkage.components(docs, linkage.match_edges(docs, ["k"]), cut)


@query("A24_copies", "SELECT sha256(text) AS key, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def a24(spark, sf_dir):
    return linkage.groups_of(read(spark, sf_dir, "documents"), F.sha2("text", 256))


@query("A2_first_wins", "SELECT l_orderkey, l_partkey, l_linenumber, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) = 1")
def a2(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    return linkage.first_wins(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_quantity"])


RECORDS = """r AS (SELECT CASE WHEN doc_id % 13 > 0 THEN concat('r', doc_id) END AS record_id, ['METHOD', 'CLAIM', 'DOMAIN', 'RESULT', 'NOVELTY'][doc_id % 5 + 1] AS category, CASE WHEN source = 'src3' THEN '  ' ELSE source END AS surface,
  CASE WHEN doc_id % 17 > 0 THEN text ELSE '' END AS text, CASE WHEN doc_id % 11 > 0 THEN n_chars % 7 - 1 END AS a, length(text) - CASE WHEN doc_id % 19 = 0 THEN 1000000 ELSE 0 END AS b, CASE WHEN lang = 'de' THEN '' ELSE lang END AS chunk FROM documents),
v AS (SELECT *, CASE WHEN category IN ('METHOD', 'DOMAIN') THEN 'ENTITY' WHEN category = 'NOVELTY' THEN 'UNKNOWN' ELSE 'STATEMENT' END AS record_type,
  CASE WHEN category = 'NOVELTY' OR record_id IS NULL OR trim(surface) = '' THEN 'SCHEMA_VALIDATION_ERROR' WHEN NOT regexp_matches(text, '\\S') THEN 'UNGROUNDED_EVIDENCE' WHEN a IS NULL OR a < 0 OR b < a THEN 'INVALID_SPAN_BOUNDS' WHEN chunk = '' THEN 'MISSING_PROVENANCE_FIELD' END AS reason FROM r)"""


def records(spark, sf_dir):
    """Extraction records of whole documents, some of them broken."""
    e = F.expr
    evidence = F.struct(e("if(doc_id % 17 > 0, text, '')").alias("text"), e("if(doc_id % 11 > 0, n_chars % 7 - 1, null)").alias("start_char"), e("length(text) - if(doc_id % 19 = 0, 1000000, 0)").alias("end_char"))
    provenance = F.struct(F.concat(F.lit("c"), "doc_id").alias("canonical_id"), e("if(lang = 'de', '', lang)").alias("chunk_id"), c("source").alias("document_id"))
    return read(spark, sf_dir, "documents").select(
        e("if(doc_id % 13 > 0, concat('r', doc_id), null)").alias("record_id"), e("element_at(array('METHOD', 'CLAIM', 'DOMAIN', 'RESULT', 'NOVELTY'), int(doc_id % 5) + 1)").alias("category"),
        e("if(source = 'src3', '  ', source)").alias("surface_text"), evidence.alias("evidence"), provenance.alias("provenance"),
    )


@query("P3_P5_quarantine", f"WITH {RECORDS} SELECT record_type, reason, count(*) AS n FROM v WHERE reason IS NOT NULL GROUP BY ALL")
def p5(spark, sf_dir):
    return knowledge.quarantined(knowledge.validate_records(records(spark, sf_dir))).groupBy("record_type", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("P6_valid_branch", f"WITH {RECORDS} SELECT record_id, record_type, sha256(text) AS evidence FROM v WHERE reason IS NULL")
def p6(spark, sf_dir):
    return knowledge.validate_records(records(spark, sf_dir)).where("reason is null").select("record_id", "record_type", F.sha2("evidence.text", 256).alias("evidence"))


@query("P7_P8_relations", """WITH k AS (SELECT concat('s', s_suppkey) AS ref, 'ENTITY' AS kind FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT concat('p', p_partkey), 'STATEMENT' FROM part WHERE p_size > 5 UNION ALL SELECT concat('u', p_partkey), 'STATEMENT' FROM part WHERE p_size > 5),
r AS (SELECT l_linenumber, l_returnflag, l_linestatus, l_quantity, CASE WHEN l_orderkey % 10 > 0 THEN concat('s', l_suppkey) END AS a, concat(CASE WHEN l_partkey % 2 = 0 THEN 'u' ELSE 'p' END, l_partkey) AS b FROM lineitem)
SELECT reason, target_kind, count(*) AS n FROM (SELECT CASE WHEN l_returnflag = 'N' OR a IS NULL THEN 'SCHEMA_VALIDATION_ERROR' WHEN x.ref IS NULL OR y.ref IS NULL THEN 'DANGLING_RELATION_ENDPOINT' WHEN l_linenumber = 1 THEN 'UNGROUNDED_EVIDENCE'
  WHEN l_quantity < 10 THEN 'INVALID_SPAN_BOUNDS' WHEN l_linestatus = 'O' THEN 'MISSING_PROVENANCE_FIELD' END AS reason, y.kind AS target_kind FROM r LEFT JOIN k x ON a = x.ref LEFT JOIN k y ON b = y.ref) GROUP BY ALL""")
def p7(spark, sf_dir):
    e = F.expr
    suppliers = read(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("s"), "s_suppkey").alias("id"))
    parts = read(spark, sf_dir, "part").where("p_size > 5").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.concat(F.lit("u"), "p_partkey").alias("up"))
    known = knowledge.references(suppliers, parts.select("id"), parts.select(c("up").alias("id"), c("id").alias("kb_id")))
    rows = read(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("relation_id"), e("if(l_returnflag = 'R', 'USES', if(l_returnflag = 'A', 'IMPROVES', 'EATS'))").alias("relation_type"),
        e("if(l_orderkey % 10 > 0, concat('s', l_suppkey), null)").alias("source_id"), e("concat(if(l_partkey % 2 = 0, 'u', 'p'), l_partkey)").alias("target_id"),
        F.struct(e("if(l_linenumber = 1, ' ', l_returnflag)").alias("text"), F.lit(10).alias("start_char"), e("int(l_quantity)").alias("end_char")).alias("evidence"),
        F.struct(F.lit("p").alias("canonical_id"), e("if(l_linestatus = 'O', null, 'c')").alias("chunk_id"), F.lit("d").alias("document_id")).alias("provenance"),
    )
    return knowledge.validate_relations(rows, known).groupBy("reason", "target_kind").agg(F.count(F.lit(1)).alias("n"))


@query("U1_U2_versions", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_brand END AS text, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS src_order FROM part")
def u2(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    a, b = part.select("p_partkey", c("p_brand").alias("text")), part.where("p_size % 2 = 0").select("p_partkey", c("p_type").alias("text"))
    last = knowledge.versions(a, b).groupBy("p_partkey").agg(F.max("src_order").alias("src_order"))
    return knowledge.later_wins(a, b, key="p_partkey").select("p_partkey", "text").join(last, "p_partkey")


@query("KBQ_chunk_records", "SELECT 'mentions' AS part, count(*) AS n FROM part WHERE p_brand = 'Brand#11' UNION ALL SELECT 'statements', least(5, count(*)) FROM part WHERE p_type = (SELECT min(p_type) FROM part)")
def kbq(spark, sf_dir):
    part = read(spark, sf_dir, "part").withColumnsRenamed({"p_brand": "chunk_id", "p_type": "extraction_version"})
    least = part.agg(F.min("extraction_version")).first()[0]
    own = knowledge.records_of_chunk("Brand#11", mentions=part)["mentions"]
    some = knowledge.filter_records({"statements": part}, limit=5, extractor_version=least)["statements"]
    count = lambda df, name: df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"))
    return count(own, "mentions").unionByName(count(some, "statements"))


@query("A1_entities", """WITH m AS (SELECT p_partkey AS id, p_type AS category, CASE WHEN p_size % 2 = 0 THEN 'even' ELSE p_brand END AS canonical, p_name AS surface, CASE WHEN p_size % 3 = 0 THEN p_brand END AS alias, CASE WHEN p_size = 4 THEN 'CONFIRMED' ELSE 'UNRESOLVED' END AS status, p_size FROM part)
SELECT category, canonical, count(*) AS mentions_count, concat('v', min(p_size % 3)) AS first_seen_version, CASE WHEN bool_or(status = 'CONFIRMED') THEN 'CONFIRMED' ELSE 'UNRESOLVED' END AS alias_status,
  array_to_string(list_sort(list_distinct(list('p' || (id % 7)))), ',') AS papers, len(list_distinct(list(id))) AS mention_ids, array_to_string(list_sort(list_distinct(list_concat(list(surface), list(alias) FILTER (alias IS NOT NULL)))), ',') AS aliases FROM m GROUP BY category, canonical""")
def a1_entities(spark, sf_dir):
    e = F.expr
    rows = read(spark, sf_dir, "part").select(
        c("p_partkey").cast("string").alias("mention_id"), c("p_type").alias("category"), e("if(p_size % 2 = 0, 'even', p_brand)").alias("canonical"), c("p_name").alias("surface_text"), e("if(p_size % 3 = 0, array(p_brand), null)").alias("aliases"),
        e("if(p_size = 4, 'CONFIRMED', 'UNRESOLVED')").alias("status"), e("concat('p', p_partkey % 7)").alias("paper_id"), e("concat('c', p_partkey % 9)").alias("chunk_id"), e("concat('v', p_size % 3)").alias("version"),
    )
    out = knowledge.entities_of(rows)
    return out.select("category", "canonical", "mentions_count", "first_seen_version", "alias_status", F.array_join("paper_ids", ",").alias("papers"), F.size("mention_ids").cast("long").alias("mention_ids"), F.array_join("aliases", ",").alias("aliases"))


def papers(spark, sf_dir):
    e = F.expr
    return read(spark, sf_dir, "orders").select(
        e("repeat('x', int(o_orderkey % 40))").alias("abstract"), e("if(o_orderkey % 3 = 0, '', 'd')").alias("doi"), e("if(o_orderkey % 4 = 0, null, 'a')").alias("arxiv_id"), e("if(o_orderkey % 5 = 0, array(), array('x'))").alias("authors"),
        e("array('r')").alias("references"), e("cast(null as array<string>)").alias("topics"), e("if(o_orderkey % 2 = 0, 'v', null)").alias("venue"), e("if(o_orderkey % 6 = 0, null, 'd')").alias("published_date"), e("if(o_orderkey % 12 = 0, null, year(o_orderdate))").alias("publication_year"),
        e("if(o_orderkey % 7 = 0, null, 0)").alias("citation_count"), e("element_at(array('DISCOVERABLE', 'DOWNLOADED', 'QUEUED'), int(o_orderkey % 3) + 1)").alias("fulltext_status"), e("if(o_orderkey % 9 = 2, 'f', null)").alias("fulltext_path"), c("o_orderpriority").alias("document_type"),
        e("if(o_orderkey % 2 = 0, array('openalex', 'arxiv'), array('arxiv'))").alias("sources"),
    )


@query("A5_manifest", """SELECT count(*) AS papers, count(*) FILTER (o_orderkey % 40 > 20) AS with_abstracts, count(*) FILTER (o_orderkey % 3 > 0) AS with_doi, count(*) FILTER (o_orderkey % 4 > 0) AS with_arxiv, count(*) FILTER (o_orderkey % 5 > 0) AS with_authors,
  count(*) FILTER (o_orderkey % 6 > 0 OR o_orderkey % 12 > 0) AS with_date, count(*) FILTER (o_orderkey % 7 > 0) AS with_citations, count(*) AS with_references, count(*) FILTER (o_orderkey % 2 = 0) AS with_venue, 0::BIGINT AS with_topics,
  count(*) FILTER (o_orderkey % 3 = 0) AS discoverable, count(*) FILTER (o_orderkey % 3 = 1 OR o_orderkey % 9 = 2) AS downloaded FROM orders""")
def a5(spark, sf_dir):
    return metrics.manifest(papers(spark, sf_dir))[0]


@query("A5_histograms", """SELECT 'document_type' AS kind, o_orderpriority AS value, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'source', 'arxiv', count(*) FROM orders UNION ALL SELECT 'source', 'openalex', count(*) FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT 'year', year(o_orderdate)::VARCHAR, count(*) FROM orders WHERE o_orderkey % 12 > 0 GROUP BY ALL""")
def a5_histograms(spark, sf_dir):
    return metrics.manifest(papers(spark, sf_dir))[1]


@query("J3_P7_endpoints", """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN s.s_suppkey IS NULL THEN 'DANGLING_SOURCE' WHEN p.p_partkey IS NULL THEN 'DANGLING_TARGET' END AS reason
FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) s ON l_suppkey = s_suppkey LEFT JOIN (SELECT * FROM part WHERE p_size > 5) p ON l_partkey = p_partkey) GROUP BY reason""")
def j3(spark, sf_dir):
    rels = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"))
    known = read(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.lit("SUPPLIER").alias("kind"))
    known = known.unionByName(read(spark, sf_dir, "part").where("p_size > 5").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.lit("PART").alias("kind")))
    return knowledge.endpoints(rels, known).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("J5_alias_resolution", "SELECT p_partkey, CASE p_brand WHEN 'Brand#11' THEN 'Brand#12' ELSE p_brand END AS canonical FROM part")
def j5(spark, sf_dir):
    aliases = spark.createDataFrame([("Brand#11", "Brand#12", "CONFIRMED"), ("Brand#13", "Brand#14", "CANDIDATE")], "p_brand string, canonical string, status string")
    return knowledge.resolve(read(spark, sf_dir, "part"), aliases, "p_brand").select("p_partkey", "canonical")


@query("A1_consolidate", "SELECT p_type AS category, count(*) AS mentions, array_to_string(list_sort(list_distinct(list(p_size))), ',') AS members, array_to_string(list_sort(list_distinct(list(p_brand))), ',') AS aliases FROM part GROUP BY p_type")
def a1(spark, sf_dir):
    parts = read(spark, sf_dir, "part").withColumnRenamed("p_type", "category")
    out = knowledge.consolidate(parts, ["category"], "p_size", "p_brand")
    return out.select("category", "mentions", F.array_join(c("members").cast("array<string>"), ",").alias("members"), F.array_join("aliases", ",").alias("aliases"))


@query("A3_paper_counts", "SELECT o_orderkey, count(l_orderkey) AS statements, count(DISTINCT l_partkey) AS entities FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def a3(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("statements"), F.count_distinct("l_partkey").alias("entities"))
    out = read(spark, sf_dir, "orders").select("o_orderkey").join(lines, c("o_orderkey") == c("l_orderkey"), "left")
    return out.select("o_orderkey", F.coalesce("statements", F.lit(0)).alias("statements"), F.coalesce("entities", F.lit(0)).alias("entities"))


@query("P14_ilike", "SELECT p_partkey, p_name FROM part WHERE p_type ILIKE '%StEEl%'")
def p14(spark, sf_dir):
    return read(spark, sf_dir, "part").where(c("p_type").ilike("%StEEl%")).select("p_partkey", "p_name")


@query("P15_dynamic_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def p15(spark, sf_dir):
    return knowledge.all_of(read(spark, sf_dir, "orders"), o_orderstatus="F", o_orderpriority="1-URGENT", o_custkey=None).select("o_orderkey")


@query("J1_J2_double_join", "SELECT s_name, p_name, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE p_size = 1 GROUP BY ALL")
def j1(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    parts = read(spark, sf_dir, "part").where("p_size = 1").select("p_partkey", "p_name")
    rows = rows.join(parts, c("l_partkey") == c("p_partkey")).join(read(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), c("l_suppkey") == c("s_suppkey"))
    return rows.groupBy("s_name", "p_name").agg(F.count(F.lit(1)).alias("n"))


@query("J9_year_range_join", "SELECT count(*) AS n FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_partkey < b.p_partkey AND abs(a.p_size - b.p_size) <= 1")
def j9(spark, sf_dir):
    return linkage.count_years_agree(read(spark, sf_dir, "part"), "p_name", "p_partkey", "p_size", missing=False)


@query("J17_U4_strict_match", "SELECT count(*) AS n FROM (SELECT doc_id, quality FROM labels INTERSECT SELECT doc_id, CASE WHEN n_chars > 300 THEN 1 ELSE 0 END FROM documents)")
def j17(spark, sf_dir):
    rule = read(spark, sf_dir, "documents").select("doc_id", F.when(c("n_chars") > 300, 1).otherwise(0).alias("quality"))
    return read(spark, sf_dir, "labels").select("doc_id", "quality").intersect(rule).agg(F.count(F.lit(1)).alias("n"))


@query("J19_A18_kappa", """WITH p AS (SELECT quality AS a, CASE WHEN n_chars > 300 THEN 1 ELSE 0 END AS b FROM labels JOIN documents USING (doc_id)),
s AS (SELECT count(*) AS n, avg((a = b)::INT) AS po FROM p), e AS (SELECT sum(x.n * y.n)::DOUBLE AS agree FROM (SELECT a AS v, count(*) AS n FROM p GROUP BY a) x JOIN (SELECT b AS v, count(*) AS n FROM p GROUP BY b) y USING (v))
SELECT n, round(po, 4) AS po, round(agree / (n * n), 4) AS pe, round((po - agree / (n * n)) / (1 - agree / (n * n)), 4) AS kappa FROM s, e""")
def a18(spark, sf_dir):
    rule = read(spark, sf_dir, "documents").select("doc_id", F.when(c("n_chars") > 300, 1).otherwise(0).alias("b"))
    return metrics.kappa(read(spark, sf_dir, "labels").join(rule, "doc_id").select(c("quality").alias("a"), "b"))


PR = """tp, round(coalesce(tp / nullif(p, 0), 0), 4) AS precision, round(coalesce(tp / nullif(a, 0), 0), 4) AS recall, round(CASE WHEN tp > 0 THEN 2 * (tp / p) * (tp / a) / (tp / p + tp / a) ELSE 0 END, 4) AS f1
FROM (SELECT lang, count(*) FILTER (x AND y) AS tp, count(*) FILTER (x) AS p, count(*) FILTER (y) AS a FROM (SELECT lang, n_chars > 1000 AS x, quality = 1 AS y FROM labels JOIN documents USING (doc_id)) GROUP BY lang)"""


@query("A15_A17_precision_recall", f"SELECT lang, {PR}")
def a15(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return metrics.precision_recall(rows.select("lang", (c("n_chars") > 1000).alias("predicted"), (c("quality") == 1).alias("actual")), "lang")


@query("A5_A6_completeness", "SELECT count(*) AS n, round(100 * count(*) FILTER (c_acctbal > 0) / count(*), 2) AS balance, round(100 * count(*) FILTER (c_mktsegment = 'BUILDING') / count(*), 2) AS building FROM customer")
def a6(spark, sf_dir):
    return metrics.completeness(read(spark, sf_dir, "customer"), balance=c("c_acctbal") > 0, building=c("c_mktsegment") == "BUILDING")


@query("A7_source_overlap", "WITH x AS (SELECT DISTINCT user_id, event_type FROM events) SELECT a.event_type, b.event_type AS other, count(*) AS n FROM x a JOIN x b USING (user_id) GROUP BY ALL")
def a7(spark, sf_dir):
    return metrics.overlap_matrix(read(spark, sf_dir, "events"), "user_id", "event_type")


@query("A10_chunk_stats", "SELECT lang, count(*) AS n, round(avg(length(text)), 1) AS mean, floor(median(length(text)))::BIGINT AS median, min(length(text)) AS least, max(length(text)) AS most, count(*) FILTER (length(text) > 2000) AS oversized, count(*) FILTER (length(text) < 150) AS tiny FROM documents GROUP BY lang")
def a10(spark, sf_dir):
    return metrics.chunk_stats(read(spark, sf_dir, "documents"), F.length("text").cast("long"), ["lang"])


@query("A26_run_comparison", "SELECT lang, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(b, 0) - coalesce(a, 0) AS delta FROM (SELECT lang, count(*) AS a FROM documents WHERE source < 'src15' GROUP BY lang) FULL JOIN (SELECT lang, count(*) AS b FROM documents WHERE source >= 'src15' GROUP BY lang) USING (lang)")
def a26(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return knowledge.compare_runs(docs.where("source < 'src15'"), docs.where("source >= 'src15'"), "lang")


@query("A22_recurring", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 3")
def a22(spark, sf_dir):
    return knowledge.recurring(read(spark, sf_dir, "events"), "event_type", 3)


@query("W6_W20_listing", "SELECT p_brand, count(*) AS mentions FROM part GROUP BY p_brand ORDER BY mentions DESC, p_brand LIMIT 10")
def w6(spark, sf_dir):
    return knowledge.listing(read(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("mentions")), "mentions", "p_brand", 10)


@query("W13_turn_islands", """SELECT conv_id, min(turn) AS first, max(turn) AS last, count(*) AS n FROM (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM conversations) GROUP BY conv_id, island""")
def w13(spark, sf_dir):
    island = F.sum((c("role") == "user").cast("int")).over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = read(spark, sf_dir, "conversations").withColumn("island", island)
    return rows.groupBy("conv_id", "island").agg(F.min("turn").alias("first"), F.max("turn").alias("last"), F.count(F.lit(1)).alias("n")).drop("island")


@query("W14_parent_assignment", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS parent FROM conversations")
def w14(spark, sf_dir):
    parent = F.last(F.when(c("role") == "user", c("turn")), ignorenulls=True).over(Window.partitionBy("conv_id").orderBy("turn"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", parent.alias("parent"))


LINES = "l AS (SELECT doc_id, line, p FROM (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) - 1 AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)))"


@query("W16_running_heads", rf"""WITH {LINES}, z AS (SELECT doc_id, p, line, CASE WHEN p % 5 = 0 THEN 'TOP' WHEN p % 5 = 4 THEN 'BOTTOM' END AS zone, lower(trim(regexp_replace(trim(line), '\b\d+\b', '#', 'g'))) AS key FROM l)
SELECT doc_id, p, zone, zone IS NOT NULL AND key <> '' AND count(*) OVER (PARTITION BY doc_id, zone, key) > 1 OR zone IS NOT NULL AND regexp_matches(lower(trim(line)), '^(\d+|[ivxlcdm]+)$')
  OR coalesce(zone, '') = 'BOTTOM' AND regexp_matches(lower(trim(line)), '(www\.[a-z0-9\-]+\.[a-z]+|issn:\s*\d|paper id:\s*[a-z0-9]+|doi:\s*https?://|copyright\b|all rights reserved)') AS furniture FROM z""")
def w16(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "text"))
    blocks = lines.select("doc_id", "p", F.expr("p div 5").alias("page"), "text", F.expr("double(p % 5) * 190").alias("y0"), F.expr("double(p % 5) * 190 + 10").alias("y1"), F.lit(800.0).alias("height"))
    return documents.running_heads(blocks).select("doc_id", "p", "zone", "furniture")


@query("E6_segments")
def e6_segments(spark, sf_dir):
    return documents.segment_rows(whole_texts(spark, sf_dir))


EDGES = "e AS (SELECT concat('c', c_custkey) AS src, concat('n', c_nationkey) AS dst FROM customer UNION SELECT concat('s', s_suppkey), concat('n', s_nationkey) FROM supplier UNION SELECT concat('n', n_nationkey), concat('r', n_regionkey) FROM nation)"


def graph(spark, sf_dir):
    e = lambda t, a, x, b, y: read(spark, sf_dir, t).select(F.concat(F.lit(a), x).alias("src"), F.concat(F.lit(b), y).alias("dst"))
    return e("customer", "c", "c_custkey", "n", "c_nationkey").unionByName(e("supplier", "s", "s_suppkey", "n", "s_nationkey")).unionByName(e("nation", "n", "n_nationkey", "r", "n_regionkey")).distinct()


def base(spark, sf_dir):
    """A knowledge base of suppliers (papers), parts (entities), orders (statements) and lines (relationships)."""
    e = F.expr
    p = read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("paper_id"), c("s_name").alias("title"), F.lit("").alias("abstract"))
    entities = read(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), "p_partkey").alias("entity_id"), e("element_at(array('method', 'DOMAIN', 'DATASET'), int(p_size % 3) + 1)").alias("category"), c("p_name").alias("canonical_name"), c("p_type").alias("description"),
        F.array(F.lit("s1")).alias("paper_ids"), F.array(F.lit("c1")).alias("chunk_ids"),
    )
    statements = read(spark, sf_dir, "orders").select(
        F.concat(F.lit("o"), "o_orderkey").alias("statement_id"), e("if(o_orderstatus = 'O', 'CLAIM', 'FAILURE_MODE')").alias("category"), e("repeat(o_orderpriority, 20)").alias("normalized_statement"), c("o_orderpriority").alias("surface_text"),
        F.concat(F.lit("s"), "o_custkey").alias("paper_id"), F.lit("c1").alias("chunk_id"), F.lit(0.9).alias("confidence_score"), e("array(concat('p', o_custkey), concat('p', o_orderkey))").alias("related_entity_ids"),
    )
    rels = read(spark, sf_dir, "lineitem").select(
        F.struct("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice").alias("ord"), F.concat_ws("-", F.lit("r"), "l_orderkey", "l_linenumber").alias("relationship_id"), F.concat(F.lit("s"), "l_suppkey").alias("source_id"), F.concat(F.lit("p"), c("l_partkey") * 2).alias("target_id"),
        e("if(l_returnflag = 'R', 'uses', if(l_returnflag = 'A', 'IMPROVES', 'EATS'))").alias("relation_type"), F.concat(F.lit("s"), "l_suppkey").alias("paper_id"), F.lit("c1").alias("chunk_id"), e("element_at(array('SUPPORTED', 'UNSUPPORTED', 'odd'), int(l_suppkey % 3) + 1)").alias("evidence_support"),
        F.lit(0.5).alias("confidence_score"), c("l_linestatus").alias("evidence_text"),
    )
    return p, entities, statements, rels


BASE = """st AS (SELECT concat('o', o_orderkey) AS id, concat('s', o_custkey) AS paper, concat('p', o_custkey) AS a, concat('p', o_orderkey) AS b, o_orderstatus FROM orders), pa AS (SELECT concat('s', s_suppkey) AS id FROM supplier), en AS (SELECT concat('p', p_partkey) AS id, p_size FROM part),
rel AS (SELECT DISTINCT concat('s', l_suppkey) AS src, concat('p', l_partkey * 2) AS dst, CASE l_returnflag WHEN 'R' THEN 'USES' WHEN 'A' THEN 'IMPROVES' ELSE 'ADDRESSES' END AS predicate, ['SUPPORTED', 'UNSUPPORTED', 'NOT_ASSESSED'][l_suppkey % 3 + 1] AS support FROM lineitem),
ed AS (SELECT 'CONTAINS' AS predicate, 'SUPPORTED' AS support, paper AS src, id AS dst FROM st WHERE paper IN (FROM pa SELECT id) UNION ALL SELECT 'REPORTS', 'SUPPORTED', id, x FROM (SELECT DISTINCT id, unnest([a, b]) AS x FROM st) WHERE x IN (SELECT id FROM en)
  UNION ALL SELECT predicate, support, src, dst FROM rel WHERE dst IN (SELECT id FROM en))"""


@query("G1_U5_edges", f"WITH {BASE} SELECT predicate, support, count(*) AS n, min(src) AS least, max(dst) AS most FROM ed GROUP BY predicate, support")
def g1(spark, sf_dir):
    edges = graphs.build(*base(spark, sf_dir))["edges"]
    return edges.groupBy("predicate", "support").agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("least"), F.max("dst").alias("most"))


@query("G1_nodes", f"""WITH {BASE} SELECT kind, count(*) AS n FROM (SELECT 'PAPER' AS kind FROM pa UNION ALL SELECT CASE p_size % 3 WHEN 2 THEN 'DATASET' ELSE 'METHOD' END FROM en
UNION ALL SELECT CASE o_orderstatus WHEN 'O' THEN 'CLAIM' ELSE 'STATEMENT' END FROM st) GROUP BY kind""")
def g1_nodes(spark, sf_dir):
    return graphs.build(*base(spark, sf_dir))["nodes"].groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("G1_report", f"""WITH {BASE}, k AS (SELECT count(*) AS n, count(*) FILTER (support = 'SUPPORTED') AS ok FROM ed), w AS (SELECT count(*) AS n FROM rel WHERE dst IN (SELECT id FROM en)), d AS (SELECT count(*) AS n FROM rel)
SELECT (SELECT count(*) FROM pa) + (SELECT count(*) FROM en) + (SELECT count(*) FROM st) AS nodes, k.n AS edges, k.ok AS trusted, k.n - k.ok AS untrusted, (SELECT count(*) FROM lineitem) - d.n AS duplicates, d.n - w.n AS dangling, round(k.n / (k.n + d.n - w.n), 4) AS integrity FROM k, w, d""")
def g1_report(spark, sf_dir):
    return graphs.build(*base(spark, sf_dir))["report"]


@query("J16_referential", f"WITH {EDGES} SELECT src, dst FROM e WHERE src IN (SELECT concat('n', n_nationkey) FROM nation)")
def j16(spark, sf_dir):
    edges = graph(spark, sf_dir)
    nodes = read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id")).unionByName(read(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id")))
    return graphs.referential(edges, nodes).select("src", "dst")


@query("J14_G10_bridges", f"WITH {EDGES} SELECT x.src AS a, x.dst AS b, y.dst AS c FROM e x JOIN e y ON x.dst = y.src AND x.src <> y.dst")
def j14(spark, sf_dir):
    return graphs.bridges(graph(spark, sf_dir)).select("a", "b", "c")


@query("G3_neighbourhood", f"""WITH RECURSIVE {EDGES}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
h AS (SELECT 'c1' AS id, 0 AS hops UNION SELECT dst, hops + 1 FROM h JOIN u ON id = src WHERE hops < 2) SELECT id, min(hops) AS hops FROM h GROUP BY id""")
def g3(spark, sf_dir):
    return graphs.neighbourhood(graph(spark, sf_dir), spark.createDataFrame([("c1",)], "id string"), 2, cut)


@query("G4_paths", f"WITH {EDGES} SELECT concat(x.src, '>', x.dst, '>', y.dst) AS path FROM e x JOIN e y ON x.dst = y.src WHERE x.src = 'c1'")
def g4(spark, sf_dir):
    edges = graph(spark, sf_dir)
    found = None
    for r in range(5):  # the regions are a fixed table of five
        some = graphs.paths(edges, F.lit("c1"), F.lit(f"r{r}"), 3, 10)
        found = some if found is None else found.unionByName(some)
    return found.select(F.array_join("path", ">").alias("path"))


SCORE = "round(greatest(0.0, least(1.0, (0.25 * {sim} + 0.25 * least(1.0, p_size / 4) + 0.20 * least(1.0, p_size / 3) + 0.20 * CASE WHEN p_size % 2 = 0 THEN 0.9 ELSE 0.3 END + 0.10 * CASE WHEN p_size % 3 = 0 THEN 0.85 ELSE 0.40 END) / 1.0 - least(1.0, (p_partkey % 3) * 0.35) * 0.30 - CASE WHEN p_partkey % 5 = 0 THEN 0.8 ELSE 0.0 END * 0.40)), 4)::DOUBLE"


@query("G7_G12_candidate_scores", f"SELECT p_partkey, {SCORE.format(sim='0.75')} AS full_score, {SCORE.format(sim='0.5')} AS no_retrieval FROM part")
def g7(spark, sf_dir):
    args = (F.lit(0.75), c("p_size"), c("p_size"), c("p_size") % 2 == 0, c("p_size") % 3 == 0, c("p_partkey") % 3, c("p_partkey") % 5 == 0)
    return read(spark, sf_dir, "part").select("p_partkey", graphs.score(*args).alias("full_score"), graphs.score(*args, off=("similarity",)).alias("no_retrieval"))


@query("G12_ablation", "WITH s AS (SELECT configuration, p_partkey, score FROM (" + " UNION ALL ".join(f"SELECT '{name}' AS configuration, p_partkey, round(greatest(0.0, least(1.0, 0.25 * 0.75 + 0.25 * {'0.5' if name.endswith('evidence') else 'least(1.0, p_size / 4)'} + 0.20 * least(1.0, p_size / 3) + 0.20 * {'0.5' if name.endswith('distance') else 'CASE WHEN p_size % 2 = 0 THEN 0.9 ELSE 0.3 END'} + 0.10 * CASE WHEN p_size % 3 = 0 THEN 0.85 ELSE 0.40 END - {'0' if name.endswith('contradiction') else 'least(1.0, (p_partkey % 3) * 0.35) * 0.30'} - {'0' if name.endswith('penalty') else 'CASE WHEN p_partkey % 5 = 0 THEN 0.8 ELSE 0.0 END * 0.40'})), 4) AS score FROM part" for name in ("full_model", "ablation_no_distance", "ablation_no_redundancy_penalty", "ablation_no_evidence", "ablation_no_contradiction")) + ")) SELECT configuration, 5::INT AS candidates, arg_min(p_partkey, (-score, p_partkey)) AS top_candidate, max(score) AS top_score FROM s GROUP BY configuration")
def g12(spark, sf_dir):
    args = (F.lit(0.75), c("p_size"), c("p_size"), c("p_size") % 2 == 0, c("p_size") % 3 == 0, c("p_partkey") % 3, c("p_partkey") % 5 == 0)
    return graphs.ablation(read(spark, sf_dir, "part"), *args, name="p_partkey").drop("scores")
