"""Queries over audits and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audits, knowledge, selection
from .catalog import query
from .scalars import read

c = F.col

CORE, NEAR, OWN = ["\\bthere\\b", "\\bouron\\b", "\\bdans\\b"], ["\\bder\\b", "\\bque\\b"], ["the"]


def whole(p):
    """RE2 knows word boundaries of ASCII only."""
    inner = p.replace("\\b", "")
    return rf"regexp_matches(b, '(^|[^\p{{L}}\p{{N}}_]){inner}([^\p{{L}}\p{{N}}_]|$)')"


HITS = " + ".join(whole(p) + "::INT" for p in CORE)
RELEVANCE = f"""SELECT doc_id, round(greatest(CASE WHEN lang = 'es' THEN 0.85 WHEN lang = 'the' THEN 0.7 ELSE 0 END,
  CASE WHEN {HITS} > 1 THEN 0.85 WHEN {HITS} = 1 THEN 0.65 WHEN {' OR '.join(map(whole, NEAR))} THEN 0.35 ELSE 0 END,
  CASE WHEN {whole('the')} THEN 0.65 ELSE 0 END), 3)::DOUBLE AS score FROM (SELECT doc_id, lang, lower(coalesce(text, '')) AS b FROM documents)"""


def scored(spark, sf_dir):
    score = selection.relevance(F.array("lang"), c("text"), CORE, NEAR, ["es"], OWN)
    return read(spark, sf_dir, "documents").select("doc_id", score.alias("score"))


@query("P1_relevance", RELEVANCE)
def p1(spark, sf_dir):
    return scored(spark, sf_dir)


@query("P2_relevance_filter", f"SELECT count(*) AS total, count(*) FILTER (score >= 0.6) AS kept, count(*) FILTER (score < 0.6) AS rejected, round(count(*) FILTER (score >= 0.6) / count(*), 4) AS pass_rate FROM ({RELEVANCE})")
def p2(spark, sf_dir):
    return selection.relevant(scored(spark, sf_dir), c("score"), selection.STRICT)[1]


def counted(table, by):
    return f"(SELECT string_agg(k || ':' || n, ',' ORDER BY k) FROM (SELECT coalesce({by}::VARCHAR, 'NONE') AS k, count(*) AS n FROM {table} GROUP BY ALL))"


@query("A4_manifest", f"SELECT count(*) AS total, round(avg((n_chars >= 100)::INT), 4) AS integrity, {counted('documents', 'lang')} AS counts FROM documents")
def a4(spark, sf_dir):
    return audits.manifest(read(spark, sf_dir, "documents"), c("lang"), c("n_chars") >= 100).withColumn("counts", audits.shown(c("counts")))


LINES = "list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: length(x) > 0)"
AUDIT = rf"""a AS (SELECT doc_id, lang, length(t) AS char_count, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS word_count, round((doc_id % 7) / 6, 4) AS page_rate,
  (length(t) - length(regexp_replace(t, '[\x{{FFFD}}\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'))) / greatest(length(t), 1) > 0.02 AS corrupt,
  len(list_filter({LINES}, lambda x: length(x) < 8)) / greatest(len({LINES}), 1) > 0.5 AS anomaly
  FROM (SELECT *, coalesce(text, '') AS t FROM documents)),
s AS (SELECT *, CASE WHEN char_count < 100 THEN 'FAILED' WHEN corrupt OR page_rate < 0.8 THEN 'PARTIAL' ELSE 'SUCCESS' END AS status FROM a)"""


def audited(spark, sf_dir):
    return audits.document_audit(read(spark, sf_dir, "documents"), c("text"), F.lit(6), c("doc_id") % 7)


@query("A9_document_audit", f"WITH {AUDIT} SELECT doc_id, char_count, word_count, page_rate, corrupt, anomaly, status FROM s")
def a9(spark, sf_dir):
    return audited(spark, sf_dir).select("doc_id", "char_count", "word_count", "page_rate", "corrupt", "anomaly", "status")


@query("A11_corpus_audit", f"WITH {AUDIT} SELECT lang, count(*) AS documents, count(*) FILTER (status = 'SUCCESS') AS success, count(*) FILTER (status = 'PARTIAL') AS partial, count(*) FILTER (status = 'FAILED') AS failed, sum(char_count)::BIGINT AS chars, sum(word_count)::BIGINT AS words, round(count(*) FILTER (status = 'SUCCESS') / count(*), 4) AS success_rate FROM s GROUP BY lang")
def a11(spark, sf_dir):
    return audits.corpus_audit(audited(spark, sf_dir), "lang")


KEPT = "coalesce(o_orderstatus, '') <> 'F'"


@query("A14_run_metrics", f"""SELECT count(*) AS candidates, count(*) FILTER (o_orderstatus = 'O') AS validated, count(*) FILTER (o_orderstatus = 'P') AS needs_review, count(*) FILTER (o_orderstatus = 'F') AS rejected,
  round(count(*) FILTER (o_orderstatus = 'O') / count(*), 4) AS pass_rate, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 4) AS rejection_rate, round(count(*) FILTER (o_orderstatus = 'P') / count(*), 4) AS review_rate,
  round(count(*) FILTER ({KEPT} AND o_totalprice > 50000) / count(*) FILTER ({KEPT}), 4) AS grounding, round(count(*) FILTER ({KEPT} AND o_orderkey % 9 > 0) / count(*) FILTER ({KEPT}), 4) AS provenance,
  round(count(*) FILTER (o_orderkey % 3 = 1 AND o_orderstatus <> 'O') / count(*) FILTER (o_orderkey % 3 = 1), 4) AS unsupported_rate,
  greatest(0, 5000 - count(DISTINCT CASE WHEN {KEPT} THEN o_custkey END))::BIGINT AS empty_chunks, round(greatest(0, 5000 - count(DISTINCT CASE WHEN {KEPT} THEN o_custkey END)) / 5000, 4) AS empty_rate FROM orders""")
def a14(spark, sf_dir):
    status = F.expr("case o_orderstatus when 'O' then 'VALIDATED' when 'P' then 'NEEDS_REVIEW' when 'F' then 'REJECTED' end")
    kind = F.expr("element_at(array('ENTITY', 'STATEMENT', 'RELATION'), int(o_orderkey % 3) + 1)")
    rows = read(spark, sf_dir, "orders").select(status.alias("status"), kind.alias("kind"), (c("o_totalprice") > 50000).alias("grounded"), c("o_custkey").alias("chunk_id"), F.expr("if(o_orderkey % 9 > 0, o_orderkey, null)").alias("paper_id"))
    return audits.run_metrics(rows, 5000)


@query("A16_evidence_correctness", """WITH t AS (SELECT p_name, p_type AS span FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1),
m AS (SELECT contains(t.span, split_part(p.p_type, ' ', 1)) OR contains(split_part(p.p_type, ' ', 1), t.span) AS good FROM part p JOIN t USING (p_name) WHERE t.span <> '')
SELECT count(*) AS n, count(*) FILTER (good) AS correct, round(avg(good::INT), 4) AS rate FROM m""")
def a16(spark, sf_dir):
    parts = read(spark, sf_dir, "part")
    return audits.evidence_correctness(parts.select("p_name", F.substring_index("p_type", " ", 1).alias("span")), parts.select("p_name", c("p_type").alias("span"), c("p_partkey").alias("ord")), ["p_name"])


@query("A19_reconciliation", "SELECT CASE WHEN quality IS NULL THEN 'MISSING' WHEN quality = (n_chars > 300)::INT THEN 'AGREED' ELSE 'DISPUTED' END AS outcome, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def a19(spark, sf_dir):
    pairs = read(spark, sf_dir, "documents").select("doc_id", (c("n_chars") > 300).cast("int").alias("b")).join(read(spark, sf_dir, "labels").select("doc_id", c("quality").alias("a")), "doc_id", "left")
    return audits.reconcile(pairs)


@query("A21_graph_report", f"""WITH e AS (SELECT l_suppkey AS src, l_partkey AS dst, l_returnflag AS p FROM lineitem), n AS (SELECT s_suppkey AS id, 'SUPPLIER' AS kind FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT 1000000 + p_partkey, p_type FROM part)
SELECT (SELECT count(*) FROM n) AS nodes, {counted('n', 'kind')} AS by_kind, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM e) - (SELECT count(*) FROM (SELECT DISTINCT src, dst, p FROM e)) AS repeated,
  {counted('e', 'p')} AS by_predicate, (SELECT count(*) FROM e) - w.n AS dangling, round(w.n / (SELECT count(*) FROM e), 4) AS integrity
FROM (SELECT count(*) AS n FROM e SEMI JOIN n ON src = id) w""")
def a21(spark, sf_dir):
    nodes = read(spark, sf_dir, "supplier").where("s_acctbal > 0").select(c("s_suppkey").alias("id"), F.lit("SUPPLIER").alias("kind"))
    nodes = nodes.unionByName(read(spark, sf_dir, "part").select((c("p_partkey") + 1000000).alias("id"), c("p_type").alias("kind")))
    edges = read(spark, sf_dir, "lineitem").select(c("l_suppkey").alias("src"), (c("l_partkey") + 1000000).alias("dst"), c("l_returnflag").alias("predicate"))
    return audits.graph_report(nodes, edges)


@query("A25_parity", "SELECT (SELECT count(*) FROM documents) AS left_rows, (SELECT count(*) FROM labels) AS right_rows, (SELECT count(*) FROM documents ANTI JOIN labels USING (doc_id)) AS left_only, (SELECT count(*) FROM labels ANTI JOIN documents USING (doc_id)) AS right_only, false AS same_columns")
def a25(spark, sf_dir):
    return audits.parity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), ["doc_id"])


ASKED = "there ouron dans haus"
Q = "['dans', 'haus', 'ouron', 'there']"


def part_of(x):
    words = rf"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_\s-]', ' ', 'g'), '\s+'), lambda w: length(w) > 2))"
    return f"round(len(list_intersect({Q}, {words})) / 4, 4)"


FIELD = f"""SELECT conv_id, turn, round((0.55 * {part_of('text')} + CASE WHEN length(trim(t)) > 10 THEN 0.30 * {part_of('t')} ELSE 0 END) / (0.55 + CASE WHEN length(trim(t)) > 10 THEN 0.30 ELSE 0 END), 4) AS score
FROM (SELECT *, CASE WHEN role = 'user' THEN lower(concat(role, ' ', text)) ELSE '' END AS t FROM conversations)"""


@query("W5_candidates", f"SELECT conv_id, turn, score, rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, conv_id, turn) AS rank FROM ({FIELD}) WHERE score >= 0.05) WHERE rank <= 25")
def w5(spark, sf_dir):
    def words(x):
        clean = F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}_\s-]", " ")
        return F.array_distinct(F.filter(F.split(clean, r"\s+"), lambda w: F.length(w) > 2))

    rows = read(spark, sf_dir, "conversations").withColumn("more", F.when(c("role") == "user", F.lower(F.concat_ws(" ", "role", "text"))).otherwise(""))
    asked = words(F.lit(ASKED))
    parts = {"title": (F.lit(True), T.coverage(asked, words(c("text")))), "abstract": (F.length(F.trim("more")) > 10, T.coverage(asked, words(c("more"))))}
    top = rows.select("conv_id", "turn", selection.field_score(parts).alias("score")).where("score >= 0.05").orderBy(F.desc("score"), "conv_id", "turn").limit(25)
    return top.withColumn("rank", F.expr("row_number() over (order by score desc, conv_id, turn)"))


@query("W7_W8_listings", "SELECT o_custkey, o_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS place FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def w7(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "lineitem"), c("o_orderkey") == c("l_orderkey"))
    return selection.quota(rows, ["o_custkey"], [F.desc("o_orderdate"), "o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], 2**31 - 1, "place").select("o_custkey", "o_orderkey", "l_linenumber", "l_quantity", "place")


@query("W9_quarantine_recent", "SELECT event_id, user_id FROM events WHERE event_type = 'error' OR value < 0 ORDER BY ts DESC, event_id")
def w9(spark, sf_dir):
    return knowledge.quarantine_log(read(spark, sf_dir, "events").where("event_type = 'error' or value < 0"), at="ts", id="event_id").select("event_id", "user_id")


BUCKET = "element_at(array('ABSTRACT', 'INTRO_BACKGROUND', 'METHODS', 'RESULTS', 'CONCLUSION_LIMITATIONS', 'OTHER'), int(doc_id % 6) + 1)"
SAMPLE = """WITH c AS (SELECT doc_id, source, ['ABSTRACT', 'INTRO_BACKGROUND', 'METHODS', 'RESULTS', 'CONCLUSION_LIMITATIONS', 'OTHER'][doc_id % 6 + 1] AS bucket, n_chars < 150 AS edge, sha256(doc_id || '|42') AS h FROM documents),
e AS (SELECT doc_id, h, 'EDGE' AS stratum FROM c WHERE edge ORDER BY h LIMIT 6),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket, source ORDER BY h) AS t FROM c ANTI JOIN e USING (doc_id)),
b AS (SELECT doc_id, h, bucket AS stratum FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY t, h) AS n FROM r) WHERE n <= CASE bucket WHEN 'ABSTRACT' THEN 12 WHEN 'INTRO_BACKGROUND' THEN 15 WHEN 'METHODS' THEN 18 WHEN 'RESULTS' THEN 15 WHEN 'CONCLUSION_LIMITATIONS' THEN 9 ELSE 0 END),
d AS (SELECT * FROM e UNION ALL SELECT * FROM b)
SELECT doc_id AS id, stratum FROM (SELECT *, 0 AS late FROM d UNION ALL SELECT doc_id, h, 'FILL', 1 FROM c ANTI JOIN d USING (doc_id)) ORDER BY late, h LIMIT 75"""


@query("W10_stratified_sample", SAMPLE)
def w10(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(c("doc_id").alias("id"), c("source").alias("paper"), F.expr(BUCKET).alias("bucket"), (c("n_chars") < 150).alias("edge"))
    return selection.stratified(rows, 75, 42)


@query("W19_first_spans", "SELECT l_orderkey, l_linenumber, l_returnflag AS category, l_partkey::VARCHAR AS text FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END, l_returnflag, l_partkey::VARCHAR) = 1")
def w19(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", c("l_returnflag").alias("category"), c("l_partkey").cast("string").alias("text"))
    return selection.first_spans(rows, ["l_orderkey", "l_linenumber"], ["R", "A"])


@query("W21_pilot_sample", """WITH s AS (SELECT l_suppkey AS qid, l_partkey AS id, max(l_quantity) AS score FROM lineitem GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 7),
o AS (SELECT id, qid::VARCHAR AS origin, 0 AS late, rank AS pos FROM t QUALIFY row_number() OVER (PARTITION BY id ORDER BY qid, rank) = 1),
m AS (SELECT p_partkey AS id, p_type AS origin, 1 AS late, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS pos FROM part ANTI JOIN o ON p_partkey = o.id QUALIFY pos <= 3)
SELECT id, origin FROM (SELECT * FROM o UNION ALL SELECT * FROM m) ORDER BY late, pos, origin, id LIMIT 600""")
def w21(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").groupBy(c("l_suppkey").alias("qid"), c("l_partkey").alias("id")).agg(F.max("l_quantity").alias("score"))
    return selection.pilot(rows, read(spark, sf_dir, "part").select(c("p_partkey").alias("id"), c("p_type").alias("stratum")), 7, 3, 600)
