"""Queries over pairs, merges, fallbacks, headers and acquisition."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import sections
from ..operators import extraction, matching
from ..session import ship
from ..sources import readers
from .catalog import query
from .scalars import read

c, e = F.col, F.expr


@query("F24_J7_J8_match_pairs", """WITH h AS (SELECT p_name, min(p_partkey) AS a FROM part GROUP BY p_name),
p AS (SELECT a, y.p_partkey AS b, x.p_brand = y.p_brand AS who, abs(x.p_size - y.p_size) <= 1 AS same FROM part y JOIN h USING (p_name) JOIN part x ON x.p_partkey = a WHERE a < y.p_partkey)
SELECT a, b, CASE WHEN who AND same THEN 'EXACT' WHEN who OR same THEN 'HIGH_CONFIDENCE' ELSE 'POSSIBLE' END AS level FROM p""")
def j7(spark, sf_dir):
    ship(spark)
    return matching.match_pairs(parts(spark, sf_dir))


@query("F24_J7_J8_all_pairs", """SELECT x.p_partkey AS a, y.p_partkey AS b, CASE WHEN x.p_brand = y.p_brand AND abs(x.p_size - y.p_size) <= 1 THEN 'EXACT' WHEN x.p_brand = y.p_brand OR abs(x.p_size - y.p_size) <= 1 THEN 'HIGH_CONFIDENCE' ELSE 'POSSIBLE' END AS level
FROM part x JOIN part y ON x.p_name = y.p_name AND x.p_partkey < y.p_partkey""")
def j7_whole(spark, sf_dir):
    ship(spark)
    return matching.match_all_pairs(parts(spark, sf_dir))


def parts(spark, sf_dir):
    none = F.lit(None).cast("string")
    return read(spark, sf_dir, "part").select(c("p_partkey").alias("id"), c("p_name").alias("title"), none.alias("doi"), none.alias("arxiv"), F.array("p_brand").alias("authors"), c("p_size").alias("year"))


@query("A8_merged_records", """WITH r AS (SELECT p_name, p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN upper(p_name) || 'ZZZZZZZZZ' ELSE p_name || repeat('x', p_size % 7) END AS title, p_type AS abstract, CASE WHEN p_size % 3 = 0 THEN '10.1/' || p_partkey END AS doi,
  ['OTHER', 'JOURNAL_ARTICLE', 'SURVEY'][CASE WHEN p_size % 50 = 0 THEN 3 ELSE p_size % 2 + 1 END] AS type, p_brand AS venue, p_size % 2 = 0 AS repository, p_size FROM part)
SELECT p_name AS component, arg_min(title, {'a': upper(title) = title, 'b': -length(title), 'c': id}) AS title, arg_min(abstract, {'b': -length(abstract), 'c': id}) AS abstract, arg_min(doi, id) FILTER (doi IS NOT NULL) AS doi,
  arg_min(type, {'a': CASE type WHEN 'SURVEY' THEN 0 WHEN 'OTHER' THEN 2 ELSE 1 END, 'b': id}) AS type, arg_min(venue, {'a': repository, 'b': id}) AS venue, max(p_size) AS citations, count(*) AS records, array_to_string(list_sort(list_distinct(list(venue))), ',') AS keywords FROM r GROUP BY p_name""")
def a8(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(
        c("p_name").alias("component"), c("p_partkey").alias("id"), e("if(p_size % 5 = 0, concat(upper(p_name), 'ZZZZZZZZZ'), concat(p_name, repeat('x', p_size % 7)))").alias("title"), c("p_type").alias("abstract"),
        e("if(p_size % 3 = 0, concat('10.1/', p_partkey), null)").alias("doi"), F.lit(None).cast("string").alias("arxiv"), F.lit(None).cast("int").alias("year"),
        e("element_at(array('OTHER', 'JOURNAL_ARTICLE', 'SURVEY'), if(p_size % 50 = 0, 3, p_size % 2 + 1))").alias("type"), c("p_brand").alias("venue"), e("if(p_size % 2 = 0, 'repository', 'journal')").alias("venue_type"),
        c("p_size").alias("citations"), F.lit(False).alias("is_oa"), F.array("p_brand").alias("keywords"),
    )
    out = matching.merge(rows)
    return out.select("component", "title", "abstract", "doi", "type", "venue", "citations", "records", F.array_join("keywords", ",").alias("keywords"))


@query("J11_E5_relations", """WITH m AS (SELECT DISTINCT l_orderkey AS s, l_returnflag AS cat, l_partkey AS e FROM lineitem)
SELECT CASE b.cat WHEN 'A' THEN 'ADDRESSES' ELSE 'EVALUATED_ON' END AS relation, count(*) AS n, sum(a.e * 31 + b.e)::BIGINT AS mixed FROM m a JOIN m b ON a.s = b.s AND a.cat = 'R' AND b.cat IN ('A', 'N') GROUP BY ALL""")
def j11(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("statement"), c("l_returnflag").alias("category"), c("l_partkey").alias("entity"), c("l_linestatus").alias("text"))
    out = matching.related(rows, "R", {"A": "ADDRESSES", "N": "EVALUATED_ON"}, trigger="[FO]")
    return out.groupBy("relation").agg(F.count(F.lit(1)).alias("n"), F.sum(c("source") * 31 + c("target")).cast("long").alias("mixed"))


@query("J15_hit_titles", "SELECT DISTINCT l_partkey AS id, coalesce(p_name, 'Paper ' || l_partkey) AS title FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON l_partkey = p_partkey")
def j15(spark, sf_dir):
    papers = read(spark, sf_dir, "part").where("p_size > 10").select(c("p_partkey").alias("id"), c("p_name").alias("title"))
    return matching.titled(read(spark, sf_dir, "lineitem").select(c("l_partkey").alias("id")), papers)


@query("J4_J20_fallback", "SELECT o_orderkey, coalesce(c_name, o_orderpriority) AS name, c_custkey IS NOT NULL AS found FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def j20(spark, sf_dir):
    known = read(spark, sf_dir, "customer").where("c_acctbal > 0").select(c("c_custkey").alias("k"), c("c_name").alias("name"))
    return matching.with_fallback(read(spark, sf_dir, "orders").select("o_orderkey", c("o_custkey").alias("k"), c("o_orderpriority").alias("name")), known, "k", ["name"]).select("o_orderkey", "name", "found")


@query("J18_relaxed_matches")
def j18(spark, sf_dir):
    ship(spark)
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", c("text").alias("name"))

    def pairs(key, rows):
        rows = rows.sort_values(["turn", "name"])
        said, heard = (rows["name"][rows["turn"] % 2 == side].tolist() for side in (0, 1))
        found = extraction.relaxed_matches(said, heard, 0.05)
        return pd.DataFrame({"conv_id": [key[0]], "matched": [len(found)], "predicted": [len(said)], "actual": [len(heard)]})

    return rows.groupBy("conv_id").applyInPandas(pairs, "conv_id long, matched long, predicted long, actual long")


HEADS = ["1 Introduction", "1.2 Data sets", "2.1.3 Split of the data", "Chapter 4 Outlook", "Table 1: Results", "https://example.org", "Department of Physics", "Abstract", "Some long sentence that goes on.", "12", "3. Term: Definition of it", "Journal of Things", "A Bold Line", ""]
LEVELS = "[1, 2, 3, 1, NULL, NULL, NULL, 1, NULL, NULL, NULL, NULL, 2, NULL]"


@query("E7_header_level", f"SELECT o_orderkey, {LEVELS}[o_orderkey % 14 + 1] AS level FROM orders")
def e7(spark, sf_dir):
    block = F.element_at(F.array(*map(F.lit, HEADS)), (c("o_orderkey") % 14 + 1).cast("int"))
    return read(spark, sf_dir, "orders").select("o_orderkey", sections.header_level(block, F.lit(False), block == "A Bold Line").alias("level"))


@query("F19_protected", "SELECT doc_id, sha256(text) AS back FROM documents")
def f19(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(sections.unprotect(sections.protect(c("text"))), 256).alias("back"))


@query("SRC13_SRC14_collected", """WITH a AS (SELECT CASE WHEN l_linenumber = 7 THEN 'CACHED' WHEN l_quantity < 30 THEN 'FETCHED' WHEN l_quantity = 30 THEN 'NOT_FOUND' WHEN l_quantity IN (31, 32) THEN 'ACCESS_DENIED' WHEN l_quantity = 33 THEN 'RATE_LIMITED' ELSE 'FAILED' END AS status FROM lineitem)
SELECT status, count(*) AS n, round(count(*) / (SELECT count(*) FROM a), 4) AS share FROM a GROUP BY status""")
def src14(spark, sf_dir):
    code = e("case when l_quantity < 30 then 200 when l_quantity = 30 then 404 when l_quantity = 31 then 401 when l_quantity = 32 then 403 when l_quantity = 33 then 429 else 500 end")
    return readers.collected(read(spark, sf_dir, "lineitem").select(readers.fetch_status(code, c("l_linenumber") == 7).alias("status")))


@query("SRC1_retry_delay", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 AND o_orderkey % 6 < 4 THEN coalesce(CASE WHEN o_orderkey % 7 = 0 THEN 9.0 END, round(pow(1.5, o_orderkey % 6), 6))::DOUBLE END AS delay FROM orders")
def src1(spark, sf_dir):
    delay = readers.retry_delay(c("o_orderkey") % 6, e("if(o_orderkey % 7 = 0, 9, null)"), e("if(o_orderkey % 3 > 0, 503, 200)"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.round(delay, 6).alias("delay"))


@query("SRC15_url_map", "SELECT p_partkey::VARCHAR AS key, CASE WHEN p_size % 2 = 0 THEN 'b' || p_size || CASE WHEN p_brand <> 'b' || p_size THEN ',' || p_brand ELSE '' END ELSE p_brand END AS urls FROM part UNION ALL SELECT '10.1000/' || p_partkey, CASE WHEN p_size % 2 = 0 THEN 'b' || p_size || ',' || p_brand ELSE p_brand END FROM part WHERE p_size % 3 = 0")
def src15(spark, sf_dir):
    works = read(spark, sf_dir, "part").select(c("p_partkey").cast("string").alias("id"), e("if(p_size % 3 = 0, concat('https://doi.org/10.1000/', p_partkey), null)").alias("doi"), e("if(p_size % 2 = 0, concat('b', p_size), null)").alias("best"), F.array("p_brand", "p_brand").alias("locations"))
    return readers.url_map(works).select("key", F.array_join("urls", ",").alias("urls"))
