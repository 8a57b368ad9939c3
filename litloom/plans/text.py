"""Queries over document structure and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents, extraction
from ..sources import readers
from .catalog import query
from .scalars import read, whole_texts

c = F.col
LEXICON = {"LICENSE": ["License", "Apache License", "MIT License"], "LINK": ["the", "of the"]}


@query("W11_chunks_a")
def w11(spark, sf_dir):
    return documents.chunks(whole_texts(spark, sf_dir), "A").select("doc_id", "ordinal", F.length("chunk").alias("size"), F.sha2("chunk", 256).alias("hash"))


@query("W12_chunks_b")
def w12(spark, sf_dir):
    return documents.chunks(whole_texts(spark, sf_dir), "B").select("doc_id", "ordinal", F.length("chunk").alias("size"), F.sha2("chunk", 256).alias("hash"))


@query("E6_sentences")
def e6(spark, sf_dir):
    return documents.sentence_rows(whole_texts(spark, sf_dir))


@query("E1_W18_entities")
def e1(spark, sf_dir):
    return extraction.entities(whole_texts(spark, sf_dir), LEXICON)


def kinds_sql(version):
    cases = [f"WHEN regexp_matches(line, '{extraction.cue(kind, version)}') THEN '{kind}'" for kind in extraction.KINDS[version]]
    first = [f"WHEN regexp_matches(line, '{extraction.DECLARED}') THEN 'CLAIM'"] if version != "0.4.0" else []
    return f"CASE WHEN length(line) >= {extraction.SHORTEST[version]} THEN CASE {' '.join(first + cases)} END END"


@query("E4_statement_kinds", rf"SELECT doc_id, line, {kinds_sql('0.4.0')} AS kind, {kinds_sql('0.4.1')} AS later FROM (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') AS line FROM documents)")
def e4(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.select("doc_id", F.regexp_replace("line", r"^\s+|\s+$", "").alias("line"))
    return lines.select("doc_id", "line", extraction.statement_kind(c("line")).alias("kind"), extraction.statement_kind(c("line"), "0.4.1").alias("later"))


@query("E3_E4_statements")
def e3(spark, sf_dir):
    return extraction.statements(whole_texts(spark, sf_dir), "0.4.1")


@query("E2_frame_entities")
def e2(spark, sf_dir):
    return extraction.scientific_entities(whole_texts(spark, sf_dir), {"DATASET": LEXICON["LICENSE"], "TERM": LEXICON["LINK"]})


@query("J10_interval_join", "SELECT a.conv_id, a.turn AS first, b.turn AS inner_turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn >= a.turn AND b.turn + 1 <= a.turn + 2")
def j10(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    outer = turns.select("conv_id", c("turn").alias("start"), (c("turn") + 2).alias("end"), c("turn").alias("first"))
    inner = turns.select("conv_id", c("turn").alias("start"), (c("turn") + 1).alias("end"), c("turn").alias("inner_turn"))
    return extraction.contained(outer, inner, "conv_id").select("conv_id", "first", "inner_turn")


@query("P9_grounding", """SELECT d.doc_id, CASE WHEN position('e' IN d.text) > 0 AND substr(d.text, 3, 3) <> b.s THEN CASE WHEN position(b.s IN d.text) > 0 THEN 'REALIGNED' ELSE 'NOT_GROUNDED' END
  WHEN substr(d.text, 3, 3) <> b.s THEN CASE WHEN position(b.s IN d.text) > 0 THEN 'REALIGNED' ELSE 'NOT_GROUNDED' END ELSE 'VALID' END AS verdict FROM documents d, (SELECT 'the' AS s) b""")
def p9(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", extraction.grounding(c("text"), F.lit("the"), F.lit(2), F.lit(5), F.lit(0.9)).alias("verdict"))


SRC11 = f"""WITH h AS (SELECT page_id, html, lower(substr(html, 1, {readers.HEAD})) AS head, contains(substr(html, 1, {readers.MAGIC_HEAD}), '%PDF-') AS magic FROM pages)
SELECT page_id, strlen(coalesce(html, '')) AS size, CASE WHEN html <> '' THEN sha256(html) END AS sha256, CASE WHEN coalesce(html, '') = '' THEN 'EMPTY_FILE'
  WHEN regexp_matches(head, '{"|".join(readers.HTML)}') OR (page_id % 5 = 0 AND NOT magic) THEN CASE WHEN regexp_matches(head, '{"|".join(readers.PAYWALL)}') THEN 'PAYWALL' ELSE 'HTML_NOT_PDF' END
  WHEN NOT magic OR strlen(html) < {readers.LEAST_BYTES} THEN 'INVALID_PDF' ELSE 'SUCCESS_PDF' END AS verdict FROM h"""


@query("SRC11_payload_verdict", SRC11)
def src11(spark, sf_dir):
    found = readers.artifact(c("html").cast("binary"), F.expr("if(page_id % 5 = 0, 'text/html; charset=utf-8', null)"))
    return read(spark, sf_dir, "pages").select("page_id", found.alias("a")).select("page_id", "a.*")


@query("SRC14_download_status", """WITH u AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN url WHEN page_id % 4 = 1 THEN 'https://arxiv.org/pdf/' || page_id || '.pdf' WHEN page_id % 4 = 2 THEN url || '/open' END AS found FROM pages)
SELECT page_id, found, CASE WHEN found IS NULL THEN 'FULLTEXT_UNAVAILABLE' WHEN page_id % 7 = 0 THEN 'FULLTEXT_AVAILABLE' WHEN page_id % 11 = 0 OR page_id % 13 = 0 OR (page_id % 3 = 0 AND NOT contains(found, 'arxiv.org') AND NOT contains(found, 'pdf')) OR page_id % 17 = 0 THEN 'FULLTEXT_FAILED' ELSE 'FULLTEXT_AVAILABLE' END AS status FROM u""")
def src14(spark, sf_dir):
    pick = lambda k, then: F.expr(f"if(page_id % 4 = {k}, {then}, '')")
    rows = read(spark, sf_dir, "pages").select("page_id", readers.download_url(pick(0, "url"), pick(1, "string(page_id)"), pick(2, "concat(url, '/open')")).alias("found"))
    code = F.expr("case when page_id % 11 = 0 then 403 when page_id % 13 = 0 then null else 200 end")
    kind, size = F.expr("if(page_id % 3 = 0, 'Text/HTML', null)"), F.expr(f"if(page_id % 17 = 0, {readers.MOST_BYTES + 1}, 10)")
    return rows.select("page_id", "found", readers.download_status(c("found"), c("page_id") % 7 == 0, code, kind, size).alias("status"))


@query("SRC12_fulltext_url", "SELECT page_id, coalesce(CASE WHEN page_id % 3 = 0 THEN url END, CASE WHEN page_id % 3 = 1 THEN concat('https://arxiv.org/pdf/', page_id) END, url) AS found FROM pages")
def src12(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", readers.fulltext_url(F.expr("if(page_id % 3 = 0, url, null)"), F.expr("if(page_id % 3 = 1, string(page_id), null)"), c("url"), F.lit(None)).alias("found"))


@query("SRC7_column_pick", "SELECT doc_id, lang FROM documents")
def src7(spark, sf_dir):
    return readers.table(spark, f"{sf_dir}/documents.parquet", ["doc_id", "lang"])
