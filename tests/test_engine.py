import datetime as dt
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from litloom.functions import text as T
from litloom.operators import documents, extraction, graphs, knowledge, linkage, metrics
from litloom.plans import all_plans, catalog  # noqa: F401
from litloom.session import ship
from litloom.sources import readers, sinks
from litloom.storage import cut
from litloom.streaming import ingest

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("name", ["W1_bm25_topk", "W2_dense_topk", "J6_components", "P3_P5_quarantine", "G3_neighbourhood", "J19_A18_kappa", "F2_title_key", "A7_source_overlap"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in "documents benchmark embeddings labels customer supplier nation region events".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours = catalog.queries()[name](spark, SF)
    theirs = con.sql(catalog.oracle_sql()[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    own, other = (sorted(map(tuple, rows), key=lambda r: repr([x for x in r if not isinstance(x, float)])) for rows in (ours.select(theirs.columns).collect(), theirs.fetchall()))
    assert len(own) == len(other)
    for a, b in zip(own, other):
        assert all(x == pytest.approx(y, abs=2e-4) if isinstance(x, float) else x == y for x, y in zip(a, b))


def test_scalars(spark):
    lit = F.lit
    assert one(spark, T.clean_text(lit("<p>a &amp; b , c</p>"))) == "a & b, c"
    assert one(spark, T.clean_text(lit("<p> </p>"))) is None
    assert one(spark, T.title_key(lit("Résumé: A-B!"))) == "resume a b"
    assert one(spark, T.doi(lit("https://doi.org/10.1000/AbC."))) == "10.1000/abc"
    assert one(spark, T.doi(lit("nothing"))) is None
    assert one(spark, T.arxiv_id(lit("arXiv:2101.00001v3"))) == "2101.00001"
    assert one(spark, T.partial_date(lit(2020), lit(3), lit(None))) == "2020-03"
    assert tuple(one(spark, T.author_name(lit("Doe, Jane")))) == ("Jane", "Doe")
    assert tuple(one(spark, T.author_name(lit("Plato")))) == (None, "Plato")
    assert tuple(one(spark, T.evidence_span(lit("é🙂 Found it"), lit("found")))) == (3, 8)
    assert one(spark, T.hedged(lit("this may work"))) is True


def test_sentences_and_chunks():
    text = "See Fig. 2 for it. J. Doe came. Short words here.\nNext line."
    assert [text[a:b] for a, b in documents.sentences(text)] == ["See Fig. 2 for it.", "J. Doe came.", "Short words here.", "Next line."]
    assert documents.sentences(None) == documents.sentences("  ") == []
    long = " ".join(f"Sentence number {i} says a little." for i in range(200))
    for make in (documents.paragraph_chunks, documents.sentence_chunks):
        own = make(long)
        assert own and all(len(c) <= documents.CUT for c in own)
    joined = documents.sentence_chunks(long)
    assert all(b.split(". ")[0] in a for a, b in zip(joined, joined[1:]))


def test_extraction(spark):
    rows = spark.createDataFrame([(1, "The MIT License and the license."), (2, None)], "doc_id long, text string")
    found = extraction.entities(rows, {"L": ["license", "mit license"]}).collect()
    assert [(r.name, "The MIT License and the license."[r.start : r.end].lower()) for r in found] == [("mit license", "mit license"), ("license", "license")]
    assert extraction.relaxed_matches(["deep net", "x"], ["a deep net", "y z"]) == [(0, 0)]


def test_linkage_and_graph(spark):
    nodes = spark.createDataFrame([(i,) for i in range(8)], "id long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (5, 6)], "a long, b long")
    assert {r.id: r.component for r in linkage.components(nodes, edges, cut).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5, 6: 5, 7: 7}
    arcs = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "a")], "src string, dst string")
    assert [r.path for r in graphs.paths(arcs, F.lit("a"), F.lit("c"), 3, 10).collect()] == [["a", "c"], ["a", "b", "c"]]
    assert graphs.paths(arcs, F.lit("a"), F.lit("a"), 3, 10).count() == 0


def test_score_arithmetic(spark):
    args = (F.lit(0.45), F.lit(4), F.lit(1), F.lit(True), F.lit(False), F.lit(0), F.lit(False))
    assert one(spark, graphs.score(*args)) - one(spark, graphs.score(*args, off=("distance",))) == pytest.approx(0.08)


def test_quarantine_and_metrics(spark):
    rows = spark.createDataFrame([("abc", 0, 3), ("abc", 2, 2), (None, 0, 1), ("abc", 0, 2)], "t string, s int, e int")
    good, bad = knowledge.split(rows, knowledge.span_error(F.col("t"), F.col("s"), F.col("e")))
    assert good.count() == 1
    assert sorted(r.reason for r in bad.collect()) == ["EMPTY_EVIDENCE", "INVALID_SPAN_BOUNDS", "SPAN_LENGTH_MISMATCH"]
    same = spark.createDataFrame([(1, 1), (1, 1)], "a int, b int")
    assert metrics.kappa(same).first().kappa == 1.0


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps({"results": [{"id": "W1", "doi": "https://doi.org/10.1/A", "title": "T <b>x</b>", "publication_year": 2020, "abstract_inverted_index": {"b": [1], "a": [0, 2]}, "authorships": []}]}))
    row = readers.works_json(spark, str(tmp_path / "w.json")).first()
    assert (row.doi, row.abstract, row.title) == ("10.1/a", "a b a", "T x")
    (tmp_path / "r.json").write_text(json.dumps({"message": {"items": [{"DOI": "10.5/X", "title": ["t"], "issued": {"date-parts": [[2019, 2]]}}, {"title": ["none"]}]}}))
    assert [(r.doi, r.year) for r in readers.registry_json(spark, str(tmp_path / "r.json")).collect()] == [("10.5/x", 2019)]
    (tmp_path / "f.xml").write_text("<feed><entry><id>http://arxiv.org/abs/2101.00001v1</id><title>T</title><summary>s</summary><published>2021-01-01</published><author><name>A</name></author></entry></feed>")
    assert readers.feed_xml(spark, str(tmp_path / "f.xml")).first().source_id == "2101.00001"
    root = sinks.snapshot({"a": spark.range(3)}, str(tmp_path / "kb"))
    assert spark.read.parquet(f"{root}/a").count() == 3


def test_streaming(spark, tmp_path):
    at = dt.datetime(2024, 1, 1, 10)
    rows = spark.createDataFrame([(1, at, "x"), (1, at, "x"), (2, at, "y")], "event_id long, ts timestamp, event_type string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run = ingest.once(stream, ["event_id"]).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert spark.table("seen").count() == 2


def test_table_rows_and_support(spark):
    table = "Method 1 Deep Net uses Images 2 Tree uses Tables 3 Rule uses Text"
    cases = [
        ("deep net", "images", table, "SUPPORTED"), ("deep net", "tables", table, "UNSUPPORTED"), ("Deep", "Method", table, "NOT_ASSESSED"), ("deep net", "sound", table, "UNSUPPORTED"),
        ("a", "b", "a with b", "NOT_ASSESSED"), ("a", "z", "a with b", "UNSUPPORTED"), ("a", "b", "  ", "UNSUPPORTED"), ("a", "b", None, "UNSUPPORTED"), ("x", "y", "1 x 2 y", "NOT_ASSESSED"), ("new", "c", "1 old 2 b 3 c 1 new", "UNSUPPORTED"),
    ]
    ship(spark)
    frame = spark.createDataFrame([(i, *case) for i, case in enumerate(cases)], "id int, a string, b string, e string, want string")
    rows = frame.select("id", "want", extraction.table_map("e").alias("rows"), extraction.support("a", "b", "e").alias("got")).orderBy("id").collect()
    assert [r.got for r in rows] == [r.want for r in rows]
    assert rows[0].rows == {1: "Deep Net uses Images", 2: "Tree uses Tables", 3: "Rule uses Text"}
    assert rows[4].rows == {} and rows[9].rows == {1: "new", 2: "b", 3: "c"}


def test_grounding_of_statements_and_relations(spark):
    text = "It may help. We see Gains here."
    cases = [
        (None, "p", "It may", "p", 0, 6, 0.9, "RESULT", "CHUNK_MISSING"), (text, "q", "It may", "p", 0, 6, 0.9, "CLAIM", "PAPER_MISMATCH"), (text, "p", " a ", "p", 0, 1, 0.9, "CLAIM", "TOO_SHORT"),
        (text, "p", "It may help", "p", 0, 11, 0.9, "RESULT", "NEEDS_REVIEW"), (text, "p", "It may help", "p", 0, 11, 0.9, "CLAIM", "VALID"), (text, "p", "we see gains", "p", -4, 99, 0.9, "RESULT", "VALID"),
        (text, "p", "We see", "p", 0, 6, 0.4, "RESULT", "NEEDS_REVIEW"), (text, "p", "not there", "p", 0, 9, 0.9, "RESULT", "NOT_GROUNDED"),
    ]
    frame = spark.createDataFrame([(i, *case) for i, case in enumerate(cases)], "id int, t string, p string, e string, o string, a int, b int, c double, k string, want string")
    verdict = extraction.statement_grounding(*map(F.col, "tpeoabck"))
    rows = frame.select("want", verdict.alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]
    links = [(1, "a", "b", "c1", "Gains", True, "VALID", True), (2, "a", "b", "c1", "gains", False, "VALID", False), (3, "x", "b", "c1", "Gains", True, "SOURCE_UNKNOWN", False), (4, "a", "x", "c1", "Gains", None, "TARGET_UNKNOWN", False),
             (5, "a", "b", "c2", "Gains", True, "CHUNK_MISSING", False), (6, "a", "b", "c1", "G", True, "TOO_SHORT", False), (7, "a", "b", "c1", "losses", True, "NOT_GROUNDED", False)]
    frame = spark.createDataFrame(links, "id int, source string, target string, chunk string, evidence string, inferred boolean, want string, flag boolean")
    known, chunks = spark.createDataFrame([("a",), ("b",), ("a",)], "id string"), spark.createDataFrame([("c1", text)], "chunk string, text string")
    rows = extraction.relation_grounding(frame, known, chunks).collect()
    assert len(rows) == len(links) and all((r.verdict, r.audit) == (r.want, r.flag) for r in rows)


def test_paragraphs_over_pages_and_parents(spark):
    rows = [("s", 0, 1, "It goes"), ("s", 1, 2, "on with hy-"), ("s", 2, 3, "phens and"), ("s", 3, 3, "same page"), ("s", 4, 4, "Capital"), ("s", 5, 5, 'said "so."'), ("s", 6, 6, "small after a stop"), ("s", 7, 8, "a page between"), ("t", 8, 9, "other section")]
    got = documents.merge_paragraphs(spark.createDataFrame(rows, "section string, ordinal int, page int, text string"), "section").collect()
    want = [("s", 0, 1, 3, "It goes on with hyphens and"), ("s", 3, 3, 3, "same page"), ("s", 4, 4, 5, 'Capital said "so."'), ("s", 6, 6, 6, "small after a stop"), ("s", 7, 8, 8, "a page between"), ("t", 8, 9, 9, "other section")]
    assert sorted(map(tuple, got)) == want
    levels = [3, 2, 3, 1, 3, 2, 3, 4, 1, 3, None]
    headers = spark.createDataFrame([("d", i, i, n) for i, n in enumerate(levels)], "doc_id string, ordinal int, id int, level int")
    assert [r.parent for r in documents.section_parents(headers).orderBy("id").collect()] == [None, None, 1, None, 3, 3, 5, 5, None, 8, None]


def test_frames_and_cues(spark):
    said = "We propose a sparse routing model here. The problem of class imbalance and noise: We assume that all nodes agree. It was trained on a large dataset of chest images, including CT. Accuracy beyond accuracy. K-NN and knn, big knn."
    lexicon = {"METHOD": ["knn", "big knn", "sparse routing"], "METRIC": ["accuracy"], "TASK": ["class imbalance"]}
    rows = spark.createDataFrame([(1, said), (2, None), (3, "")], "doc_id int, text string")
    later = [("METHOD", "sparse routing model", 0.88), ("PROBLEM", "class imbalance", 0.86), ("DATASET", "chest images", 0.88), ("ASSUMPTION", "all nodes agree", 0.85), ("METHOD", "big knn", 0.95), ("METHOD", "KNN", 0.95)]
    got = extraction.scientific_entities(rows, lexicon).orderBy("ordinal").collect()
    assert [(r.category, r.name, r.confidence) for r in got] == later and all(said[r.start : r.end].lower() == r.name.lower() for r in got)
    first = [(r["category"], r["name"]) for r in extraction.scientific_spans(said, lexicon, "0.4.0")]
    assert len(first) == 10 and first.count(("METHOD", "KNN")) == 2 and ("PROBLEM", "class imbalance and noise") in first and ("TASK", "class imbalance") in first
    assert [said[a:b] for a, b in extraction.cue_sentences(said, "0.4.1")][1:3] == ["The problem of class imbalance and noise:", "We assume that all nodes agree."] and len(extraction.cue_sentences(said)) == 5
    assert extraction.cue_sentences(" A b.\n\"C d e. ") == [(1, 5), (6, 14)] and extraction.cue_sentences("  ") == extraction.cue_sentences(None) == []
    assert extraction.scientific_entities(rows.limit(0), lexicon).count() == extraction.statements(rows.limit(0)).count() == 0


def test_statement_versions(spark):
    cases = [
        ("It suffers from noise and future work remains.", "LIMITATION", "LIMITATION"), ("In future work it fails to converge at all.", "FUTURE_DIRECTION", "FAILURE_MODE"),
        ("We examine all of the cases here.", None, "CLAIM"), ("We propose it", None, None), ("Our main contributions are two new nets.", None, "CLAIM"), ("Nothing of note is told in here.", None, None),
        ("Future work: results show that x is y.", "FUTURE_DIRECTION", "RESULT"),
    ]
    rows = spark.createDataFrame(list(enumerate(cases)), "n int, c struct<said:string,first:string,later:string>").select("n", "c.*")
    got = rows.select(extraction.statement_kind(F.col("said")).alias("a"), extraction.statement_kind(F.col("said"), "0.4.1").alias("b")).collect()
    assert sorted((r.a or "", r.b or "") for r in got) == sorted((a or "", b or "") for _, a, b in cases)
    text = "Our main contributions are: One new net for all. All else is plain prose."
    found = extraction.statements(spark.createDataFrame([(1, text), (2, "It suffers from noise a lot."), (3, None)], "doc_id int, text string"), "0.4.1").collect()
    assert sorted((r.doc_id, r.start, r.end, r.kind, r.confidence) for r in found) == [(1, 0, 27, "CLAIM", 0.96), (1, 28, 48, "CLAIM", 0.96), (1, 49, 73, "CLAIM", 0.96), (2, 0, 28, "LIMITATION", 0.94)]


def test_downloads(spark):
    pdf = b"%PDF-1.7 " + b"x" * 200
    cases = [(None, None, "EMPTY_FILE"), (b"", None, "EMPTY_FILE"), (pdf, "text/html", "SUCCESS_PDF"), (b"%PDF-", None, "INVALID_PDF"), (b"x" * 2000 + pdf, None, "INVALID_PDF"), (b"\xff" * 300, "Text/HTML", "HTML_NOT_PDF"), (b" <BODY class=a>", None, "HTML_NOT_PDF"), (b"Access  denied; purchase", None, "PAYWALL"), (pdf + b" " * 5000 + b"<html>", None, "SUCCESS_PDF")]
    rows = spark.createDataFrame([(bytearray(a) if a is not None else None, b, w) for a, b, w in cases], "a binary, b string, w string")
    assert all(r.v.verdict == r.w and (r.v.sha256 is None) == (r.v.size == 0) for r in rows.select("w", readers.artifact(F.col("a"), F.col("b")).alias("v")).collect())
    rows = spark.createDataFrame([("", "", None, 200, None, 1, "FULLTEXT_UNAVAILABLE"), ("u", "1", "o", None, None, 1, "FULLTEXT_FAILED"), (None, "1", "o", 200, "text/html", 1, "FULLTEXT_AVAILABLE"), ("", None, "o", 200, "text/html", 1, "FULLTEXT_FAILED"), ("u", None, "o", 200, None, readers.MOST_BYTES + 1, "FULLTEXT_FAILED")], "k string, a string, o string, code int, kind string, size long, w string")
    url = readers.download_url(F.col("k"), F.col("a"), F.col("o"))
    assert all(r.v == r.w for r in rows.select("w", readers.download_status(url, F.lit(False), F.col("code"), F.col("kind"), F.col("size")).alias("v")).collect())


def test_year_range_join_counts_without_pairs(spark, tmp_path):
    """The query against its SQL on odd rows (no size, no name, no key, one key twice), the rule against brute force, and a large group."""
    rows = [(i, "ab"[i % 2], i * 7 % 5 - 2 if i % 6 else None) for i in range(40)] + [(3, "b", 0), (3, "b", 1), (4, "b", 0), (50, None, 1), (51, None, 1), (None, "a", 1), (52, "", 1), (53, "", 2), (54, "a", 2**31 - 1), (55, "a", 2**31 - 2), (56, "c", None)]
    frame = spark.createDataFrame(rows, "p_partkey long, p_name string, p_size int")
    frame.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT p_partkey, p_name, p_size::BIGINT AS p_size FROM '{tmp_path}/part.parquet/*.parquet'")
    got, want = catalog.queries()["J9_year_range_join"](spark, str(tmp_path)), con.sql(catalog.oracle_sql()["J9_year_range_join"]).fetchall()
    assert [tuple(r) for r in got.collect()] == want and want[0][0] > 100
    agree = lambda x, y: x is None or y is None or abs(x - y) <= 1
    whole = [r for r in rows if None not in r[:2]]
    n = sum(p[0] != q[0] and p[1] == q[1] and agree(p[2], q[2]) for i, p in enumerate(whole) for q in whole[:i])
    assert linkage.count_years_agree(frame, "p_name", "p_partkey", "p_size").first().n == n > want[0][0]
    assert linkage.count_years_agree(frame.where("false"), "p_name", "p_partkey", "p_size").first().n == 0
    large = spark.range(300_000).selectExpr("id AS p_partkey", "'x' AS p_name", "int(id % 2) AS p_size")
    assert linkage.count_years_agree(large, "p_name", "p_partkey", "p_size").first().n == 300_000 * 299_999 // 2


def test_statement_text_equals_its_sql(spark, tmp_path):
    """Texts that begin as a bullet does, odd white space and ends; the operator itself takes bullets off."""
    texts = ["56.187.231.175 Keit in", "- a", "(a) b!", "1) x. ", " a.  b\n", "", " ", None, "a.\u2028", "a.\x85", "a\x0bb", "\x0ba.\x0b", "\u00a0a?\u3000 ", "\u3000 x\u3000 y", "a\u200b", "\u2003.\r\n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got, want = catalog.queries()["F14_statement_text"](spark, str(tmp_path)), con.sql(catalog.oracle_sql()["F14_statement_text"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == len(texts)
    assert [one(spark, T.statement_text(F.lit(x))) for x in ("- a", "2) (b) c  d?", "x")] == ["a.", "c d?", "x."]
