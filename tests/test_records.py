import json

import numpy as np
from pyspark.sql import functions as F

from litloom import service
from litloom.functions import text as T
from litloom.operators import documents, embeddings, graphs, knowledge


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_values_of_the_rules(spark):
    lit = F.lit
    got = one(
        spark,
        a=T.document_type(lit("review"), lit("semantic_scholar"), lit(None)), b=T.document_type(lit("Book Review"), lit("semantic_scholar"), lit("Surveys")), c=T.document_type(lit("x"), lit("arxiv"), lit("State-of-the-art review")),
        d=T.document_type(lit(""), lit("crossref"), lit("t")), e=T.fulltext_status(lit("fetching")), f=T.section_bucket(lit(None)), g=T.edge_case(F.repeat(lit("word 3.5% = "), 20)), h=T.entity_name(lit("1) (see) [LSTM].")),
        i=F.array_join(T.tokens(lit("The model can't learn of state-of-the-art nets, it's 42")), " "), j=T.hedged(lit("This may work")), k=T.hedged(lit("maybe")), l=T.node_domain(lit(None), F.array(lit("Nature"), lit("FinTech")), lit("CNN")),
    )
    assert (got.a, got.b, got.c, got.d, got.e, got.f) == ("REVIEW", "REVIEW", "REVIEW", "UNKNOWN", "DOWNLOADING", "OTHER")
    assert (got.g, got.h, got.i, got.j, got.k, got.l) == ("DENSE_NUMERICAL_AND_FORMULAS", "LSTM", "model can learn state-of-the-art nets", True, False, "Finance / Economics")


def test_segments_and_chunks(spark):
    texts = ["See Fig. 2 of Doe et al. for more. J. Doe came at 3.5 today. ok so. And it goes on here", "short", "  ", "A. B. He x. No?"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.s for r in rows.select("doc_id", documents.segments(F.col("text")).alias("s")).collect()}
    assert got[0] == ["See Fig. 2 of Doe et al. for more.", "J. Doe came at 3.5 today. ok so.", "And it goes on here"]
    assert got[1] == ["short"] and got[2] == [] and all(len(s) >= documents.MIN_SENTENCE for s in got[3])
    long = " ".join(f"Sentence number {i} has some more words in it." for i in range(80))
    parts = documents.paragraph_chunks(f"first one\n{long}\nlast one")
    assert parts[0] == "first one" and parts[-1] == "last one" and " ".join(parts[1:-1]) == long and max(map(len, parts)) <= documents.CUT
    assert documents.paragraph_chunks("a" * 1199 + "\n" + "b" * 1300) == ["a" * 1199, "b" * 1300] and documents.paragraph_chunks(None) == []


def test_running_heads(spark):
    blocks = [("d", p, f"Journal {p}", 10.0, 20.0) for p in range(3)] + [("d", p, f"Body {p}", 300.0, 400.0) for p in range(3)] + [("d", 0, "vii", 780.0, 790.0), ("d", 1, "Copyright 2020", 780.0, 790.0), ("d", 2, "A last line", 780.0, 790.0), ("e", 0, "Journal 1", 10.0, 20.0)]
    rows = spark.createDataFrame([(*b, 792.0) for b in blocks], "doc_id string, page int, text string, y0 double, y1 double, height double")
    tagged = documents.running_heads(rows)
    assert sorted((r.doc_id, r.text) for r in tagged.where("furniture").collect()) == [("d", "Copyright 2020"), ("d", "Journal 0"), ("d", "Journal 1"), ("d", "Journal 2"), ("d", "vii")]
    assert {(r.doc_id, r.page): r.text for r in documents.page_text(tagged).collect()} == {("d", 0): "Body 0", ("d", 1): "Body 1", ("d", 2): "Body 2\n\nA last line", ("e", 0): "Journal 1"}


def test_references_and_relations(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    known = knowledge.references(ids("e1", "x"), ids("s1", "x"), spark.createDataFrame([("u1", "s1"), ("u2", "m7"), ("e1", "s1")], "id string, kb_id string"))
    assert {r.ref: (r.kb_id, r.kind) for r in known.collect()} == {"e1": ("e1", "ENTITY"), "x": ("x", "ENTITY"), "s1": ("s1", "STATEMENT"), "u1": ("s1", "STATEMENT"), "u2": ("m7", "ENTITY")}
    schema = "relation_id string, relation_type string, source_id string, target_id string, evidence struct<text:string,start_char:int,end_char:int>, provenance struct<canonical_id:string,chunk_id:string,document_id:string>"
    good, chain = ("t", 3, 3), ("p", "c", "d")
    rows = [("1", "USES", "e1", "u1", good, chain), ("2", "USES", "e1", "gone", good, chain), (" ", "USES", "e1", "u1", good, chain), ("4", "uses", "e1", "u1", good, chain), ("5", "USES", "e1", "u1", ("t", 3, 2), chain), ("6", "USES", "e1", "u1", (" ", 3, 4), chain), ("7", "USES", "e1", "u1", good, ("p", None, "d")), ("8", "USES", None, "u1", None, None)]
    out = {r.relation_id: r.reason for r in knowledge.validate_relations(spark.createDataFrame(rows, schema), known).collect()}
    assert out == {"1": None, "2": "DANGLING_RELATION_ENDPOINT", " ": "SCHEMA_VALIDATION_ERROR", "4": "SCHEMA_VALIDATION_ERROR", "5": "INVALID_SPAN_BOUNDS", "6": "UNGROUNDED_EVIDENCE", "7": "MISSING_PROVENANCE_FIELD", "8": "SCHEMA_VALIDATION_ERROR"}


def tables(spark):
    f = spark.createDataFrame
    return {
        "papers": f([("p1", "First paper", "abs"), ("p2", "Second", None)], "paper_id string, title string, abstract string"),
        "entities": f([("e1", "METHOD", "Adam", None, ["p1"], ["c1"], 3), ("e2", "odd", "Eve", None, ["p2"], ["c2"], 5)], "entity_id string, category string, canonical_name string, description string, paper_ids array<string>, chunk_ids array<string>, mentions_count int"),
        "statements": f([("s1", "CLAIM", "adam is fast", "Adam is fast", "p1", "c1", 0.8, ["e1", "gone"]), ("s2", "FAILURE_MODE", "x", "x", "p9", "c2", 0.8, None)], "statement_id string, category string, normalized_statement string, surface_text string, paper_id string, chunk_id string, confidence_score double, related_entity_ids array<string>"),
        "relationships": f([(1, "r1", "e1", "e2", "uses", "p1", "c1", "SUPPORTED", 0.5, "t"), (2, "r2", "e1", "e2", "uses", "p1", "c1", "UNSUPPORTED", 0.5, "t"), (3, "r3", "e1", "gone", "uses", "p1", "c1", "UNSUPPORTED", 0.5, "t"), (4, "r4", "e2", "e1", "eats", "p1", "c2", "odd", 0.5, "t")], "ord int, relationship_id string, source_id string, target_id string, relation_type string, paper_id string, chunk_id string, evidence_support string, confidence_score double, evidence_text string"),
        "chunks": f([("c1", "adam optimizer learns", [1.0, 0.0]), ("c2", "eve network learns", [0.0, 1.0])], "chunk_id string, text string, vector array<double>"),
    }


def test_graph_of_a_knowledge_base(spark):
    t = tables(spark)
    built = graphs.build(t["papers"], t["entities"], t["statements"], t["relationships"])
    assert {(r.edge_id, r.src, r.dst, r.predicate, r.support) for r in built["edges"].collect()} == {("edge_contain_s1", "p1", "s1", "CONTAINS", "SUPPORTED"), ("edge_stmt_ent_s1_e1", "s1", "e1", "REPORTS", "SUPPORTED"), ("r1", "e1", "e2", "USES", "SUPPORTED"), ("r4", "e2", "e1", "ADDRESSES", "NOT_ASSESSED")}
    assert {r.id: r.kind for r in built["nodes"].collect()} == {"p1": "PAPER", "p2": "PAPER", "e1": "METHOD", "e2": "METHOD", "s1": "CLAIM", "s2": "STATEMENT"}
    assert built["report"].first().asDict() == {"nodes": 6, "edges": 4, "trusted": 3, "untrusted": 1, "duplicates": 1, "dangling": 1, "integrity": 0.8}
    few = graphs.build(t["papers"], t["entities"], t["statements"], t["relationships"], include_unsupported=False, max_papers=1)
    assert few["nodes"].where("kind = 'PAPER'").count() == 1 and few["edges"].count() == 3
    none = graphs.build(*[t[n].where("false") for n in ("papers", "entities", "statements", "relationships")])
    assert none["report"].first().integrity == 1.0 and none["edges"].count() == 0


def test_service_and_command_line(spark, tmp_path, capsys):
    for name, rows in tables(spark).items():
        rows.write.parquet(str(tmp_path / name))
    own = service.Service.of_folder(spark, str(tmp_path))
    assert own.health() == {"papers": 2, "entities": 2, "statements": 2, "relationships": 4, "chunks": 2}
    assert [r.id for r in own.hybrid("eve network", [0.0, 1.0], 2).orderBy("rank").collect()][0] == "c2"
    assert {r.id for r in own.neighborhood("p1", 2).collect()} == {"p1", "s1", "e1"} and own.paths("p1", "e2").count() == 1
    assert own.chunk("c1")["relationships"].count() == 3 and own.compare("adam", [1.0, 0.0], 1).first().jaccard == 1.0
    lines = service.main([str(tmp_path), "--entities"], spark)
    assert [json.loads(x)["canonical_name"] for x in lines] == ["Eve", "Adam"] and capsys.readouterr().out
    assert len(service.main([str(tmp_path), "--chunk", "c2"], spark)) == 2 and len(service.main([str(tmp_path), "--search", "first"], spark)) == 1


def test_latent_semantics(spark):
    topics = ["neural network training converges fast", "bank interest rates rise again"]
    texts = [(i, f"{topics[i % 2]} case {i}") for i in range(20)]
    rows = spark.createDataFrame([*texts, (99, "zzz")], "doc_id long, text string")
    own = embeddings.encoder("unknown", {}).fit(rows.where("doc_id < 99"))
    got = {r.doc_id: np.array(r.vector) for r in own.encode(rows).collect()}
    assert all(len(v) == embeddings.DIMENSION for v in got.values())
    assert all(abs(np.linalg.norm(got[i]) - 1) < 1e-5 for i in range(20)) and not got[99].any()
    assert got[0] @ got[2] > 0.5 > got[0] @ got[1]
    made = embeddings.encoder("bge-small-en-v1.5", {"bge-small-en-v1.5": lambda: lambda texts: [[3.0, float(len(t))] for t in texts]})
    rep = embeddings.representations(made, chunks=spark.createDataFrame([("c", "abcd")], "chunk_id string, text string"), entities=spark.createDataFrame([("e", "Adam", "PROBLEM", None, None)], "entity_id string, canonical_name string, category string, description string, aliases array<string>"))
    out = {r.kind: (r.text, np.round(r.vector, 3).tolist()) for r in rep.collect()}
    assert out["CHUNK"] == ("abcd", [0.6, 0.8]) and out["PROBLEM"][0] == "Adam (PROBLEM).  Aliases:"


def test_versions_and_alias_lists(spark):
    a, b = spark.createDataFrame([("x", 1), ("y", 2)], "id string, v int"), spark.createDataFrame([("x", 3)], "id string, v int")
    assert {r.id: r.v for r in knowledge.later_wins(a, b).collect()} == {"x": 3, "y": 2} and knowledge.versions(a, b).where("src_order = 0").count() == 2
    aliases = spark.createDataFrame([("b", "z"), ("a", "y")], "canonical string, alias string")
    assert [r.alias for r in knowledge.alias_listing(aliases, 1).collect()] == ["y"]
