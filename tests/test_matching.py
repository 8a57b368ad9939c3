import difflib
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from litloom.functions import sections
from litloom.functions import text as T
from litloom.operators import audits, dossiers, matching, selection

TITLES = [
    "deep learning for protein folding at scale with graph networks", "deep learning for protein folding at scale with graph network", "deep learning for protein folding at scale with graphs",
    "a survey of causal inference in medicine and public health today", "a survey of causal inference in medicine and public health", "on sets", "on set", "quantum error correction codes",
]


def similarity(a, b):
    x, y = set(a.split()), set(b.split())
    return 0.4 * len(x & y) / len(x | y) + 0.6 * difflib.SequenceMatcher(None, a, b).ratio()


@pytest.mark.parametrize("least", [0.8, 0.9])
def test_similar_titles_lose_no_pair(spark, least):
    got = matching.similar_titles(spark.createDataFrame(list(enumerate(TITLES)), "id int, key string"), least).collect()
    want = {(i, j): similarity(a, b) for (i, a), (j, b) in combinations(enumerate(TITLES), 2) if similarity(a, b) >= least}
    assert {(r.a, r.b): r.similarity for r in got} == pytest.approx(want) and want


def test_match_levels(spark):
    rows = [(1, TITLES[0], "10.1/A", None, ["a"], 2020), (2, "other", "10.1/a", None, ["b"], 1990), (3, TITLES[0], None, None, ["a"], 2021), (4, TITLES[0], None, None, ["z"], 2021), (5, TITLES[0], None, None, ["z"], 1990), (6, TITLES[1], None, None, None, None), (7, None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "id int, title string, doi string, arxiv string, authors array<string>, year int")
    got = {(r.a, r.b): r.level for r in matching.match_pairs(frame).collect()}
    assert got == {(1, 2): "EXACT", (1, 3): "EXACT", (1, 4): "HIGH_CONFIDENCE", (1, 5): "POSSIBLE", (1, 6): "HIGH_CONFIDENCE" if similarity(TITLES[0], TITLES[1]) >= 0.96 else "POSSIBLE"}
    assert matching.match_pairs(frame.where("false")).count() == 0


def test_all_pairs_are_those_of_match_papers(spark):
    """Against every two records compared as match_papers does, so also the links between records that are no heads."""
    rows = [(i, TITLES[i * 7 % 3 if i < 30 else i % len(TITLES)], f"10.1/{i}" if i % 9 else "10.1/same", "x" if i in (4, 31) else None, [None, ["a"], ["a", "b"], ["z"]][i % 4], [None, 2000, 2001, 2003, 2010][i % 5]) for i in range(40)]
    rows += [(40, None, None, None, ["a"], 2000), (41, "", None, None, ["a"], 2000)]

    def level(p, q):
        if (p[2] and p[2] == q[2]) or (p[3] and p[3] == q[3]):
            return "EXACT"
        if not p[1] or not q[1]:
            return None
        who, when = not p[4] or not q[4] or bool(set(p[4]) & set(q[4])), p[5] is None or q[5] is None or abs(p[5] - q[5]) <= 1
        if p[1] == q[1]:
            return "EXACT" if who and when else "HIGH_CONFIDENCE" if who or when else "POSSIBLE"
        near = similarity(p[1], q[1]) if who and when else 0
        return "HIGH_CONFIDENCE" if near >= 0.96 else "POSSIBLE" if near >= 0.9 else None

    want = {(p[0], q[0]): level(p, q) for p, q in combinations(rows, 2) if level(p, q)}
    frame = spark.createDataFrame(rows, "id int, title string, doi string, arxiv string, authors array<string>, year int")
    got = matching.match_all_pairs(frame).collect()
    assert {(r.a, r.b): r.level for r in got} == want and len(got) == len(want) and set(want.values()) == {"EXACT", "HIGH_CONFIDENCE", "POSSIBLE"}
    heads = {(r.a, r.b) for r in matching.match_pairs(frame).collect()}
    assert len(want.keys() - heads) > 100
    assert matching.match_all_pairs(frame.where("false")).count() == 0


@pytest.mark.parametrize("block", [1, 3])
def test_all_pairs_over_many_blocks(spark, block, monkeypatch):
    """Blocks and classes of any size give each link once, and pairs are made last: nothing shuffles or groups them."""
    monkeypatch.setattr(matching, "BLOCK", block)
    rows = [(i, TITLES[i % 2] if i < 90 else TITLES[i % 8], "10.1/X" if i % 10 == 0 else None, "y" if i % 15 == 0 else None, [["a"], ["a", "b"], ["z"], None][i % 4 if i > 40 else 0], [2000, 2001, 2003, None][i % 8 // 2 if i > 40 else 0]) for i in range(100)]
    frame = spark.createDataFrame(rows, "id int, title string, doi string, arxiv string, authors array<string>, year int")

    def level(p, q):
        if (p[2] and p[2] == q[2]) or (p[3] and p[3] == q[3]):
            return "EXACT"
        who, when = not p[4] or not q[4] or bool(set(p[4]) & set(q[4])), p[5] is None or q[5] is None or abs(p[5] - q[5]) <= 1
        if p[1] == q[1]:
            return "EXACT" if who and when else "HIGH_CONFIDENCE" if who or when else "POSSIBLE"
        near = similarity(p[1], q[1]) if who and when else 0
        return "HIGH_CONFIDENCE" if near >= 0.96 else "POSSIBLE" if near >= 0.9 else None

    want = {(p[0], q[0]): level(p, q) for p, q in combinations(rows, 2) if level(p, q)}
    out = matching.match_all_pairs(frame)
    got = out.collect()
    assert {(r.a, r.b): r.level for r in got} == want and len(got) == len(want) > 1000
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "Generate explode(ys" in plan and not any(x in plan[: plan.index("Generate explode(ys")] for x in ("Exchange", "Aggregate", "Join"))


def test_batches_are_checked(spark):
    with pytest.raises(ValueError):
        dossiers.ask(spark.range(dossiers.MOST_ASKED + 1))
    records = spark.createDataFrame([("r", "Graph Net", "X", "d", "e", "p")], "record_id string, concept string, category string, description string, evidence string, paper string")
    found = dossiers.limitations(records, spark.createDataFrame([("graph",), ("big graph net",), ("tree",)], "method string"))
    assert sorted(r.method for r in found.collect()) == ["big graph net", "graph"]


def test_any_number_of_gaps(spark):
    gaps = [(i, f"alpha{i % 7} beta{i % 5}") for i in range(2 * dossiers.MOST_ASKED + 300)]
    said = [(1, "Alpha1 with beta1", "p", "LIMITATION"), (2, "alpha2 and beta3 failed", "p", "RESULT"), (3, "alpha1 beta1", "p", "CLAIM")]
    docs = spark.createDataFrame([(1, "we propose alpha3 beta3", "q")], "id int, text string, paper string")
    hits = spark.createDataFrame([(i, 1, 0.9) for i, _ in gaps], "gid int, id int, score double")
    statements = spark.createDataFrame(said, "id int, text string, paper string, category string")
    titles = spark.createDataFrame([("p", "One")], "paper string, title string")
    out, _ = dossiers.verify_gaps(spark.createDataFrame(gaps, "gid int, text string"), hits, docs, statements, titles)
    want = {(i, int(i % 7 == 3 == i % 5), int(i % 7 == 2 and i % 5 == 3), int(i % 7 == 1 == i % 5), 1) for i, _ in gaps}
    assert {(r.gid, r.precedents, r.contradictions, r.supporting, r.hits) for r in out.collect()} == want and out.count() == len(gaps)


def test_sharing_equals_brute_force(spark):
    gaps = [(1, "Graph graph of trees"), (2, "self-play über_net a1b"), (3, ""), (4, None), (5, "nets 1b2 trees"), (5, "nets 1b2 trees")]
    texts = ["GRAPHS", "hypertrees subgraph", "x-self-play-x/übER_NETS", "a1b2,nets", "", None, "tree", "a1b\tüber_net", "über net\u2003nets.trees", "graph" * 5000 + "-trees"] * 3
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string").withColumn("tags", F.array(F.lit("t")))
    block = spark.createDataFrame(gaps, "gid int, text string").select("gid", T.tokens(F.col("text")).alias("_t"))
    got = sorted((r.gid, r.n) for r in dossiers.sharing(rows, block, pairs=3).collect())
    asked = [(r.gid, r._t) for r in block.collect()]
    want = sorted((gid, n) for gid, tokens in asked for n, said in enumerate(texts) if sum(t in (said or "").lower() for t in tokens) >= 2)
    assert got == want and len(want) > 20
    assert dossiers.sharing(rows.limit(0), block).count() == dossiers.sharing(rows, block.limit(0)).count() == 0


def test_findings_have_excerpts(spark):
    gaps = spark.createDataFrame([(1, "graph trees")], "gid int, text string")
    docs = spark.createDataFrame([(1, "we propose graph trees", "p")], "id int, text string, paper string")
    statements = spark.createDataFrame([(n, "Graph trees " + "x" * 300, "q", "LIMITATION") for n in range(9)], "id int, text string, paper string, category string")
    hits, titles = spark.createDataFrame([(1, 1, 0.9)], "gid int, id int, score double"), spark.createDataFrame([("p", "One")], "paper string, title string")
    _, best = dossiers.verify_gaps(gaps, hits, docs, statements, titles)
    rows = {r.ref: (r.side, r.title, len(r.excerpt)) for r in best.collect()}
    assert rows == {"hit_1": ("OPPOSING", "One", 22)} | {f"stmt_{n}": ("SUPPORTING", "Paper q", 250) for n in range(dossiers.FINDINGS)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, kind string, src long, dst long, predicate string")
    row = audits.graph_report(none.select("id", "kind"), none.select("src", "dst", "predicate")).first()
    assert (row.nodes, row.edges, row.integrity) == (0, 0, 1.0)
    chunks = spark.createDataFrame([], "id long, paper string, bucket string, edge boolean")
    assert selection.stratified(chunks, 75, 42).count() == 0


def test_sample_is_whole(spark):
    chunks = spark.range(40).select("id", F.lit("p").alias("paper"), F.lit("METHODS").alias("bucket"), (F.col("id") == 3).alias("edge"))
    got = {r.id: r.stratum for r in selection.stratified(chunks, 30, 1).collect()}
    assert len(got) == 30 and got[3] == "EDGE"


def test_full_stops(spark):
    text = "We got 3.14 of it, e.g. by J. Smith et al. in Fig. 2. Then more."
    row = spark.range(1).select(sections.protect(F.lit(text)).alias("p"), sections.unprotect(sections.protect(F.lit(text))).alias("u")).first()
    assert row.u == text and row.p.count(".") == 2 and row.p.endswith("Then more.")
