"""Negative knowledge, gap dossiers, transfers between fields, hypotheses, their review and experiments.

Batches of questions (methods, candidates) are small beside the corpus: ask() checks that and only then broadcasts them,
since substring conditions leave no key to join by. Larger batches are to be split by the caller, but gaps, which
verify_gaps takes in blocks of about MOST_ASKED gaps and MOST_TOKENS tokens: sharing() sends a block to the workers.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import ship
from ..storage import spread
from . import graphs, retrieval, selection

MOST_ASKED, MOST_TOKENS = 1000, 100_000
# Pairs in a batch that sharing() gives, words it keeps in a worker, and the longest of them.
PAIRS, MEMO, MEMO_WORD = 65_536, 200_000, 64
#: ASCII characters that no token has: a token's place in a text lies between two of them.
_BETWEEN = re.compile(r"[\x00-,./:-@\[-^`{-\x7f]+")

# Phrases, levels and scores of the rules below.
SOLVED = ["we propose", "we present", "we demonstrate", "our method achieves"]
OPEN = ["remains open", "challenging", "unsolved", "bottleneck", "limitation", "lack of"]
NEGATIVE = ["failed", "degraded", "ineffective", "did not improve"]
COSTLY = ["computational", "cost", "memory", "latency", "storage"]
ASSUMING = ["assumption", "assumes"]
MECHANICAL = ["decoupling", "gradient", "optimization", "aggregation", "latency", "loss", "parameter"]
PRECEDENT_SCORE, STATED_SCORE, CONTRARY_SCORE, FINDINGS = 0.65, 0.90, 0.85, 5
NAMED, UNNAMED = 0.75, 0.45
SEVERITIES = ["CRITICAL", "MAJOR", "MINOR"]


def ask(df: DataFrame) -> DataFrame:
    """df, to be broadcast; an error where it has more than MOST_ASKED rows."""
    if df.limit(MOST_ASKED + 1).count() > MOST_ASKED:
        raise ValueError(f"a batch has {MOST_ASKED} rows at most")
    return F.broadcast(df)


def asked_blocks(df: DataFrame, tokens: str) -> list[DataFrame]:
    """df in parts by hash, of about MOST_ASKED rows and MOST_TOKENS tokens at most: one part where df has no more."""
    rows, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(tokens)), F.lit(0))).first()
    n = max(-(-rows // MOST_ASKED), -(-total // MOST_TOKENS))
    if n <= 1:
        return [df]
    place = F.pmod(F.xxhash64(*df.columns), F.lit(n))
    return [df.where(place == k) for k in range(n)]


class Postings:
    """The tokens of a block of gaps: which of them a text holds, as substrings in any case, and so how many of each gap's."""

    def __init__(self, gaps: list[list[str]]):
        owners: dict[str, list[int]] = {}
        for gap, tokens in enumerate(gaps):
            for token in tokens:
                owners.setdefault(token, []).append(gap)
        self.n, self.starts, self.memo = len(gaps), {}, {}
        self.owners = [np.array(own, np.int32) for own in owners.values()]
        for i, token in enumerate(owners):
            self.starts.setdefault(token[: T.MIN_TOKEN], []).append((token, i))

    def in_word(self, word: str) -> list[int]:
        found = self.memo.get(word)
        if found is None:
            places = range(len(word) - T.MIN_TOKEN + 1)
            found = list({i for at in places for token, i in self.starts.get(word[at : at + T.MIN_TOKEN], ()) if word.startswith(token, at)})
            if len(word) <= MEMO_WORD:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[word] = found
        return found

    def held(self, low: str | None, least: int) -> np.ndarray:
        """The gaps of which the text, in lower case, holds `least` tokens or more; a token counts as often as its gap has it."""
        tokens = {i for word in set(_BETWEEN.split(low or "")) for i in self.in_word(word)}
        if not tokens:
            return np.empty(0, np.int64)
        return np.flatnonzero(np.bincount(np.concatenate([self.owners[i] for i in tokens]), minlength=self.n) >= least)


def sharing(rows: DataFrame, block: DataFrame, least: int = 2, pairs: int = PAIRS) -> DataFrame:
    """gid and the columns of rows but text, for every gap of the block (gid, _t: its tokens) and every row whose text holds
    `least` of its tokens. The block's tokens go to the workers once, each text is read once, and nothing is shuffled."""
    asked = block.select("gid", "_t").toArrow()
    gids, posted = asked.column("gid").combine_chunks(), Postings(asked.column("_t").to_pylist())
    kept = [c for c in rows.columns if c != "text"]

    def give(batch, at, gaps):
        here, there = pa.array(np.concatenate(at)), pa.array(np.concatenate(gaps))
        return pa.RecordBatch.from_arrays([gids.take(there), *[batch.column(c).take(here) for c in kept]], names=["gid", *kept])

    def run(batches):
        for batch in batches:
            at, gaps, n = [], [], 0
            for i, low in enumerate(batch.column("_low")):
                met = posted.held(low.as_py(), least)
                if met.size:
                    at.append(np.full(met.size, i))
                    gaps.append(met)
                    n += met.size
                if n >= pairs:
                    yield give(batch, at, gaps)
                    at, gaps, n = [], [], 0
            if n:
                yield give(batch, at, gaps)

    ship(rows.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [block.schema["gid"], *[rows.schema[c] for c in kept]])
    return rows.select(*kept, F.lower("text").alias("_low")).mapInArrow(run, schema)


def any_in(text: Column, phrases: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(F.lower(text), p))


def negative_index(statements: DataFrame, relations: DataFrame, entities: DataFrame) -> DataFrame:
    """record_id, concept, category, description, evidence, paper. statements: id, paper, category, text, related (array of entity ids).
    relations: id, paper, kind, source, target, evidence. entities: id, name. Names that do not resolve: a general one, or the id."""
    own = statements.where(F.col("category").isin("LIMITATION", "FAILURE_MODE")).withColumn("_e", F.try_element_at("related", F.lit(1)))
    names = entities.select(F.col("id").cast("string").alias("_e"), "name")
    base = F.when(F.col("category") == "LIMITATION", "METHOD_LIMITATION").otherwise("EMPIRICAL_REGRESSION")
    kind = F.when(any_in(F.col("text"), COSTLY), "COMPUTATIONAL_BOTTLENECK").when(any_in(F.col("text"), ASSUMING), "ASSUMPTION_FAILURE").otherwise(base)
    said = own.join(names, "_e", "left").select(F.concat(F.lit("neg_stmt_"), "id").alias("record_id"), F.coalesce("name", F.lit("scientific method")).alias("concept"), kind.alias("category"), F.col("text").alias("description"), F.col("text").alias("evidence"), F.col("paper").cast("string").alias("paper"))
    rel = relations.where(F.col("kind").isin("LIMITED_BY", "CONTRADICTS"))
    for end in ("source", "target"):
        rel = rel.join(names.select(F.col("_e").alias(end), F.col("name").alias(f"{end}_name")), end, "left").withColumn(f"{end}_name", F.coalesce(f"{end}_name", end))
    kind = F.when(F.col("kind") == "CONTRADICTS", "CONTRADICTION").when(any_in(F.col("target_name"), COSTLY[:2]), "COMPUTATIONAL_BOTTLENECK").otherwise("METHOD_LIMITATION")
    text = F.concat_ws(" ", F.col("source_name"), F.lit("is held back by"), F.col("target_name"))
    linked = rel.select(F.concat(F.lit("neg_rel_"), "id").alias("record_id"), F.col("source_name").alias("concept"), kind.alias("category"), text.alias("description"), F.coalesce("evidence", text).alias("evidence"), F.col("paper").cast("string").alias("paper"))
    return said.unionByName(linked)


def limitations(records: DataFrame, methods: DataFrame) -> DataFrame:
    """Records whose concept holds the method's name or is held by it. methods: method, at most MOST_ASKED rows.
    Names are compared once a distinct concept."""
    asked = ask(methods.select("method").distinct().withColumn("_m", F.lower(F.trim("method"))))
    concepts = records.select("concept").distinct().withColumn("_c", F.lower(F.trim("concept")))
    met = concepts.join(asked, F.contains("_c", "_m") | F.contains("_m", "_c")).select("concept", "method")
    return records.join(met, "concept")


def contradiction_risk(found: DataFrame, task: Column) -> DataFrame:
    """Limitations whose description has a word of the task of more than three characters."""
    words = F.filter(F.split(F.lower(F.trim(task)), r"\s+"), lambda w: F.length(w) > 3)
    return found.where(F.exists(words, lambda w: F.contains(F.lower("description"), w)))


def verify_gaps(gaps: DataFrame, hits: DataFrame, docs: DataFrame, statements: DataFrame, titles: DataFrame, solved: list[str] = SOLVED, still: list[str] = OPEN, negative: list[str] = NEGATIVE, threshold: float = PRECEDENT_SCORE) -> tuple[DataFrame, DataFrame]:
    """(dossiers, findings). gaps: gid, text, any number; hits: gid, id, score of the retrievers' lists, an id
    once a gap; docs: id, text, paper; statements: id, text, paper, category; titles: paper, title."""
    asked = gaps.select("gid", T.tokens(F.col("text")).alias("_t"))
    n_in = lambda tokens, text: F.size(F.filter(tokens, lambda t: F.contains(F.lower(text), t)))
    excerpt = F.substring("text", 1, 250)
    read = hits.select("gid", "id", "score").join(docs.select("id", "text", "paper"), "id").join(asked, "gid")
    precedent = (n_in(F.slice("_t", 1, 3), F.col("text")) >= 2) & any_in(F.col("text"), solved) & (F.col("score") > threshold)
    relation = F.when(precedent, "DIRECT_PRECEDENT").when(any_in(F.col("text"), still), "SUPPORTING_EVIDENCE")
    found = read.select("gid", F.concat(F.lit("hit_"), "id").alias("ref"), "paper", F.col("score").cast("double").alias("score"), relation.alias("relation"), excerpt.alias("excerpt"))
    stated = F.col("category") != "RESULT"
    relation = F.when(stated, "SUPPORTING_EVIDENCE").when(any_in(F.col("text"), negative), "CONTRADICTORY_FINDING")
    told = statements.where(F.col("category").isin("LIMITATION", "FAILURE_MODE", "RESULT"))
    told = told.select(F.concat(F.lit("stmt_"), "id").alias("ref"), "paper", "text", F.when(stated, STATED_SCORE).otherwise(CONTRARY_SCORE).alias("score"), relation.alias("relation"))
    told = spread(told).where("relation is not null")
    near = functools.reduce(DataFrame.unionByName, [sharing(told, part) for part in asked_blocks(asked, "_t")])
    found = found.where("relation is not null").unionByName(near, allowMissingColumns=True)
    of = lambda r: F.count_if(F.col("relation") == r)
    sums = found.groupBy("gid").agg(of("DIRECT_PRECEDENT").alias("precedents"), of("CONTRADICTORY_FINDING").alias("contradictions"), of("SUPPORTING_EVIDENCE").alias("supporting"))
    sizes = hits.groupBy("gid").agg(F.count_distinct("id").alias("hits"))
    out = gaps.select("gid").join(sums, "gid", "left").join(sizes, "gid", "left").na.fill(0, ["precedents", "contradictions", "supporting", "hits"])
    status = F.when(F.col("precedents") > 0, "EVIDENCE_AGAINST_GAP").when(F.col("contradictions") > 0, "REQUIRES_REVIEW").when((F.col("supporting") == 0) & (F.col("hits") < 2), "INSUFFICIENT_EVIDENCE").otherwise("POSSIBLE_GAP")
    side = F.when(F.col("relation") == "SUPPORTING_EVIDENCE", "SUPPORTING").otherwise("OPPOSING")
    best = selection.quota(found.withColumn("side", side), ["gid", "side"], [F.desc("score"), "ref"], FINDINGS)
    said = told.select("ref", excerpt.alias("_said")).groupBy("ref").agg(F.min("_said").alias("_said"))
    best = best.join(said, "ref", "left").withColumn("excerpt", F.coalesce("excerpt", "_said")).drop("_said")
    best = best.join(titles.select("paper", "title"), "paper", "left").withColumn("title", F.coalesce("title", F.concat(F.lit("Paper "), F.col("paper").cast("string"))))
    return out.withColumn("status", status), best


def target_domain(problem: Column) -> Column:
    low = F.lower(problem)
    return F.when(low.rlike("health|clinic|patient"), "Healthcare & Oncology").when(low.rlike("privacy|secur"), "Security & Privacy").otherwise("Target Domain")


def transfers(methods: DataFrame, problem: str, docs: DataFrame, least: float = 0.35, limit: int = 5) -> DataFrame:
    """Methods (id, name, domain, paper, evidence) of other domains, for a problem in words: best candidates first.
    docs: doc_id, text, paper. One batch retrieval of all methods' questions."""
    asked = methods.withColumn("target", target_domain(F.lit(problem))).where("domain <> target")
    hits = retrieval.top_k(retrieval.bm25(docs.select("doc_id", "text"), asked.select(F.col("id").alias("qid"), F.concat_ws(" ", "name", F.lit(problem)).alias("text"))), 3).where("score > 0")
    read = hits.select(F.col("qid"), F.col("id").alias("doc_id")).join(docs.select("doc_id", "text", F.col("paper").alias("hit_paper")), "doc_id")
    read = read.join(asked.select(F.col("id").alias("qid"), "name", "paper"), "qid")
    own = read.groupBy("qid").agg(F.max(F.contains(F.lower("text"), F.lower("name"))).alias("named"), F.count(F.lit(1)).alias("found"), F.collect_set("hit_paper").alias("papers"))
    rows = asked.join(own, F.col("id") == F.col("qid"), "left")
    papers = F.array_union(F.coalesce("papers", F.array().cast("array<string>")), F.array("paper"))
    evidence = F.col("evidence") + F.coalesce("found", F.lit(0))
    shared = F.coalesce(F.array_contains("papers", F.col("paper")), F.lit(False))
    score = graphs.score(F.when(F.col("named"), NAMED).otherwise(UNNAMED), evidence, F.size(papers), F.lit(True), F.lit(True), F.lit(0), shared)
    why = rationale(F.lit(True), shared, F.lit(0.0), evidence, F.size(papers))
    out = rows.select("id", "name", "domain", "target", score.alias("score"), why.alias("rationale"), evidence.cast("long").alias("evidence"), F.lit(problem).alias("problem"))
    return out.where(F.col("score") >= least).orderBy(F.desc("score"), "id").limit(limit)


def rationale(other_domain: Column, shared: Column, contradiction: Column, evidence: Column, papers: Column) -> Column:
    """What a candidate's score rests on, in words."""
    return F.concat_ws(
        " ", F.when(other_domain, "The fields lie far apart.").otherwise("Both lie in one field."),
        F.when(shared, "A paper already has both.").otherwise("No paper has both yet."),
        F.when(contradiction > 0, F.format_string("Contradictions cost %.2f.", contradiction.cast("double"))),
        F.format_string("Evidence: %d excerpts of %d papers.", evidence.cast("int"), papers.cast("int")),
    )


def hypothesize(candidates: DataFrame, records: DataFrame) -> DataFrame:
    """A hypothesis for each candidate (id, name, problem, target, evidence), with up to five known failures of the method."""
    found = limitations(records, candidates.select(F.col("name").alias("method")))
    worst = selection.quota(found, ["method"], ["record_id"], FINDINGS)
    fails = worst.groupBy("method").agg(F.array_sort(F.collect_list(F.concat_ws(": ", "category", "description"))).alias("failures"))
    rows = candidates.join(fails, F.col("name") == F.col("method"), "left").drop("method")
    words = lambda fmt, *cols: F.format_string(fmt, *map(F.col, cols))
    return rows.withColumns({
        "failures": F.coalesce("failures", F.array().cast("array<string>")),
        "hypothesis_id": F.concat(F.lit("hyp_"), F.substring(F.sha2(F.concat(F.col("id").cast("string"), "name", "problem"), 256), 1, 12)),
        "title": words("%s for %s", "name", "problem"),
        "mechanism": words("Carry the mechanism of %s over to %s; parameter and loss stay explicit.", "name", "problem"),
        "assumptions": F.array(F.lit("Local data converge as at the source."), F.lit("Metrics of both fields agree in direction.")),
        "baselines": F.array(words("Usual approach of %s", "target"), words("The same without %s", "name"), F.lit("Simple heuristic")),
        "independent": F.array(words("%s or baseline", "name"), F.lit("Skew of the data"), F.lit("Compute budget")),
        "dependent": F.array(words("Quality on %s", "problem"), F.lit("Overhead"), F.lit("Robustness")),
        "falsification": words("Reject if %s does not gain 5%% on the main baseline (p < 0.05, five seeds).", "name"),
    })


def review(rows: DataFrame, problem: Column, evidence: Column, baselines: Column, method: Column, target: Column, assumptions: Column, mechanism: Column, failures: Column, independent: Column, dependent: Column, falsification: Column) -> DataFrame:
    """Rows with ten scores, weaknesses (worst first), overall (mean, 2 digits) and verdict."""
    rules = [
        ("problem_specificity", F.length(F.trim(problem)) > 15, 8.5, 4.0, "MAJOR"),
        ("evidence_grounding", evidence >= 2, F.when(evidence >= 4, 9.0).otherwise(7.0), 3.5, "CRITICAL"),
        ("overlooked_prior_work", F.exists(baselines, lambda b: F.lower(b) == "standard"), 7.5, 6.0, "MINOR"),
        ("domain_comparability", F.lower(method) != F.lower(target), 8.0, 4.0, "MAJOR"),
        ("realistic_assumptions", F.size(assumptions) >= 2, 8.0, 5.0, "MAJOR"),
        ("superficial_analogy", any_in(mechanism, MECHANICAL), 8.5, 4.5, "MAJOR"),
        ("negative_knowledge_collision", F.size(failures) > 0, 8.0, 4.0, "CRITICAL"),
        ("measurability", (F.size(independent) > 0) & (F.size(dependent) > 0), 9.0, 5.0, "MAJOR"),
        ("simpler_baselines", F.lit(True), 7.5, 7.5, "MINOR"),
        ("falsification_rigor", F.contains(falsification, F.lit("%")) & F.contains(falsification, F.lit("p <")), 9.5, 6.0, "MINOR"),
    ]
    scores = F.map_from_arrays(F.array(*[F.lit(n) for n, *_ in rules]), F.array(*[F.when(ok, good).otherwise(bad) for _, ok, good, bad, _ in rules]))
    weak = F.array_compact(F.array(*[F.when(~ok, F.struct(F.lit(SEVERITIES.index(s)).alias("level"), F.lit(i).alias("place"), F.lit(n).alias("dimension"), F.lit(s).alias("severity"))) for i, (n, ok, _, _, s) in enumerate(rules)]))
    of = lambda s: F.size(F.filter("weaknesses", lambda w: w["severity"] == s))
    mean = F.aggregate(F.map_values("scores"), F.lit(0.0), lambda a, x: a + x) / F.size("scores")
    verdict = F.when(of("CRITICAL") > 0, "REJECTED").when(of("MAJOR") >= 2, "MAJOR_REVISION").when(evidence < 3, "NEEDS_MORE_EVIDENCE").otherwise("PROMISING_BUT_UNVERIFIED")
    return rows.withColumns({"scores": scores, "weaknesses": F.array_sort(weak)}).withColumns({"overall": F.round(mean, 2), "verdict": verdict})


def experiment(hypotheses: DataFrame) -> DataFrame:
    """A plan for each hypothesis: arms, seeds, a stopping rule, steps."""
    steps = ["Fix data and splits", "Run every baseline", "Run the transfer", "Ablate the mechanism", "Test significance"]
    return hypotheses.withColumn("plan", F.struct(
        F.concat(F.lit("exp_"), F.substring(F.sha2("hypothesis_id", 256), 1, 12)).alias("plan_id"), F.concat("baselines", F.array("name")).alias("arms"),
        F.lit(5).alias("seeds"), F.col("falsification").alias("stop"), F.array(*map(F.lit, steps)).alias("steps"),
    ))


def workflow(methods: DataFrame, problem: str, docs: DataFrame, statements: DataFrame, titles: DataFrame, records: DataFrame, limit: int = 5) -> DataFrame:
    """Discovery, gap check, hypothesis, review, plan and final status of each candidate; no rows without a candidate."""
    found = transfers(methods, problem, docs, limit=limit)
    gap = methods.sparkSession.createDataFrame([(0, problem)], "gid int, text string")
    lexical = retrieval.top_k(retrieval.bm25(docs.select("doc_id", "text"), gap.select(F.col("gid").alias("qid"), "text")), 10)
    dossiers, _ = verify_gaps(gap, lexical.select(F.col("qid").alias("gid"), "id", "score"), docs.select(F.col("doc_id").alias("id"), "text", "paper"), statements, titles)
    rows = experiment(hypothesize(found, records))
    c = F.col
    rows = review(rows, c("problem"), c("evidence"), c("baselines"), c("name"), c("problem"), c("assumptions"), c("mechanism"), c("failures"), c("independent"), c("dependent"), c("falsification"))
    rows = rows.crossJoin(F.broadcast(dossiers.select(F.col("status").alias("gap_status"))))  # one row
    final = F.when(c("gap_status") == "EVIDENCE_AGAINST_GAP", "STOPPED_BY_PRIOR_WORK").when(c("verdict") == "REJECTED", "REJECTED_IN_REVIEW").otherwise("READY_FOR_EXPERT")
    return rows.withColumn("final_status", final)
