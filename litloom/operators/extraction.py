"""Rule-based extraction with offsets, grounding validation and greedy matching."""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, MapType, StringType

from ..functions.text import ACRONYMS, BULLETS
from ..session import ship
from .documents import per_text, sentences

# Cues, kinds, confidences and shortest sentences of statements, frames of entities, by version; each version's
# kinds in order of priority. The later version has the cues of the first and more.
CUES = {
    "LIMITATION": r"a\s+limitation\s+of|limitations?\s+include|suffers?\s+from|is\s+constrained\s+by|remains?\s+a\s+(?:major\s+)?(?:challenge|concern)|ongoing\s+concerns\s+related\s+to|does\s+not\s+account\s+for|restricted\s+by|susceptible\s+to\s+adversarial",
    "FUTURE_DIRECTION": r"future\s+(?:research|work|directions?|studies)|outlines\s+emerging\s+directions\s+for|emerging\s+directions\s+for\s+building|remains\s+an\s+open\s+question|we\s+plan\s+to\s+(?:investigate|extend|explore)",
    "FAILURE_MODE": r"fails?\s+to\s+(?:detect|generalize|converge)|struggle\s+to\s+detect|underperforms?\s+(?:when|under|on)|leads?\s+to\s+high\s+false\s+(?:positives|alarms)|performance\s+degrades?\s+(?:sharply|under|when)",
    "RESULT": r"achieved\s+(?:an?\s+)?(?:accuracy|precision|f1|score)|results?\s+(?:show|demonstrate|indicate|reveal)\s+that|outperformed\s+(?:traditional|conventional|baseline|state-of-the-art)|exhibited\s+(?:superior|improved|high)\s+performance|demonstrated\s+a\s+(?:significant\s+)?(?:reduction|improvement|increase)|attained\s+an?\s+accuracy\s+of|revealed\s+that\s+deep\s+learning\s+models",
    "CLAIM": r"this\s+paper\s+(?:examines|proposes|presents|investigates|evaluates|reviews)|this\s+study\s+(?:provides|analyzes|explores|demonstrates)|we\s+(?:propose|introduce|present|develop|argue\s+that|hypothesize\s+that)|the\s+goal\s+of\s+this\s+(?:study|paper|work)\s+is",
}
MORE_CUES = {
    "LIMITATION": r"preeminent\s+challenges|significant\s+challenges|major\s+obstacles|obstacles\s+still\s+exist|challenges\s+with\s+(?:data\s+quality|scalability|integration|privacy|security)|problems\s+that\s+have\s+been\s+culminating|difficult\s+undertaking|ethical\s+concerns\s+about|concerns\s+regarding\s+patient\s+privacy",
    "RESULT": r"(?:initial\s+testing|preliminary\s+results?|experimental\s+results?)\s+(?:of\s+.*?\s+)?(?:demonstrates?|shows?|indicates?)\s+(?:promising|strong|superior|competitive|significant)\s+results?|findings?\s+(?:indicate|demonstrate|show|reveal)\s+that|yielded\s+(?:an?\s+)?(?:accuracy|precision|recall|f1|improvement|reduction)|to\s+evaluate\s+the\s+performance\s+of\s+.*?\s+(?:metrics?\s+(?:can\s+be|were|are)\s+employed)",
    "CLAIM": r"this\s+study\s+employs|we\s+examine|(?:the\s+)?contributions\s+of\s+this\s+(?:study|paper|research\s+work)|the\s+objectives\s+of\s+this\s+work\s+are",
}
DECLARED = r"(?i)\b(?:(?:the\s+)?contributions\s+of\s+this\s+(?:study|paper|research\s+work|work)|(?:our\s+)?main\s+contributions\s+are|contributions:)\b"
KINDS = {
    "0.4.0": {"LIMITATION": 0.94, "FUTURE_DIRECTION": 0.95, "FAILURE_MODE": 0.92, "RESULT": 0.92, "CLAIM": 0.93},
    "0.4.1": {"LIMITATION": 0.94, "FAILURE_MODE": 0.92, "RESULT": 0.93, "FUTURE_DIRECTION": 0.95, "CLAIM": 0.93},
}
DECLARED_SURE = 0.96
SHORTEST, STOPS = {"0.4.0": 20, "0.4.1": 15}, {"0.4.0": ".?!", "0.4.1": ".?!:"}
FRAMES = {
    "0.4.0": [
        ("METHOD", 0.88, r"\b(?:we\s+(?:propose|develop|introduce|design)|our\s+proposed)\s+(?:a\s+|an\s+|the\s+)?([A-Za-z0-9\-\s]{3,35}?(?:model|framework|architecture|algorithm|system|technique))\b"),
        ("PROBLEM", 0.85, r"\b(?:problem\s+of|challenge\s+of|vulnerability\s+to|threat\s+of)\s+([a-z0-9\-\s]{4,40})\b"),
        ("ASSUMPTION", 0.85, r"\b(?:assuming\s+that|under\s+the\s+assumption\s+that|we\s+assume\s+that)\s+([A-Za-z0-9\-\s,'\"]{8,80}?(?:[.;]|$))"),
    ],
    "0.4.1": [
        ("METHOD", 0.88, r"\b(?:we\s+(?:propose|develop|introduce|design)|our\s+proposed)\s+(?:a\s+|an\s+|the\s+)?([A-Za-z0-9\-\s]{3,35}?(?:model|framework|architecture|algorithm|system|technique|methodology))\b"),
        ("PROBLEM", 0.86, r"\b(?:problem\s+of|challenge\s+of|vulnerability\s+to|threat\s+of|challenges?\s+with)\s+([a-z0-9\-\s]{4,35}?)(?:[.,;]|\s+and|\s+in)\b"),
        ("DATASET", 0.88, r"\btrained\s+on\s+(?:a\s+|an\s+)?(?:diverse|large|public|benchmark|clinical|curated)?\s*dataset\s+of\s+([A-Za-z0-9\-\s]{4,45}?)(?:,\s*including|[,.]|\s+to|\s+for|\s*$)"),
        ("ASSUMPTION", 0.85, r"\b(?:assuming\s+that|under\s+the\s+assumption\s+that|we\s+assume\s+that)\s+([A-Za-z0-9\-\s,'\"]{8,80}?(?:[.;]|$))"),
    ],
}
TERM_SURE = {"METHOD": 0.95, "PROBLEM": 0.92, "BOTTLENECK": 0.90, "METRIC": 0.95, "DATASET": 0.98, "TASK": 0.92, "DOMAIN": 0.92}
TASK_SURE_FIRST = 0.90  # of TASK in version 0.4.0
LOOSE_ACCURACY = re.compile(r"\b(?:reduced\s+to|beyond|fixation\s+on|cannot\s+be\s+reduced\s+to)\s+accuracy\b", re.I)
# Of grounding: characters that evidence has at least, hedges that no RESULT has, confidence below which a person looks.
MIN_EVIDENCE, DOUBTS, SURE = 3, ["may", "could", "might", "potentially", "hypothesize", "preliminary", "suggests"], 0.5
TABLE_ROW = re.compile(r"(?:^|\s)(\d{1,2})\s+")


def cue(kind: str, version: str) -> str:
    """The pattern of a kind of statement, case ignored."""
    return rf"(?i)\b(?:{CUES[kind]}{'|' + MORE_CUES[kind] if version != '0.4.0' and kind in MORE_CUES else ''})\b"


def statement(x: Column, version: str = "0.4.0", declared: Column | None = None) -> Column:
    """struct<kind, confidence> of the first kind whose cue the sentence holds; short sentences are none. Later versions
    take what lists contributions as a CLAIM before all; declared: whether the chunk around the sentence does."""
    row = lambda kind, sure: F.struct(F.lit(kind).alias("kind"), F.lit(sure).alias("confidence"))
    bare = F.regexp_replace(x, r"^\s+|\s+$", "")
    ladder = [(bare.rlike(cue(kind, version)), row(kind, sure)) for kind, sure in KINDS[version].items()]
    if version != "0.4.0":
        ladder.insert(0, (bare.rlike(DECLARED) | F.coalesce(declared if declared is not None else F.lit(False), F.lit(False)), row("CLAIM", DECLARED_SURE)))
    out = F.lit(None).cast("struct<kind:string,confidence:double>")
    for held, found in reversed(ladder):
        out = F.when(held, found).otherwise(out)
    return F.when(F.length(bare) >= SHORTEST[version], out)


def statement_kind(x: Column, version: str = "0.4.0", declared: Column | None = None) -> Column:
    return statement(x, version, declared)["kind"]


def cue_sentences(text: str | None, version: str = "0.4.0") -> list[tuple[int, int]]:
    """[start, end) of each sentence: one ends at a stop (later versions: or a colon) that white space and a capital, a
    digit, a quote or a bracket follow. The last one keeps white space at its end."""
    text, out, at = text or "", [], 0
    ends = [(m.end(1), m.end()) for m in re.finditer(rf"([{STOPS[version]}])\s+(?=[A-Z0-9\"'(\[{{\b])", text)]
    for end, then in [*ends, (len(text), len(text))]:
        piece = text[at:end]
        if piece.strip():
            out.append((at + len(piece) - len(piece.lstrip()), end))
        at = then
    return out


def concept(surface: str) -> str:
    """F13 of one name, for Python workers."""
    bare = " ".join(re.sub(BULLETS, "", surface.strip()).split())
    bare = bare.lstrip(" .,;:!?\"'`([{").rstrip(" .,;:!?\"'`)]}")
    return bare.upper() if bare.upper() in ACRONYMS else bare


def framed(text: str, version: str) -> list[tuple[str, int, int, float]]:
    """Category, start, end, confidence of what stands in the frames; an assumption goes without its final stop."""
    out = []
    for category, sure, frame in FRAMES[version]:
        for m in re.finditer(frame, text, re.I):
            said = m.group(1).strip()
            if category == "ASSUMPTION":
                said = said.rstrip(".;")
            end = m.start(1) + len(said) if category == "ASSUMPTION" else m.end(1)
            if text[m.start(1) : end] == said:
                out.append((category, m.start(1), end, sure))
    return out


def scientific_spans(text: str | None, lexicon: dict[str, list[str]], version: str) -> list[dict]:
    """Spans in their order of precedence. 0.4.0: terms, then frames, each span once. 0.4.1: frames, then terms, the
    longer first; none overlaps one before it or repeats its category and name, and accuracy in a loose sense is none."""
    text, first, terms = text or "", version == "0.4.0", []
    folded = text.casefold()
    for category, own in lexicon.items():
        sure = TASK_SURE_FIRST if first and category == "TASK" else TERM_SURE.get(category, 1.0)
        for term in sorted(set(own), key=lambda t: (-len(t), t)):
            if term.casefold() in folded:
                terms += [(category, *m.span(), sure) for m in re.finditer(rf"\b{re.escape(term)}\b", text, re.I)]
    taken, names, out = [], set(), []
    for category, a, b, sure in terms + framed(text, version) if first else framed(text, version) + terms:
        name = concept(text[a:b])
        if len(name) < 2 or (first and (a, b) in names):
            continue
        if not first:
            loose = category == "METRIC" and text[a:b].lower() == "accuracy" and LOOSE_ACCURACY.search(text[max(0, a - 30) : b + 30])
            if loose or (category, name.lower()) in names or any(a < y and x < b for x, y in taken):
                continue
        names.add((a, b) if first else (category, name.lower()))
        taken.append((a, b))
        out.append({"category": category, "name": name, "start": a, "end": b, "confidence": sure})
    return out


def lexicon_spans(text: str | None, lexicon: list[tuple[str, re.Pattern]]) -> list[dict]:
    """First-wins spans: categories in order, longer terms first, none overlapping, one a (category, name)."""
    taken, names, out = [], set(), []
    for category, pattern in lexicon:
        for m in pattern.finditer(text or ""):
            a, b = m.span()
            if (category, m.group().lower()) in names or any(a < y and x < b for x, y in taken):
                continue
            names.add((category, m.group().lower()))
            taken.append((a, b))
            out.append({"category": category, "name": m.group().lower(), "start": a, "end": b})
    return sorted(out, key=lambda s: s["start"])


def entities(df: DataFrame, lexicon: dict[str, list[str]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, category, name, start, end of lexicon terms at word boundaries, case ignored."""
    own = [(cat, re.compile(r"\b(?:" + "|".join(map(re.escape, sorted(terms, key=lambda t: (-len(t), t)))) + r")\b", re.I)) for cat, terms in lexicon.items()]
    kind = df.schema[key].dataType.simpleString()
    span = pa.struct([("category", pa.string()), ("name", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches):
        for batch in batches:
            found = [lexicon_spans(t, own) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(span))], names=[key, "spans"])

    ship(df.sparkSession)
    rows = df.select(key, text).mapInArrow(run, f"`{key}` {kind}, spans array<struct<category:string,name:string,start:int,end:int>>")
    return rows.select(key, F.explode("spans").alias("s")).select(key, "s.*")


def scientific_entities(df: DataFrame, lexicon: dict[str, list[str]], version: str = "0.4.1", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ordinal, category, name (F13), start, end, confidence of the entities of each text."""
    item = "struct<category:string,name:string,start:int,end:int,confidence:double>"
    rows = per_text(df, key, text, lambda t: scientific_spans(t, lexicon, version), item)
    return rows.select(key, "ordinal", "item.*")


def statements(df: DataFrame, version: str = "0.4.0", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, start, end, kind, confidence of the sentences with a cue."""
    spans = per_text(df, key, text, lambda t: [{"start": a, "end": b, "said": t[a:b], "declared": bool(re.search(DECLARED, t))} for a, b in cue_sentences(t, version)], "struct<start:int,end:int,said:string,declared:boolean>")
    rows = spans.select(key, "item.start", "item.end", statement(F.col("item.said"), version, F.col("item.declared")).alias("_s"))
    return rows.where("_s is not null").select(key, "start", "end", "_s.kind", "_s.confidence")


def contained(spans: DataFrame, inside: DataFrame, key: str = "doc_id") -> DataFrame:
    """Interval join within a key: rows of inside whose span lies in a span. The range is a residual of the equi-join."""
    a = spans.select(key, F.col("start").alias("from"), F.col("end").alias("to"), *[c for c in spans.columns if c not in (key, "start", "end")])
    return a.join(inside, key).where((F.col("start") >= F.col("from")) & (F.col("end") <= F.col("to")))


def grounding(text: Column, surface: Column, start: Column, end: Column, confidence: Column) -> Column:
    """Verdict on an extracted span: where it stands is checked against the text, else realigned."""
    at = F.expr("0") if text is None else F.position(surface, text)
    return (
        F.when(text.isNull(), "CHUNK_MISSING").when(F.length(F.trim(surface)) < 2, "TOO_SHORT")
        .when((start < 0) | (end > F.length(text)) | (F.substring(text, start + 1, end - start) != surface), F.when(at > 0, "REALIGNED").otherwise("NOT_GROUNDED"))
        .when(confidence < 0.5, "NEEDS_REVIEW").otherwise("VALID")
    )


def found_in(text: Column, evidence: Column) -> Column:
    """Whether the text holds the evidence, case ignored where it must be."""
    return F.contains(text, evidence) | F.contains(F.lower(text), F.lower(evidence))


def statement_grounding(text: Column, paper: Column, evidence: Column, own_paper: Column, start: Column, end: Column, confidence: Column, category: Column) -> Column:
    """P10: verdict on a statement's evidence in a chunk (text, paper; null where there is none). A RESULT that hedges is for review."""
    said = F.trim(evidence)
    length = F.coalesce(F.length(said), F.lit(0))
    in_place = (start >= 0) & (end <= F.length(text)) & (start < end) & (F.substring(text, start + 1, end - start) == said)
    doubt = (category == "RESULT") & F.concat(F.lit(" "), F.lower(said), F.lit(" ")).rlike(" (" + "|".join(DOUBTS) + ") ")
    return (
        F.when(text.isNull(), "CHUNK_MISSING").when(~own_paper.eqNullSafe(paper), "PAPER_MISMATCH").when(length < MIN_EVIDENCE, "TOO_SHORT")
        .when(~F.coalesce(in_place, F.lit(False)) & ~found_in(text, said), "NOT_GROUNDED")
        .when(F.coalesce(doubt, F.lit(False)) | F.coalesce(confidence < SURE, F.lit(False)), "NEEDS_REVIEW").otherwise("VALID")
    )


def relation_grounding(relations: DataFrame, known: DataFrame, chunks: DataFrame) -> DataFrame:
    """Relations (id, source, target, chunk, evidence, inferred) with verdict and audit (whether the system inferred
    them, of those grounded). known: id of records; chunks: chunk, text. Both ends must be known before evidence is read."""
    ids = known.select("id").distinct()
    rows = relations
    for end in ("source", "target"):
        rows = rows.join(ids.select(F.col("id").alias(end), F.lit(True).alias(f"_{end}")), end, "left")
    rows = rows.join(chunks.select("chunk", F.col("text").alias("_text")), "chunk", "left")
    said = F.trim("evidence")
    verdict = (
        F.when(F.col("_source").isNull(), "SOURCE_UNKNOWN").when(F.col("_target").isNull(), "TARGET_UNKNOWN").when(F.col("_text").isNull(), "CHUNK_MISSING")
        .when(F.coalesce(F.length(said), F.lit(0)) < MIN_EVIDENCE, "TOO_SHORT").when(~found_in(F.col("_text"), said), "NOT_GROUNDED").otherwise("VALID")
    )
    rows = rows.withColumn("verdict", verdict).withColumn("audit", (F.col("verdict") == "VALID") & F.coalesce("inferred", F.lit(False)))
    return rows.select(*relations.columns, "verdict", "audit")


def table_rows(text: str | None) -> dict[int, str]:
    """what follows each row number of a table in running text; a number's last row counts; one number is no table."""
    marks = list(TABLE_ROW.finditer(text or ""))
    if len(marks) < 2:
        return {}
    ends = [m.start() for m in marks[1:]] + [len(text)]
    return {int(m.group(1)): text[m.end() : end].strip() for m, end in zip(marks, ends)}


def evidence_support(source: str, target: str, evidence: str | None) -> str:
    """With a table of three rows or more that hold both terms, whether one row holds both (the first with a term
    counts); else UNSUPPORTED where a term is missing, and NOT_ASSESSED."""
    if not evidence or not evidence.strip():
        return "UNSUPPORTED"
    rows = table_rows(evidence)
    if len(rows) >= 3:
        a, b = (next((n for n, row in rows.items() if term.lower().strip() in row.lower()), None) for term in (source, target))
        if a is not None and b is not None:
            return "SUPPORTED" if a == b else "UNSUPPORTED"
    return "NOT_ASSESSED" if source.lower() in evidence.lower() and target.lower() in evidence.lower() else "UNSUPPORTED"


@F.pandas_udf(MapType(IntegerType(), StringType()))
def table_map(text: pd.Series) -> pd.Series:
    """F30 as a column; as with every Python function here, session.ship first."""
    return text.map(table_rows)


@F.pandas_udf(StringType())
def support(source: pd.Series, target: pd.Series, evidence: pd.Series) -> pd.Series:
    """P12 as a column."""
    return pd.Series([evidence_support(a or "", b or "", e) for a, b, e in zip(source, target, evidence)])


def relaxed_matches(predicted: list[str], actual: list[str], least: float = 0.5) -> list[tuple[int, int]]:
    """Greedy one-to-one pairs: one holds the other, or their words' Jaccard similarity is least or more."""
    used, out = set(), []
    for i, p in enumerate(predicted):
        for j, a in enumerate(actual):
            x, y = set(p.lower().split()), set(a.lower().split())
            if j not in used and (p.lower() in a.lower() or a.lower() in p.lower() or len(x & y) >= least * len(x | y)):
                used.add(j)
                out.append((i, j))
                break
    return out


__all__ = ["concept", "contained", "cue_sentences", "entities", "evidence_support", "grounding", "lexicon_spans", "relation_grounding", "relaxed_matches", "scientific_entities", "scientific_spans", "sentences", "statement", "statement_grounding", "statement_kind", "statements", "support", "table_map", "table_rows"]
