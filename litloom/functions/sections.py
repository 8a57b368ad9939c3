"""Section headers and protected full stops."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Beginnings and words that no header has; canonical headings; abbreviations whose full stop ends no sentence.
CAPTIONS = ["table", "fig", "figure", "tab.", "scheme", "chart", "box"]
LINKS = ["http", "doi:", "https:"]
PEOPLE = ["university", "department", "college", "email:", "@", "[at]", "author", "correspondence", "dr.", "prof.", "ph.d."]
BADGES = ["paper id:", "issn", "isbn", "volume", "issue", "journal of", "proceedings of", "conference on", "open access", "research article", "review article", "original article", "editorial"]
HEADINGS = ["abstract", "introduction", "background", "related work", "methods", "methodology", "experiments", "results", "discussion", "conclusion", "conclusions", "limitations", "references", "acknowledgments", "appendix"]
ABBREVIATIONS = ["al", "ca", "cf", "vs", "approx", "fig", "figs", "tab", "tabs", "eq", "eqs", "sec", "secs", "ref", "refs", "vol", "vols", "no", "nos", "pp", "ed", "eds", "univ", "dept", "proc", "conf", "trans", "assoc", "soc", "dr", "prof", "mr", "mrs", "ms", "jr", "sr", "st", "inc", "ltd", "corp", "co", "min", "max", "avg", "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec"]
MARK = "․"  # one dot leader: no text of the sources has it


def header_level(block: Column, large: Column, bold: Column) -> Column:
    """1 to 3 for a block that opens a section, null for any other. The first rule that speaks decides."""
    lines = F.filter(F.transform(F.split(block, "\n"), F.trim), lambda x: F.length(x) > 0)
    line = F.try_element_at(lines, F.lit(1))
    low = F.lower(line)
    begins = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.startswith(low, w))
    holds = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    none = F.lit(None).cast("int")
    plain = (F.length(line) <= 85) & ~line.rlike(r"[.,;]$")
    bare = F.regexp_replace(F.regexp_replace(low, r"^[ivx]+\.\s+", ""), r":$", "")
    return (
        F.when(line.isNull() | ((F.length(line) > 120) & ~low.startswith("chapter")), none).when(low.rlike(r"^(\d+|[ivxlcdm]+)$"), none)
        .when(begins(CAPTIONS) | begins(LINKS), none).when(holds(PEOPLE) | holds(BADGES), none)
        .when(low.rlike(r"^chapter\s+(\d+|[ivxlcdm]+)\b"), 1).when(line.rlike(r"^\d+\.\d+\.\d+\.?\s+\S"), 3).when(line.rlike(r"^\d+\.\d+\.?\s+[A-Z]"), 2)
        .when(line.rlike(r"^\d+\.\s+[A-Za-z\s()]+:\s+[A-Z]"), none).when(line.rlike(r"^\d+\.?\s+[A-Z]") & plain, 1)
        .when(bare.isin(*HEADINGS), 1).when((large | bold) & plain & (F.size(lines) == 1) & line.rlike("^[A-Z]"), F.when(large, 1).otherwise(2))
    )


def protect(x: Column) -> Column:
    """full stops in decimals, after abbreviations and after initials become a mark that ends no sentence."""
    out = F.regexp_replace(x, r"(?<=\d)\.(?=\d)", MARK)
    out = F.regexp_replace(out, r"(?i)(?<=\b(?:e|i))\.(?=[ge]\.)", MARK)
    out = F.regexp_replace(out, rf"(?i)(?<=\b(?:{'|'.join(ABBREVIATIONS)}|e{MARK}g|i{MARK}e))\.", MARK)
    return F.regexp_replace(out, r"(?<=\b[A-Z])\.(?=\s)", MARK)


def unprotect(x: Column) -> Column:
    return F.replace(x, F.lit(MARK), F.lit("."))
