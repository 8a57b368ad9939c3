"""Secret scans with an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its content. The ledger holds one row for each blob and
rule version that has been scanned; a run scans only the pairs it doesn't hold, one copy of each blob, appends them,
and joins the findings back to all paths. Unchanged content is never scanned twice, whatever its paths.

Only (blob, path) pairs are aggregated; the contents of the chosen copies are shuffled once, by a semi-join.

Defined results: null content counts as empty; paths may be null and may repeat, with the same or other contents; very
long contents are scanned whole, in time that grows with their length; other columns are not looked at; an empty table
gives no rows and adds none to the ledger.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, scratch

#: Rules in the order that breaks ties of equal starts: name, pattern, group whose length counts, least length.
RULES = [
    ("assign", r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("forge", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 0),
]
LEDGER = "blob binary, found array<struct<kind:string,start:int,end:int>>, rules string"
BASE = ("assign", "access", "hex")


def rule_version(rules=RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


#: A token's header: a whole run of its characters before a dot and the token's two other parts.
HEADER = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++\.(?=eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-])")
REST = re.compile(r"eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++")


def web_tokens(text: str):
    """Matches of the jwt rule run by run: its own pattern would read a long run again from each of its starts."""
    past = 0
    if ".eyJ" in text:
        for m in HEADER.finditer(text):
            start = text.find("eyJ", m.start(), m.end() - 1)
            if m.start() >= past and 0 <= start < m.end() - 4:
                past = REST.match(text, m.end()).end()
                yield start, past


def finder(name: str, pattern: str, group: int, least: int):
    """text -> (start, end) of the rule's matches, in time that grows with the text."""
    if name == "jwt":
        return web_tokens
    if name == "hex":  # a run of one class that is long enough: the same matches, fewer candidates
        pattern, group = f"[0-9a-f]{{{least},}}", 0
    compiled = re.compile(pattern)
    return lambda text: ((m.start(), m.end()) for m in compiled.finditer(text) if m.end(group) - m.start(group) >= least)


def spans(text: str, finders) -> list[tuple[int, int, int]]:
    """(start, rule, end) by start, then rule."""
    return sorted((a, k, b) for k, find in enumerate(finders) for a, b in find(text))


def scan(blobs: DataFrame, rules=RULES) -> DataFrame:
    """blob, found array<struct<kind, start, end>> of a table of blob, content."""

    def make():
        names, own = [r[0] for r in rules], [finder(*r) for r in rules]

        def step(keys, contents):
            return keys, [[{"kind": names[k], "start": a, "end": b} for a, k, b in spans(c or "", own)] for c in contents]

        return step

    return map_columns(blobs.select("blob", "content"), "blob binary, found array<struct<kind:string,start:int,end:int>>", make)


class Ledger:
    """Parquet rows (blob, rules, found) in the shared folder, appended by each run."""

    def __init__(self, spark, path: str | None = None):
        self.spark, self.path = spark, path or scratch(spark, "ledger")

    def rows(self) -> DataFrame:
        """All rows; none if nothing has been scanned yet."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        return self.spark.read.schema(LEDGER).parquet(self.path) if system.exists(path) else self.spark.createDataFrame([], LEDGER)


def findings(versions: DataFrame, ledger: Ledger, rules=RULES, path: str = "path", content: str = "content") -> DataFrame:
    """path, blob, found for each row of versions. Scans and appends what the ledger lacks."""
    version = rule_version(rules)
    rows = versions.select(F.col(path).alias("path"), F.unhex(F.sha2(F.coalesce(F.col(content), F.lit("")), 256)).alias("blob"), F.col(content).alias("content"))
    places = rows.select("path", "blob")
    todo = places.groupBy("blob").agg(F.min("path").alias("copy"))
    known = ledger.rows().where(F.col("rules") == version).select("blob")
    todo = todo.join(known, "blob", "left_anti")
    todo = todo.select(F.col("blob").alias("of"), "copy")
    unseen = rows.join(todo, (F.col("blob") == F.col("of")) & F.col("path").eqNullSafe(F.col("copy")), "left_semi")
    scanned = scan(unseen, rules).groupBy("blob").agg(F.first("found").alias("found"))  # a path may repeat a blob
    scanned.withColumn("rules", F.lit(version)).write.mode("append").parquet(ledger.path)
    hits = ledger.rows().where((F.col("rules") == version) & (F.size("found") > 0)).select("blob", "found")
    return places.join(hits, "blob", "left").select(F.col("path").alias(path), "blob", F.coalesce("found", F.array()).alias("found"))
