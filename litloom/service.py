"""What clients of the reference's routes and command line ask for, as DataFrames over a knowledge base's tables."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import graphs, knowledge, retrieval

TABLES = ["papers", "entities", "entity_mentions", "statements", "relationships", "quarantined_records", "alias_mappings"]


class Service:
    """Routes over the tables that there are (names as in TABLES, chunks beside them); a table's absence is a KeyError."""

    def __init__(self, tables: dict[str, DataFrame], cut=lambda df: df):
        self.tables, self.cut = tables, cut

    @classmethod
    def of_folder(cls, spark: SparkSession, folder: str, names=(*TABLES, "chunks"), cut=lambda df: df) -> Service:
        found = {}
        for name in names:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
            if path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
                found[name] = spark.read.parquet(f"{folder}/{name}")
        return cls(found, cut)

    def papers(self, search: str | None = None, limit: int = 50) -> DataFrame:
        rows = self.tables["papers"]
        return (rows.where(F.contains(F.lower("title"), F.lit(search.lower()))) if search else rows).orderBy("paper_id").limit(limit)

    def paper(self, paper_id: str) -> dict[str, DataFrame]:
        of = lambda name: self.tables[name].where(F.col("paper_id") == paper_id)
        return {name: of(name) for name in ("papers", "statements", "relationships") if name in self.tables}

    def entities(self, category: str | None = None, limit: int = 50) -> DataFrame:
        return knowledge.listing(knowledge.all_of(self.tables["entities"], category=category.upper() if category else None), "mentions_count", "canonical_name", limit)

    def statements(self, category: str | None = None, limit: int = 50) -> DataFrame:
        return knowledge.all_of(self.tables["statements"], category=category.upper() if category else None).orderBy("statement_id").limit(limit)

    def chunk(self, chunk_id: str) -> dict[str, DataFrame]:
        return knowledge.records_of_chunk(chunk_id, **{n: self.tables[n] for n in ("entity_mentions", "statements", "relationships") if n in self.tables})

    def quarantine(self, limit: int = 100) -> DataFrame:
        return knowledge.quarantine_log(self.tables["quarantined_records"], limit)

    def aliases(self, limit: int = 100) -> DataFrame:
        return knowledge.alias_listing(self.tables["alias_mappings"], limit)

    def lexical(self, query: str, k: int = 10) -> DataFrame:
        """Ranked chunks (qid, id, score, rank) by BM25."""
        spark = self.tables["chunks"].sparkSession
        asked = spark.createDataFrame([("q", query)], "qid string, text string")
        return retrieval.top_k(retrieval.bm25(self.tables["chunks"], asked, id="chunk_id"), k)

    def dense(self, vector: list[float], k: int = 10) -> DataFrame:
        """Ranked chunks by cosine with their column vector."""
        spark = self.tables["chunks"].sparkSession
        asked = spark.createDataFrame([("q", vector)], "qid string, vector array<double>")
        return retrieval.top_k(retrieval.dense(self.tables["chunks"].select(F.col("chunk_id").alias("id"), "vector"), asked), k)

    def hybrid(self, query: str, vector: list[float], k: int = 10, deep: int = 50) -> DataFrame:
        return retrieval.fuse(self.lexical(query, deep), self.dense(vector, deep), k=k)

    def compare(self, query: str, vector: list[float], k: int = 10) -> DataFrame:
        """Overlap of the lexical and the dense list."""
        return retrieval.overlap(self.lexical(query, k), self.dense(vector, k))

    def graph(self, include_unsupported: bool = True, max_papers: int | None = None) -> dict[str, DataFrame]:
        return graphs.build(self.tables["papers"], self.tables["entities"], self.tables["statements"], self.tables["relationships"], include_unsupported, max_papers)

    def neighborhood(self, node_id: str, depth: int = 1) -> DataFrame:
        edges = self.graph()["edges"]
        return graphs.neighbourhood(edges, edges.sparkSession.createDataFrame([(node_id,)], "id string"), depth, self.cut)

    def paths(self, source: str, target: str, depth: int = 3, most: int = 10) -> DataFrame:
        return graphs.paths(self.graph()["edges"], F.lit(source), F.lit(target), depth, most)

    def export(self, trusted_only: bool = False) -> tuple[DataFrame, DataFrame]:
        built = self.graph()
        return graphs.visual(built["nodes"], built["edges"], trusted_only)

    def health(self) -> dict[str, int]:
        """Rows of each table."""
        return {name: rows.count() for name, rows in self.tables.items()}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    """Command line over a folder of Parquet tables: one line of JSON for each row; returns the lines."""
    ask = argparse.ArgumentParser(description="Ask a knowledge base in a folder of Parquet tables.")
    ask.add_argument("folder")
    for flag in ("paper", "chunk", "search", "lexical"):
        ask.add_argument(f"--{flag}")
    for flag in ("entities", "statements"):  # of a category, or all
        ask.add_argument(f"--{flag}", nargs="?", const="")
    for flag in ("quarantine", "aliases", "health"):
        ask.add_argument(f"--{flag}", action="store_true")
    ask.add_argument("--limit", type=int, default=20)
    a = ask.parse_args(argv)
    if spark is None:
        from .session import local

        spark = local()
    own = Service.of_folder(spark, a.folder)
    if a.paper or a.chunk:
        found = own.paper(a.paper) if a.paper else own.chunk(a.chunk)
    elif a.health:
        found = {"health": spark.createDataFrame(sorted(own.health().items()), "name string, n long")}
    elif a.quarantine or a.aliases:
        found = {"rows": own.quarantine(a.limit) if a.quarantine else own.aliases(a.limit)}
    elif a.entities is not None or a.statements is not None:
        found = {"rows": own.entities(a.entities or None, a.limit) if a.entities is not None else own.statements(a.statements or None, a.limit)}
    else:
        found = {"rows": own.lexical(a.lexical, a.limit) if a.lexical else own.papers(a.search, a.limit)}
    lines = [json.dumps({"of": name, **json.loads(line)}) for name, rows in found.items() for line in rows.limit(a.limit).toJSON().collect()]
    print("\n".join(lines))
    return lines


if __name__ == "__main__":
    main()
