"""Text vectors: latent semantic analysis on TF-IDF, and whatever encoder a caller brings."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.feature import IDF, CountVectorizer, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.mllib.linalg import Vectors
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import entity_template, strip_accents

# Size of vectors, bounds of the vocabulary, kinds with a representation of their own.
DIMENSION, LEAST_TERMS, MOST_TERMS, TERMS_A_TEXT = 384, 500, 5000, 5
OWN_KINDS = ["PROBLEM", "BOTTLENECK"]
INSTRUCTIONS = {"bge-small-en-v1.5": "Represent this sentence for searching relevant passages: "}


def grams(text: Column) -> Column:
    """Words of two letters or more, lower case and without accents, and pairs of neighbours."""
    words = F.filter(F.split(F.regexp_replace(F.lower(strip_accents(F.coalesce(text, F.lit("")))), r"[^\p{L}\p{N}_]+", " "), " "), lambda w: F.length(w) > 1)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.try_element_at(words, i), F.try_element_at(words, i + 1)))
    return F.when(F.size(words) > 1, F.concat(words, pairs)).otherwise(words)


class LatentSemantics:
    """TF-IDF of words and pairs, the leading singular vectors of its matrix, padded to DIMENSION and of length 1.

    The vocabulary has MOST_TERMS terms at most, so the matrix of their products (on the driver) and the projection that is
    broadcast to the tasks are bounded whatever the corpus; texts stay where they are. A text without known words is the
    zero vector."""

    def __init__(self, dimension: int = DIMENSION):
        self.dimension = dimension

    def fit(self, texts: DataFrame, text: str = "text") -> LatentSemantics:
        rows = texts.where(F.length(F.trim(text)) > 3).select(grams(F.col(text)).alias("terms"))
        n = rows.count()
        if not n:
            raise ValueError("there is no text of more than three characters to fit on")
        self.counter = CountVectorizer(inputCol="terms", outputCol="tf", vocabSize=min(MOST_TERMS, max(LEAST_TERMS, TERMS_A_TEXT * n)), minDF=1).fit(rows)
        counted = self.counter.transform(rows)
        self.idf = IDF(inputCol="tf", outputCol="weights").fit(counted)
        vectors = self._weighted(counted).select("unit").rdd.map(lambda r: Vectors.fromML(r[0]))
        size = len(self.counter.vocabulary)
        k = max(1, min(self.dimension, size - 1, n - 1))
        self.projection = np.asarray(RowMatrix(vectors, n, size).computeSVD(k).V.toArray(), np.float32)
        return self

    def _weighted(self, counted: DataFrame) -> DataFrame:
        return Normalizer(inputCol="weights", outputCol="unit").transform(self.idf.transform(counted))

    def encode(self, texts: DataFrame, text: str = "text", out: str = "vector") -> DataFrame:
        """texts with out array<float>."""
        shared, dimension = texts.sparkSession.sparkContext.broadcast(self.projection), self.dimension

        @F.pandas_udf("array<float>")
        def project(indices, values):
            def one(at, own):
                v = np.zeros(dimension, np.float32)
                if len(at):
                    got = np.asarray(own, np.float32) @ shared.value[np.asarray(at, np.int64)]
                    v[: len(got)] = got
                length = float(np.linalg.norm(v))
                return (v / length if length else v).tolist()

            return indices.combine(values, one)

        dense = self._weighted(self.counter.transform(texts.withColumn("terms", grams(F.col(text))))).withColumn("_w", vector_to_array("unit"))
        at = F.filter(F.transform("_w", lambda x, i: F.when(x != 0, i)), lambda i: i.isNotNull())
        return dense.withColumn(out, project(at, F.filter("_w", lambda x: x != 0))).drop("terms", "tf", "weights", "unit", "_w")


class Pretrained:
    """An encoder that a caller brings as encode(list of texts) -> matrix, with the model's instruction before queries.
    It runs in Arrow batches of 128 texts and rows come out with length 1."""

    def __init__(self, make: Callable[[], Callable], name: str = "", batch: int = 128):
        self.make, self.instruction, self.batch = make, INSTRUCTIONS.get(name, ""), batch

    def fit(self, texts: DataFrame, text: str = "text") -> Pretrained:
        return self

    def encode(self, texts: DataFrame, text: str = "text", out: str = "vector", is_query: bool = False) -> DataFrame:
        make, batch = self.make, self.batch

        @F.pandas_udf("array<float>")
        def run(series):
            import pandas as pd

            model, rows = make(), []
            for at in range(0, len(series), batch):
                got = np.asarray(model(series.iloc[at : at + batch].tolist()), np.float32)
                lengths = np.linalg.norm(got, axis=1, keepdims=True)
                rows += (got / np.where(lengths == 0, 1, lengths)).tolist()
            return pd.Series(rows)

        prefix = self.instruction if is_query else ""
        return texts.withColumn(out, run(F.concat(F.lit(prefix), F.coalesce(F.col(text), F.lit("")))))


def encoder(name: str = "lsa", models: dict[str, Callable] | None = None):
    """The named encoder if the caller has it, else latent semantics."""
    return Pretrained(models[name], name) if models and name in models else LatentSemantics()


def representations(own, chunks: DataFrame | None = None, statements: DataFrame | None = None, entities: DataFrame | None = None) -> DataFrame:
    """Kind, id, text, vector of chunks (chunk_id, text), statements (statement_id, normalized_statement) and entities
    (entity_id, canonical_name, category, description, aliases), the latter by F28; problems and bottlenecks are kinds of
    their own."""
    parts = []
    if chunks is not None:
        parts.append(chunks.select(F.lit("CHUNK").alias("kind"), F.col("chunk_id").alias("id"), "text"))
    if statements is not None:
        parts.append(statements.select(F.lit("STATEMENT").alias("kind"), F.col("statement_id").alias("id"), F.col("normalized_statement").alias("text")))
    if entities is not None:
        kind = F.when(F.col("category").isin(OWN_KINDS), F.col("category")).otherwise("ENTITY")
        parts.append(entities.select(kind.alias("kind"), F.col("entity_id").alias("id"), entity_template(F.col("canonical_name"), F.col("category"), F.col("description"), F.col("aliases")).alias("text")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return own.encode(rows)
