"""Lexical, dense and fused retrieval over batches of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_token, tokens, words_of
from ..functions.vectors import inner, norm
from ..storage import cut

K1, B, RRF = 1.5, 0.75, 60
#: What no token is.
MARK = "\u0000"
#: Queries of a block of vectors.
BLOCK = 500


def postings(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """id, term, tf, size (tokens of the document). A document's terms are counted in its task before the shuffle."""
    own = docs.select(F.col(id).alias("id"), tokens(F.col(text)).alias("terms")).withColumn("size", F.size("terms"))
    return own.select("id", "size", F.explode("terms").alias("term")).groupBy("id", "size", "term").agg(F.count(F.lit(1)).alias("tf"))


def query_terms(queries: DataFrame, text: str = "text", id: str = "qid") -> DataFrame:
    """qid, term, times: a repeated term counts as often."""
    return queries.select(F.col(id).alias("qid"), F.explode(tokens(F.col(text))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("times"))


def bm25(docs: DataFrame, queries: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """qid, id, score of every document that has a term of the query.

    A text is tokenised once: its tokens meet the asked terms (a join, so Spark broadcasts them where they are few), and
    all it has besides becomes one row of its own, which counts it and its size. These rows are settled; corpus size and
    mean, document frequencies and scores start from them. The weights are settled as well, so that their size is known
    when the scores are planned: broadcast, they leave the rows dealt out by id, and no pair of a query and a document is
    shuffled before it has its score.
    """
    asked = cut(query_terms(queries))
    words = asked.select("term", F.col("term").alias("hit")).distinct()
    # Tokens are filtered as rows, inside code generation; the mark stands for the document itself.
    own = docs.select(F.col(id).alias("id"), F.explode(F.concat(words_of(F.col(text)), F.array(F.lit(MARK)))).alias("term")).where((F.col("term") == MARK) | is_token(F.col("term")))
    counted = cut(own.join(words, "term", "left").groupBy("id", F.col("hit").alias("term")).agg(F.count(F.lit(1)).alias("tf")))
    n = F.count_if(F.col("term").isNull())
    corpus = counted.agg(n.alias("n"), ((F.sum("tf") - n) / F.nullif(n, F.lit(0))).alias("mean"))
    df = counted.where("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = asked.join(df, "term").join(F.broadcast(corpus))  # one row
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1), F.lit(0.0))
    weights = cut(weights.select("qid", "term", (idf * F.col("times")).alias("idf"), "mean"))
    tf = counted.withColumn("size", F.sum("tf").over(Window.partitionBy("id")) - 1).where("term is not null")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    return tf.join(weights, "term").groupBy("qid", "id").agg(F.sum(part).alias("score"))


def top_k(scores: DataFrame, k: int, by: str = "qid") -> DataFrame:
    """Rank 1 to k by score, then id. Spark keeps k rows a group in each task before the shuffle."""
    order = Window.partitionBy(by).orderBy(F.round("score", 9).desc(), "id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def dense(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, id, score: cosine of each query with each vector. docs: id, vector; queries: qid, vector.

    The stated query set against all rows, in blocks: BLOCK queries at a time are one broadcast row, each vector meets it
    once. Any number of queries is answered; the blocks' results are united.
    """
    unit = lambda x: F.transform(x, lambda v: v / F.when(norm(x) == 0, 1.0).otherwise(norm(x)))
    own = queries.select("qid", unit(F.col("vector").cast("array<double>")).alias("vector"))
    n = own.count()
    blocks = -(-n // BLOCK) or 1
    part = F.pmod(F.xxhash64("qid"), F.lit(blocks))
    out = None
    for k in range(blocks):
        block = own.where(part == k).agg(F.collect_list(F.struct("qid", "vector")).alias("asked"))
        length = norm(F.col("vector"))
        cosine = F.transform("asked", lambda q: F.struct(q["qid"].alias("qid"), (inner(F.col("vector"), q["vector"]) / F.when(F.col("length") == 0, 1.0).otherwise(F.col("length"))).alias("score")))
        met = docs.select("id", "vector", length.alias("length")).join(F.broadcast(block))
        met = met.select("id", F.explode(cosine).alias("hit")).select("hit.qid", "id", "hit.score")
        out = met if out is None else out.unionByName(met)
    return out


def fuse(*ranked: DataFrame, k: int) -> DataFrame:
    """Reciprocal rank fusion of (qid, id, rank) lists."""
    both = ranked[0].select("qid", "id", "rank")
    for other in ranked[1:]:
        both = both.unionByName(other.select("qid", "id", "rank"))
    return top_k(both.groupBy("qid", "id").agg(F.round(F.sum(1.0 / (RRF + F.col("rank"))), 5).alias("score")), k)


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Jaccard overlap of two ranked lists a query, 0.0 where both are empty."""
    def sets(x, name):
        return x.groupBy("qid").agg(F.collect_set("id").alias(name))

    both = sets(a, "x").join(sets(b, "y"), "qid", "full")
    none = F.filter(F.coalesce("x", "y"), lambda _: F.lit(False))
    x, y = (F.coalesce(F.col(c), none) for c in "xy")
    return both.select("qid", F.round(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)), 6).alias("jaccard"))


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Precision, recall, nDCG (ideal from the retrieved flags) and reciprocal rank a query. ranked: qid, rank,
    hit; relevant: qid, total."""
    own = ranked.where(F.col("rank") <= k)
    gain = F.col("hit") / F.log2(F.col("rank") + 1)
    per = own.groupBy("qid").agg(F.sum("hit").alias("hits"), F.sum(gain).alias("dcg"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("hits"), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    out = per.join(relevant, "qid", "left")
    return out.select(
        "qid", F.round(F.col("hits") / k, 6).alias("precision"), F.round(F.coalesce(F.col("hits") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0)), 6).alias("recall"),
        F.round(F.when(F.col("hits") > 0, F.col("dcg") / ideal).otherwise(0.0), 6).alias("ndcg"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr"),
    )
