"""Source readers: captured payloads, JSONL, CSV, Parquet and XML files to canonical rows (SRC2-SRC8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

# What a page has that is no PDF, in its first HEAD bytes, and which of those pages ask for money.
HTML = [r"<!doctype\s+html", r"<html\b", r"<head\b", r"<body\b", r"access\s+denied", r"sign\s+in\s+to\s+view", r"purchase\s+pdf", r"subscription\s+required", "cloudflare", "captcha"]
PAYWALL = ["access denied", "paywall", "purchase", "subscription"]
HEAD, MAGIC_HEAD, LEAST_BYTES, MOST_BYTES = 4096, 1024, 100, 50 * 1024 * 1024

PAPER = "source string, source_id string, doi string, title string, abstract string, year int, authors array<string>"


def _paper(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    row = df.select(F.lit(source).alias("source"), *[v.alias(k) for k, v in columns.items()])
    return row.select("source", "source_id", T.doi(F.col("doi")).alias("doi"), T.clean_text(F.col("title")).alias("title"), T.clean_text(F.col("abstract")).alias("abstract"), F.col("year").cast("int").alias("year"), "authors")


def works_json(spark: SparkSession, path: str) -> DataFrame:
    """SRC2: pages of results with inverted-index abstracts."""
    schema = "results array<struct<id:string,doi:string,title:string,publication_year:int,abstract_inverted_index:map<string,array<int>>,authorships:array<struct<author:struct<display_name:string>>>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("results").alias("r"))
    return _paper(rows, "openalex", source_id=F.col("r.id"), doi=F.col("r.doi"), title=F.col("r.title"), abstract=T.inverted_to_text(F.col("r.abstract_inverted_index")), year=F.col("r.publication_year"), authors=F.transform("r.authorships", lambda a: a["author"]["display_name"]))


def registry_json(spark: SparkSession, path: str) -> DataFrame:
    """SRC3: message.items; rows without DOI are skipped, tags of abstracts dropped."""
    item = "array<struct<DOI:string,title:array<string>,abstract:string,issued:struct<`date-parts`:array<array<int>>>,author:array<struct<given:string,family:string>>>>"
    rows = spark.read.schema(f"message struct<items:{item}>").json(path, multiLine=True).select(F.explode("message.items").alias("r")).where("r.DOI is not null")
    year = F.expr("r.issued.`date-parts`[0][0]")
    return _paper(rows, "crossref", source_id=F.col("r.DOI"), doi=F.col("r.DOI"), title=F.expr("get(r.title, 0)"), abstract=F.col("r.abstract"), year=year, authors=F.transform("r.author", lambda a: F.concat_ws(" ", a["given"], a["family"])))


def scholar_json(spark: SparkSession, path: str) -> DataFrame:
    """SRC5: data rows with external ids."""
    schema = "data array<struct<paperId:string,title:string,abstract:string,year:int,externalIds:struct<DOI:string>,authors:array<struct<name:string>>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("data").alias("r"))
    return _paper(rows, "semantic_scholar", source_id=F.col("r.paperId"), doi=F.col("r.externalIds.DOI"), title=F.col("r.title"), abstract=F.col("r.abstract"), year=F.col("r.year"), authors=F.transform("r.authors", lambda a: a["name"]))


def feed_xml(spark: SparkSession, path: str) -> DataFrame:
    """SRC4: entries of an Atom feed."""
    schema = "id string, title string, summary string, published string, author array<struct<name:string>>"
    rows = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    return _paper(rows, "arxiv", source_id=T.arxiv_id(F.col("id")), doi=F.lit(None).cast("string"), title=F.col("title"), abstract=F.col("summary"), year=F.substring("published", 1, 4), authors=F.transform("author", lambda a: a["name"]))


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC6: JSON lines; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """SRC7: Parquet; only the picked columns are read."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC8."""
    return spark.read.schema(schema).csv(path, header=True)


def pdf_verdict(content: Column, content_type: Column | None = None) -> Column:
    """SRC11: what is wrong with downloaded bytes (null and no bytes: EMPTY_FILE), or SUCCESS_PDF. Pages are not parsed here."""
    head = F.lower(F.decode(F.substring(content, 1, HEAD), "ISO-8859-1"))
    magic = F.decode(F.substring(content, 1, MAGIC_HEAD), "ISO-8859-1").contains("%PDF-")
    said = F.lit(False) if content_type is None else F.coalesce(F.lower(content_type).contains("text/html"), F.lit(False))
    page = F.when(head.rlike("|".join(PAYWALL)), "PAYWALL").otherwise("HTML_NOT_PDF")
    return (
        F.when(content.isNull() | (F.length(content) == 0), "EMPTY_FILE").when(head.rlike("|".join(HTML)) | (said & ~magic), page)
        .when(~magic | (F.length(content) < LEAST_BYTES), "INVALID_PDF").otherwise("SUCCESS_PDF")
    )


def artifact(content: Column, content_type: Column | None = None) -> Column:
    """SRC11: struct<verdict, size, sha256> of downloaded bytes; no hash of none."""
    size = F.coalesce(F.length(content), F.lit(0)).cast("long")
    return F.struct(pdf_verdict(content, content_type).alias("verdict"), size.alias("size"), F.when(size > 0, F.sha2(content, 256)).alias("sha256"))


def fulltext_url(pdf: Column, arxiv: Column, repository: Column, open_access: Column) -> Column:
    """SRC12: the first URL there is, in this order."""
    return F.coalesce(pdf, F.concat(F.lit("https://arxiv.org/pdf/"), arxiv), repository, open_access)


def store(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    """SRC9: all tables of a store by name, each also a temporary view."""
    out = {name: spark.read.parquet(f"{root}/{name}") for name in names}
    for name, df in out.items():
        df.createOrReplaceTempView(name)
    return out


def fetch_status(code: Column, cached: Column) -> Column:
    """SRC13: outcome of a request from its status code; a cached copy goes before all."""
    return (
        F.when(cached, "CACHED").when(code.between(200, 299), "FETCHED").when(code == 404, "NOT_FOUND")
        .when(code.isin(401, 403), "ACCESS_DENIED").when(code == 429, "RATE_LIMITED").otherwise("FAILED")
    )


def retry_delay(attempt: Column, retry_after: Column, code: Column, most: int = 4) -> Column:
    """SRC1: seconds until the next try of a request, null where there is none: 1.5^attempt, or what the server asks for."""
    again = ~code.between(200, 299) & (attempt < most)
    return F.when(again, F.coalesce(retry_after.cast("double"), F.pow(F.lit(1.5), attempt)))


def download_url(known: Column, arxiv: Column, open_access: Column) -> Column:
    """SRC14: where a full text is fetched from: the known URL, arXiv's, the open one; an empty one is none."""
    known, arxiv, open_access = (F.nullif(c, F.lit("")) for c in (known, arxiv, open_access))
    return F.coalesce(known, F.concat(F.lit("https://arxiv.org/pdf/"), arxiv, F.lit(".pdf")), open_access)


def download_status(url: Column, cached: Column, code: Column, content_type: Column, size: Column, most: int = MOST_BYTES) -> Column:
    """SRC14: outcome of one download. No code (no answer), a code but 200, a page where no PDF was asked for (a login wall),
    and more than `most` bytes are failures; a copy that is there is not fetched again."""
    wall = F.coalesce(F.lower(content_type).contains("text/html"), F.lit(False)) & ~(url.contains("arxiv.org") | url.contains("pdf"))
    bad = F.coalesce(code != 200, F.lit(True)) | wall | F.coalesce(size > most, F.lit(False))
    return F.when(url.isNull(), "FULLTEXT_UNAVAILABLE").when(cached, "FULLTEXT_AVAILABLE").when(bad, "FULLTEXT_FAILED").otherwise("FULLTEXT_AVAILABLE")


def collected(attempts: DataFrame) -> DataFrame:
    """SRC14: number and share of each status of attempts."""
    own = attempts.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return own.crossJoin(F.broadcast(attempts.agg(F.count(F.lit(1)).alias("total")))).select("status", "n", F.round(F.col("n") / F.col("total"), 4).alias("share"))


def url_map(works: DataFrame) -> DataFrame:
    """SRC15: key, urls of works (id, doi, best, locations): the best location first, then all others, distinct, by id and by DOI."""
    urls = F.array_distinct(F.filter(F.concat(F.array("best"), F.coalesce("locations", F.array().cast("array<string>"))), lambda u: u.isNotNull()))
    rows = works.withColumn("urls", urls).where(F.size("urls") > 0)
    return rows.select(F.col("id").alias("key"), "urls").unionByName(rows.select(T.doi(F.col("doi")).alias("key"), "urls")).where("key is not null")
