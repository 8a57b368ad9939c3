"""Document structure: sentences, chunks, sections, reading order.

Greedy steps that depend on what they have taken so far run in Arrow batches, one document at a time and without a
shuffle; everything else is windows and expressions.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from ..functions.sections import protect, unprotect
from ..functions.text import furniture_key
from ..session import ship

# Sizes of chunks, and what a sentence end may follow.
CUT, OVERSIZED, OVERLAP, MIN_SENTENCE = 1200, 2000, 200, 6
ABBREVIATIONS = ["et al.", "e.g.", "i.e.", "cf.", "Fig.", "Eq.", "Sec.", "vs.", "Dr.", "etc."]
BOUNDARY = r"([.?!])\s+(?=[A-Z0-9\"'(\[{])"
MARGIN, NEAR_MARGIN, PAGE_HEIGHT = 0.08, 15.0, 792.0
STANDALONE = r"(?i)^(\d+|[ivxlcdm]+)$"
IMPRINT = r"(?i)(www\.[a-z0-9\-]+\.[a-z]+|issn:\s*\d|paper id:\s*[a-z0-9]+|doi:\s*https?://|copyright\b|all rights reserved)"
_END = re.compile(r"(?<=[.!?])\s+(?=\S)|\n+")


def sentences(text: str | None) -> list[tuple[int, int]]:
    """[start, end) of each sentence. No end after an abbreviation, an initial or inside a decimal; pieces
    under MIN_SENTENCE characters join the sentence before."""
    if not text or not text.strip():
        return []
    cuts = []
    for m in _END.finditer(text):
        head = text[max(0, m.start() - 8) : m.start()]
        if "\n" not in m.group() and (any(head.endswith(a) for a in ABBREVIATIONS) or re.search(r"(?:^|[\s.])[A-Z]\.$", head)):
            continue
        cuts.append((m.start(), m.end()))
    out, at = [], 0
    for a, b in [*cuts, (len(text), len(text))]:
        if text[at:a].strip():
            if out and a - at < MIN_SENTENCE:
                out[-1] = (out[-1][0], a)
            else:
                out.append((at, a))
        at = b
    return out


def segments(x: Column) -> Column:
    """The sentences of a paragraph, without Python workers: ends before a capital, a digit, a quote or a bracket, full
    stops that F19 protects end none, pieces under MIN_SENTENCE characters go; the paragraph itself if none is left."""
    bare = F.regexp_replace(x, r"^\s+|\s+$", "")
    parts = F.split(F.regexp_replace(protect(bare), BOUNDARY, "$1\u0001"), "\u0001")
    parts = F.filter(F.transform(parts, lambda p: unprotect(F.trim(p))), lambda p: F.length(p) >= MIN_SENTENCE)
    return F.when(bare == "", F.array().cast("array<string>")).when(F.size(parts) > 0, parts).otherwise(F.array(bare))


def segment_rows(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """E6 over texts whose paragraphs are lines: key, paragraph, ordinal, sentence."""
    lines = df.select(key, F.posexplode(F.split(text, r"\n+")).alias("paragraph", "line"))
    return lines.select(key, "paragraph", F.posexplode(segments(F.col("line"))).alias("ordinal", "sentence"))


def running_heads(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Blocks (doc, page, text, y0, y1, height) with zone (TOP, BOTTOM or null), key (F20 of the first line) and furniture:
    its key stands in the zone twice or more in its document, or it is a number or an imprint in a margin."""
    height = F.coalesce(F.nullif(F.col("height"), F.lit(0.0)), F.lit(PAGE_HEIGHT))
    low = height * (1 - MARGIN) - NEAR_MARGIN
    top, bottom = F.col("y0") <= height * MARGIN + NEAR_MARGIN, (F.col("y1") >= low) | (F.col("y0") >= low)
    first = F.trim(F.get(F.split(F.trim("text"), "\n"), F.lit(0)))
    own = blocks.withColumn("zone", F.when(top, "TOP").when(bottom, "BOTTOM")).withColumn("key", furniture_key(first))
    counted = F.col("zone").isNotNull() & (F.col("key") != "")
    repeats = own.where(counted).groupBy(doc, "zone", "key").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    out = own.join(repeats, [doc, "zone", "key"], "left")
    bare = F.trim("text")
    alone = F.when(top, bare.rlike(STANDALONE)).when(bottom, bare.rlike(STANDALONE) | bare.rlike(IMPRINT)).otherwise(False)
    return out.select(*blocks.columns, "zone", "key", (F.col("times").isNotNull() | F.coalesce(alone, F.lit(False))).alias("furniture"))


def page_text(tagged: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, page, text of the blocks that are no furniture, in the order of their place on the page."""
    body = tagged.where(~F.col("furniture")).groupBy(doc, "page").agg(F.array_sort(F.collect_list(F.struct("y0", "y1", "text"))).alias("blocks"))
    return body.select(doc, "page", F.array_join(F.transform("blocks", lambda b: b["text"]), "\n\n").alias("text"))


def paragraph_chunks(text: str | None) -> list[str]:
    """The paragraphs of a section gathered until CUT characters (joints of two count). One of more than OVERSIZED ends
    the chunk before it and is cut by its sentences into chunks of its own."""
    out, group, size = [], [], 0
    for part in (p.strip() for p in (text or "").split("\n")):
        if not part:
            continue
        if group and (len(part) > OVERSIZED or size + len(part) > CUT):
            out.append("\n\n".join(group))
            group, size = [], 0
        if len(part) > OVERSIZED:
            out += _packed([part[a:b] for a, b in sentences(part)])
        else:
            group.append(part)
            size += len(part) + 2
    return [*out, "\n\n".join(group)] if group else out


def _packed(parts: list[str]) -> list[str]:
    out, now, size = [], [], 0
    for part in parts:
        if now and size + len(part) > CUT:
            out.append(" ".join(now))
            now, size = [], 0
        now.append(part)
        size += len(part) + 1
    return [*out, " ".join(now)] if now else out


def sentence_chunks(text: str | None) -> list[str]:
    """Windows of sentences of CUT characters, each stepping back over OVERLAP characters at most, never to its
    own start."""
    own = [(text or "")[a:b] for a, b in sentences(text)]
    out, i = [], 0
    while i < len(own):
        j, size = i, 0
        while j < len(own) and (j == i or size + 1 + len(own[j]) <= CUT):
            size += len(own[j]) + (j > i)
            j += 1
        out.append(" ".join(own[i:j]))
        if j == len(own):
            break
        k, back = j, 0
        while k - 1 > i and back + len(own[k - 1]) <= OVERLAP:
            k -= 1
            back += len(own[k])
        i = k
    return out


def per_text(df: DataFrame, key: str, text: str, make, item: str) -> DataFrame:
    """key, ordinal, item columns: one row for each thing make(text) gives."""
    kind = df.schema[key].dataType.simpleString()
    items = pa.list_(to_arrow_type(DataType.fromDDL(item)))

    def run(batches):
        for batch in batches:
            made = [make(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, items)], names=[key, "items"])

    ship(df.sparkSession)
    rows = df.select(key, text).mapInArrow(run, f"`{key}` {kind}, items array<{item}>")
    return rows.select(key, F.posexplode("items").alias("ordinal", "item"))


def sentence_rows(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    found = per_text(df, key, text, _spans, "struct<start:int,end:int>")
    return found.select(key, "ordinal", "item.start", "item.end")


def _spans(text):
    return [{"start": a, "end": b} for a, b in sentences(text)]


def chunks(df: DataFrame, strategy: str = "A", key: str = "doc_id", text: str = "text") -> DataFrame:
    """W11 (A) and W12 (B): key, ordinal, chunk. With a row for each section no chunk crosses sections."""
    make = paragraph_chunks if strategy == "A" else sentence_chunks
    return per_text(df, key, text, make, "string").withColumnRenamed("item", "chunk")


def islands(df: DataFrame, key: str, order: str, starts: Column) -> DataFrame:
    """Island number: rows from one start to the next."""
    return df.withColumn("island", F.sum(starts.cast("int")).over(Window.partitionBy(key).orderBy(order)))


def merge_paragraphs(rows: DataFrame, key: str = "section", order: str = "ordinal") -> DataFrame:
    """Key, first, start_page, end_page, text: a paragraph (page, text) goes on with the next of its section where that
    stands on the next page and begins with a small letter, and it has no final stop. A hyphen at its end joins the words."""
    line = Window.partitionBy(key).orderBy(order)
    before = F.lag("text").over(line)
    on = (F.col("page") == F.lag("page").over(line) + 1) & ~before.rlike("[.?!][\"']?\\s*$") & F.col("text").rlike("^[a-z]")
    parts = islands(rows.withColumn("_start", ~F.coalesce(on, F.lit(False))), key, order, F.col("_start"))
    parts = parts.groupBy(key, "island").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "page", "text"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(""), lambda text, x: F.when(text == "", x["text"]).when(F.endswith(text, F.lit("-")), F.concat(F.left(text, F.length(text) - 1), x["text"])).otherwise(F.concat(text, F.lit(" "), x["text"])))
    return parts.select(key, F.col("parts")[0]["at"].alias("first"), F.col("parts")[0]["page"].alias("start_page"), F.element_at("parts", -1)["page"].alias("end_page"), joined.alias("text"))


def section_parents(headers: DataFrame, key: str = "doc_id", order: str = "ordinal") -> DataFrame:
    """Headers (id, level) with parent: of level 2 the last of level 1, of deeper ones the last of level 2 since the
    last of level 1, else that one."""
    line = Window.partitionBy(key).orderBy(order)
    top = F.last(F.when(F.col("level") == 1, F.col("id")), ignorenulls=True).over(line)
    near = F.last(F.when(F.col("level").isin(1, 2), F.col("id")), ignorenulls=True).over(line)
    return headers.withColumn("parent", F.when(F.col("level") == 2, top).when(F.col("level") >= 3, near))


def reading_order(blocks: DataFrame, middle: float, full: float) -> DataFrame:
    """Rank of blocks (page, block, x0, x1, y0): wide ones above, left, right column, wide ones below; two columns
    only if two blocks or more stand on either side."""
    page = Window.partitionBy("page")
    wide = (F.col("x1") - F.col("x0")) >= full
    side = F.when(wide, "W").when(F.col("x0") >= middle, "R").otherwise("L")
    own = blocks.withColumn("side", side)
    two = (F.count_if(F.col("side") == "L").over(page) >= 2) & (F.count_if(F.col("side") == "R").over(page) >= 2)
    top = F.min(F.when(F.col("side") != "W", F.col("y0"))).over(page)
    place = F.when(~two, 0).when((F.col("side") == "W") & (F.col("y0") < F.coalesce(top, F.col("y0") + 1)), 0).when(F.col("side") == "L", 1).when(F.col("side") == "R", 2).otherwise(3)
    own = own.withColumn("column", place)
    return own.withColumn("rank", F.row_number().over(page.orderBy("column", "y0", "x0", "block"))).drop("side")
