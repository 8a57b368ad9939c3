"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions only.

Each source's documents are shuffled by a hash and laid on a line of words, cut into blocks of equally many: BLOCK_WORDS,
or fewer where that is more than one of PARTS parts of the source, whatever the other sources hold. So a target is a number of slots: whole rounds over
the source and blocks of one more, half a block from the target at most. Slot t of the schedule is the point
frac(t * golden ratio) (in 31-bit integers, so that reruns agree bit for bit); the point falls into the sources'
cumulative numbers of slots and names a source. A slot's rank among its source's slots names the block it takes, round
after round; ranks beyond the source's number are left out, and ranks that the points missed (a few a source) follow
after the last slot. Blocks and slots meet in an equi-join.

No rank is made over a whole source: slots are ranked in chunks and documents in hash buckets of about BUCKET_ROWS, and
offsets come from prefix sums over chunks and buckets. So a source with a third of all rows is spread like any other. Rows
that repeat id, source and text are counted first and laid on the line in parts of PART_WORDS, so they are spread too.

Defined results: null text and wordless texts have size 0 and are never taken; null is a source, the last; sources
weigh 1, 2, 3, repeating, in the order of their code points; ids may be null or repeat with other texts; rows that
repeat id, source and text share what is taken of them evenly, to a word; texts of any length are counted whole; other
columns may have any names and types; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, repeated, settle, whole_row

BLOCK_WORDS, MOST_TIMES, PARTS = 256, 3, 64
BUCKET_ROWS, PART_WORDS, CHUNK, BINS = 1 << 12, 1 << 12, 1 << 14, 1024
RING = 1 << 31
#: The odd integer nearest to 2**31 / golden ratio.
GOLDEN = 1327217885


def word_count(text):
    """Number of [^\\x20\\x09-\\x0D]+: blanks to one kind, then each blank before a word counts."""
    flat = F.translate(F.coalesce(text, F.lit("")), BLANKS, " " * len(BLANKS))
    return F.regexp_count(flat, F.lit("[^ ]+")).cast("long")


def targets(sized: DataFrame, most: int = MOST_TIMES, width: int = BLOCK_WORDS) -> DataFrame:
    """source, source_size, buckets, target, width, count, slots, all_slots, low, high: water-filling. Sources share all words by
    weight, none above most times its own; width and count are the words of a block and the blocks of the source; low
    and high are its part of the ring of points. One row a source."""
    own = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("equals")).alias("source_size"), F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    own = own.withColumn("weight", (F.pmod(F.row_number().over(order) - 1, F.lit(3)) + 1).cast("long"))
    # Capped sources are a prefix in the order of cap / weight (compared as integers times 6, the weights' multiple).
    own = own.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") * F.expr("6 div weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = (
        own.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.col("left").cast("double") / F.col("weights"))
        .withColumn("free", F.col("left") * 6 <= F.col("ratio") * F.col("weights"))
        .withColumn("level", F.min(F.when(F.col("free"), F.struct("ratio", F.col("source").isNull(), "source", "level"))).over(everything).getField("level"))
        .withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
        .withColumn("width", F.expr(f"greatest(1, least({width}, source_size div {PARTS}))"))
        .withColumn("count", F.expr("(source_size + width - 1) div width"))
        .withColumn("rounds", F.floor(F.col("target") / F.greatest("source_size", F.lit(1))))
        .withColumn("more", F.round((F.col("target") - F.col("rounds") * F.col("source_size")) / F.col("width")).cast("long"))
        .withColumn("slots", F.least(F.col("rounds") * F.col("count") + F.least("more", "count"), F.col("count") * most))
        .withColumn("all_slots", F.sum("slots").over(everything))
        .withColumn("share", F.round(F.col("slots") / F.greatest("all_slots", F.lit(1)) * RING).cast("long"))
    )
    high = F.sum("share").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn("high", high).withColumn("buckets", F.expr(f"n div {BUCKET_ROWS} + 1")).select("source", "source_size", "buckets", "target", "width", "count", "slots", "all_slots", (F.col("high") - F.col("share")).alias("low"), "high")


def blocks(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """Rows of sized that have words, in parts of many equal rows each, with start (first word on the source's shuffled
    line), the source's width of a block and row, which with bucket names a part."""
    own = goals.select(F.col("source").alias("of"), "width", "buckets")
    parts = sized.where("size > 0").withColumn("per", F.expr(f"greatest(1, {PART_WORDS} div size)"))
    parts = repeated(parts.withColumn("parts", F.expr("(equals - 1) div per + 1")), "parts").withColumnRenamed("copy", "part")
    parts = parts.withColumn("many", F.expr("least(per, equals - (part - 1) * per)")).withColumn("words", F.col("many") * F.col("size"))
    spread = parts.join(own, F.col("source").eqNullSafe(F.col("of"))).withColumn("bucket", F.expr("pmod(xxhash64(id, place, part, 17), buckets)"))
    spread = spread.select("source", "id", "place", "part", "size", "many", "words", "width", "bucket")
    sums = spread.groupBy("source", "bucket").agg(F.sum("words").alias("in_bucket"))
    line = Window.partitionBy("source").orderBy("bucket")
    sums = sums.withColumn("offset", F.sum("in_bucket").over(line) - F.col("in_bucket")).select(F.col("source").alias("of"), F.col("bucket").alias("at"), "offset")
    inside = Window.partitionBy("source", "bucket").orderBy(F.expr("xxhash64(id, place, part, 29)"), "id", "place", "part")
    ranked = spread.withColumn("row", F.row_number().over(inside)).withColumn("start", F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
    same = F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("at"))
    return ranked.join(sums, same).withColumn("start", F.col("start") + F.col("offset")).drop("of", "at", "offset")


def schedule(goals: DataFrame, n: int, bins: int = BINS) -> DataFrame:
    """slot, source, block: the order of the mixture, n slots, each source's own number of them. Points meet sources by
    bins of the ring, of which there are more than sources."""
    spark = goals.sparkSession
    step = RING // bins
    cells = goals.where("high > low").withColumn("bin", F.explode(F.sequence(F.expr(f"low div {step}"), F.expr(f"(high - 1) div {step}"))))
    slots = spark.range(n).select(F.col("id").alias("slot"), F.pmod(F.pmod("id", F.lit(RING)) * GOLDEN, F.lit(RING)).alias("point"))
    slots = slots.withColumn("bin", F.expr(f"point div {step}"))
    placed = slots.join(cells, "bin").where("point >= low AND point < high").select("slot", "source", "count", "slots", F.expr(f"slot div {CHUNK}").alias("chunk"))
    sums = placed.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("in_chunk"))
    sums = sums.withColumn("offset", F.sum("in_chunk").over(Window.partitionBy("source").orderBy("chunk")) - F.col("in_chunk"))
    met = sums.groupBy(F.col("source").alias("of")).agg(F.sum("in_chunk").alias("met"))
    late = goals.join(met, F.col("source").eqNullSafe(F.col("of")), "left").withColumn("met", F.coalesce("met", F.lit(0)))
    before = F.sum(F.greatest(F.col("slots") - F.col("met"), F.lit(0))).over(Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1))
    late = late.withColumn("from", F.coalesce(before, F.lit(0)) + n - F.col("met")).where("slots > met").withColumn("rank", F.explode(F.sequence("met", F.expr("slots - 1"))))
    late = late.select((F.col("from") + F.col("rank")).alias("slot"), "source", "count", "rank")
    sums = sums.select(F.col("source").alias("of"), F.col("chunk").alias("at"), "offset")
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1)
    ranked = ranked.join(sums, F.col("source").eqNullSafe(F.col("of")) & (F.col("chunk") == F.col("at"))).withColumn("rank", F.col("rank") + F.col("offset"))
    kept = ranked.where("rank < slots").select("slot", "source", "count", "rank").unionByName(late)
    return kept.select("slot", "source", F.expr("pmod(rank, count)").alias("block"))


def mix(docs: DataFrame, text: str = "text", id: str = "doc_id", source: str = "source", width: int = BLOCK_WORDS) -> dict[str, DataFrame]:
    """rows: a row for each row of docs (id, source, size, source_size, target, taken); schedule: slot, source, block;
    copies: id, source, place (hash of the text) and the times that first words of such rows are taken; width: words of a
    block at most, fewer where a source's are few."""
    sized = docs.select(F.col(id).alias("id"), F.col(source).alias("source"), F.xxhash64(F.col(text)).alias("place"), word_count(F.col(text)).alias("size"))
    sized = settle(sized.groupBy("id", "source", "place", "size").agg(F.count(F.lit(1)).alias("equals")), "sizes")
    goals = settle(targets(sized, width=width), "targets")
    n, sources = goals.agg(F.max("all_slots"), F.count(F.lit(1))).first()
    n = n or 0
    laid = blocks(sized, goals)
    slots = schedule(goals, n, min(RING, max(BINS, 1 << (2 * sources).bit_length())))
    times = slots.groupBy("source", "block").agg(F.count(F.lit(1)).alias("times")).select(F.col("source").alias("of"), F.col("block").alias("at"), "times")
    pieces = laid.withColumn("block", F.explode(F.expr("sequence(start div width, (start + words - 1) div width)")))
    pieces = pieces.withColumn("from", F.expr("greatest(start, block * width) - start")).withColumn("to", F.expr("least(start + words, (block + 1) * width) - start"))
    met = pieces.join(times, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at")), "left")
    times = F.coalesce("times", F.lit(0))
    heads = F.expr("(to + size - 1) div size - (from + size - 1) div size")
    taken = met.groupBy("source", "bucket", "row", "id", "place", "size", "many").agg(F.sum((F.col("to") - F.col("from")) * times).alias("all"), F.sum(heads * times).alias("heads"))
    each = F.expr("all div many + if(copy <= pmod(all, many), 1, 0)").alias("taken")
    nothing = repeated(sized.where("size = 0"), "equals").select("source", "id", "size", F.lit(0).cast("long").alias("taken"))
    rows = repeated(taken, "many").select("source", "id", "size", each).unionByName(nothing)
    goals = goals.select(F.col("source").alias("of"), "source_size", "target")
    rows = rows.join(goals, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    copies = taken.groupBy("source", "id", "place").agg(F.sum("heads").alias("copies")).where("copies > 0")
    return {"rows": rows, "schedule": slots, "copies": copies, "width": width}


def mixed(docs: DataFrame, text: str = "text", id: str = "doc_id", source: str = "source") -> DataFrame:
    """The mixture as documents, with docs' columns: each row as often as the schedule takes its first word.

    Rows that repeat id, source and text are reduced in the tasks that read them to the first by their other columns,
    which comes as often as all of them would.
    """

    def names(id, source):
        return [F.col(id).isNull().alias("__none"), F.coalesce(F.col(id).cast("string"), F.lit("")).alias("__name"), F.col(source).isNull().alias("__nowhere"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("__from")]

    by = ["__none", "__name", "__nowhere", "__from", "__place"]
    copies = mix(docs, text, id, source)["copies"].select(*names("id", "source"), F.col("place").alias("__place"), F.col("copies").alias("__copies"))
    row, order = whole_row(docs, text)
    full = docs.select(*names(id, source), F.xxhash64(F.col(text)).alias("__place"), row.alias("__row"), order.alias("__order"))
    once = full.groupBy(*by).agg(F.min_by("__row", "__order").alias("__row"))
    met = settle(once.join(copies, by).select("__row", "__copies"), "mixture")
    return repeated(met, "__copies").select("__row.*")
