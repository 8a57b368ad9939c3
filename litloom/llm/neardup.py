"""Near-duplicate search by improved consistent weighted sampling over TF-IDF shingles.

1. Shingles are windows of five lower-cased words (a shorter text is one shingle). Document frequencies of all
   documents are counted in a table of SLOTS hashed slots, whose size doesn't grow with the data; what a slot holds by
   chance (the median) is taken off, so frequent shingles stand out however many rare ones there are.
2. A shingle weighs tf * idf, idf = 1 + ln((N + 1) / (df + 1)) / ln(N + 1), so 1 to 2. Each text gets HASHES samples
   (shingle, quantum) and BANDS band keys. Texts with equal word sequences are one class from here on.
3. Buckets are searched without their pairs: in each of ROUNDS rounds the members of a bucket that are not yet in its
   leader's component are compared with the leader; buckets whose members are all in one component are done. The
   texts of what is left meet by an exact prefix filter: by rising document frequency, two texts similar enough share
   one of their first shingles, what follows it in both is long enough, and a bit set of either shows few enough
   shingles that the other lacks. These are bounds: no candidate is dropped.
4. A pair is a link if its weighted Jaccard similarity, or the plain one of its shingle sets, is 0.8 or more, computed
   from whole texts. Components of links are the groups.

Random numbers of a (shingle, sample) come from a table of FIELDS gamma and uniform draws; ties between shingles that
share a draw go to the least shingle hash in every text alike.

Defined results: null and wordless texts are alone in their groups and are kept; rows that repeat id and words are one
class; ids may be null or repeat with other texts, as rows are named by id and hash of the text; very long texts are
sketched and compared whole; other columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, map_columns, parts, settle, whole_row
from .rolling import Text, grams, mixed

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 14, 4
HASHES = BANDS * ROWS
ROUNDS = 3
SLOTS, SLICES = 1 << 20, 64
FIELDS = 1 << 14
AT_ONCE = 1 << 14
#: Longs of the bit set that bounds the overlap of two texts.
LONGS = 8


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct shingle hashes in ascending order, their counts, and a hash of the word sequence (0: no words)."""
    words = Text((text or "").lower()).words()
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
    key = int(grams(words, len(words))[0]) if len(words) <= 64 else int(np.bitwise_xor.reduce(mixed(words + mixed(np.arange(len(words))))))
    values, counts = np.unique(grams(words, min(WORDS, len(words))), return_counts=True)
    return values, counts, (key ^ (len(words) << 40)) - (1 << 63) or 1


def slots(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(44)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """The table of hashed document frequencies: SLOTS counts, whatever the data. Its last entry is N."""
    size = SLOTS // SLICES

    def count(batches):
        own, n = np.zeros(SLOTS, np.int64), 0
        for batch in batches:
            for part in parts(batch):
                texts = part.column(0).to_pylist()
                own += np.bincount(np.concatenate([slots(shingles(t)[0]) for t in texts]), minlength=SLOTS)
                n += len(texts)
        if n:
            for k in range(SLICES):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([n if k == 0 else 0], pa.int64()), pa.array([zlib.compress(own[k * size : (k + 1) * size].tobytes(), 1)], pa.binary())], names=["slice", "n", "counts"])

    def add(batches):
        sums: dict = {}
        for batch in batches:
            for k, n, raw in zip(*(c.to_pylist() for c in batch.columns)):
                got = np.frombuffer(zlib.decompress(raw), np.int64)
                sums[k] = (n + sums[k][0], got + sums[k][1]) if k in sums else (n, got)
        for k, (n, own) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([n], pa.int64()), pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())], names=["slice", "n", "counts"])

    schema = "slice int, n long, counts binary"
    rows = map_arrow(map_arrow(docs, count, schema).repartition(SLICES, "slice"), add, schema).collect()
    out = np.zeros(SLOTS + 1, np.int64)
    for k, n, raw in rows:
        out[k * size : (k + 1) * size] = np.frombuffer(zlib.decompress(bytes(raw)), np.int64)
        out[-1] += n
    return out


def idf_table(frequencies: np.ndarray) -> np.ndarray:
    """idf of each slot. What a slot holds by chance, the median of all, is not the frequency of its shingle and goes, so
    that weights stay apart when there are more shingles than slots."""
    n = max(2, int(frequencies[-1]))
    own = np.clip(frequencies[:-1] - np.median(frequencies[:-1]), 0, n)
    return (1 + np.log((n + 1) / (own + 1)) / np.log(n + 1)).astype(np.float32)


def fields() -> tuple[np.ndarray, ...]:
    """r, ln c, beta and a multiplier for each sample."""
    rng = np.random.default_rng(20240229)
    r = rng.gamma(2.0, 1.0, FIELDS).astype(np.float32)
    c = np.log(rng.gamma(2.0, 1.0, FIELDS)).astype(np.float32)
    beta = rng.random(FIELDS).astype(np.float32)
    return np.maximum(r, 1e-6), c, beta, rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def samples(values: np.ndarray, weights: np.ndarray, draws: tuple) -> np.ndarray:
    """The sample of each of HASHES consistent weighted samplings as a hash of (shingle, quantum)."""
    r, c, beta, by = draws
    log = np.log(weights).astype(np.float32)
    best, out = np.full(HASHES, np.inf, np.float32), np.zeros(HASHES, np.uint64)
    each = np.arange(HASHES)
    for a in range(0, len(values), AT_ONCE):
        v = values[a : a + AT_ONCE]
        at = ((v[None, :] * by[:, None]) >> np.uint64(50)).astype(np.int32)
        rr, bb = r[at], beta[at]
        t = np.floor(log[None, a : a + AT_ONCE] / rr + bb)
        cost = c[at] - rr * (t - bb + np.float32(1))
        k = cost.argmin(axis=1)
        least = cost[each, k]
        better = least < best
        best[better] = least[better]
        got = mixed(v[k] + t[each, k].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        out[better] = got[better]
    return out


def band_keys(sample: np.ndarray) -> np.ndarray:
    rows = sample.reshape(BANDS, ROWS)
    out = mixed(np.arange(1, BANDS + 1))
    for k in range(ROWS):
        out = mixed(out * np.uint64(0x100000001B3) + rows[:, k])
    return out.view(np.int64)


def _sketch(idf):
    draws = fields()

    def step(keys, places, texts):
        classes, bands = [], []
        for t in texts:
            values, counts, key = shingles(t)
            classes.append(key or None)
            bands.append(band_keys(samples(values, counts * idf.value[slots(values)], draws)).tolist() if key else [])
        return keys, places, classes, bands

    return step


def similar(a: tuple, b: tuple) -> float:
    """The larger of the weighted and the plain Jaccard similarity of (values, weights)."""
    _, at, bt = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    plain = len(at) / (len(a[0]) + len(b[0]) - len(at))
    low = np.minimum(a[1][at], b[1][bt]).sum()
    return max(plain, float(low / (a[1].sum() + b[1].sum() - low)))


def _verify(idf, threshold):
    memo: dict = {}

    def features(key, text):
        if key not in memo:
            if len(memo) > 64:
                memo.clear()
            values, counts, own = shingles(text)
            if own != key:
                return None
            memo[key] = values, counts * idf.value[slots(values)]
        return memo[key]

    def step(a, b, of_a, of_b):
        hits = [(x, y) for x, y, s, t in zip(a, b, of_a, of_b) if (p := features(x, s)) and (q := features(y, t)) and similar(p, q) >= threshold]
        return [x for x, _ in hits], [y for _, y in hits]

    return step


def _heads(idf, threshold):
    """Of each text, the first shingles by rising document frequency, with what stands before and from each on."""

    def step(keys, texts):
        out = [[] for _ in range(7)]
        for key, t in zip(keys, texts):
            values, counts, _ = shingles(t)
            bits = np.zeros(LONGS * 64, np.uint8)
            bits[(values % np.uint64(LONGS * 64)).astype(np.int64)] = 1
            bits = np.packbits(bits).view(np.int64).tolist()
            rarity = idf.value[slots(values)]
            order = np.lexsort((values, -rarity))
            rest = np.cumsum((counts * rarity)[order].astype(np.float64)[::-1])[::-1]
            n = len(values)
            # Whichever similarity is to be reached, what comes after the head cannot reach it alone.
            last = max(n - int(np.ceil(threshold * n - 1e-9)) + 1, int((rest >= threshold * rest[0] * (1 - 1e-6)).sum()))
            for column, x in zip(out, ([key] * last, values[order][:last].view(np.int64).tolist(), range(last), [n] * last, rest[:last].tolist(), [float(rest[0])] * last, [bits] * last)):
                column.extend(x)
        return out

    return step


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the least node) of undirected edges a, b. Minimum labels with pointer jumping; every step is a
    pre-aggregated join, and steps are cut by files in the shared folder."""
    both = settle(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = settle(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("comp", "m").alias("next"), F.col("comp").alias("was"))
        jump = labels.select(F.col("node").alias("next"), F.col("comp").alias("far"))
        step = settle(step.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("comp"), "was"), "labels")
        labels = step.select("node", "comp")
        if step.where("comp <> was").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text", id: str = "doc_id") -> DataFrame:
    """id, rep_id (least id with the same words), class_id (least id of the group), n_links (links of its class to other
    classes), kept (the row that stays of its group); a row for each row of docs."""
    out = _grouped(docs, threshold, text, id)
    return out.select(F.col("id").alias(id), "rep_id", "class_id", "n_links", "kept")


def _grouped(docs: DataFrame, threshold: float, text: str, id: str) -> DataFrame:
    """near_duplicates with place, the hash of the row's text: id and place name a row where ids repeat or are null."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id).alias("id"), F.xxhash64(F.col(text)).alias("place"), F.col(text).alias("text"))
    idf = spark.sparkContext.broadcast(idf_table(document_frequencies(rows.select("text"))))
    kind = docs.schema[id].dataType.simpleString()
    sketch = settle(map_columns(rows, f"id {kind}, place long, class long, bands array<long>", _sketch, idf), "sketch")
    worded = sketch.where("class is not null")
    first = F.struct(F.col("id").isNull().alias("none"), "id", "place")  # one text, whatever ids repeat
    classes = worded.groupBy("class").agg(F.min(first).alias("rep"))
    # Equal bands of equal classes: any copy's will do; the exploded rows are made distinct before they are dealt out.
    keyed = worded.select("class", F.posexplode("bands").alias("band", "bucket")).distinct()
    busy = keyed.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = settle(keyed.join(busy, ["band", "bucket"]), "buckets")
    least = members.select("class").distinct().join(classes, "class")
    least = least.select("class", F.col("rep.id").alias("of"), F.col("rep.place").alias("at"))
    same = F.col("of").eqNullSafe(F.col("id")) & (F.col("at") == F.col("place"))
    texts = settle(least.join(rows, same, "inner").select("class", "text"), "texts")
    schema = "a long, b long"
    links, comps = None, None

    def verified(pairs: DataFrame) -> DataFrame:
        of_a = texts.select(F.col("class").alias("a"), F.col("text").alias("of_a"))
        of_b = texts.select(F.col("class").alias("b"), F.col("text").alias("of_b"))
        return map_columns(pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "of_a", "of_b"), schema, _verify, idf, threshold)

    def placed(rows: DataFrame) -> DataFrame:
        if comps is None:
            return rows.withColumn("comp", F.col("class"))
        return rows.join(comps.withColumnRenamed("node", "class"), "class", "left").withColumn("comp", F.coalesce("comp", "class"))

    tested = None
    def unmerged(here: DataFrame, by: list[str], rank) -> DataFrame:
        """Buckets with members of several components, the class of least rank and its component."""
        lead = F.min(F.struct(rank.alias("rank"), "class", "comp")).alias("lead")
        open_ = here.groupBy(*by).agg(F.min("comp").alias("low"), F.max("comp").alias("high"), lead).where("low <> high")
        return open_.select(*by, F.col("lead.class").alias("leader"), F.col("lead.comp").alias("main"))

    bucket = ["band", "bucket"]
    for turn in range(ROUNDS + 1):
        here = placed(members)
        if turn == ROUNDS - 1 and links is not None:  # of each bucket, who has most links so far
            degree = links.select("a").unionAll(links.select("b")).groupBy(F.col("a").alias("class")).agg(F.count(F.lit(1)).alias("links"))
            ranked = here.join(degree, "class", "left").withColumn("rank", F.struct(-F.coalesce("links", F.lit(0)), "class"))
        else:
            ranked = here.withColumn("rank", F.xxhash64("class", F.lit(turn), "band") if turn else F.col("class"))
        open_ = unmerged(ranked, bucket, F.col("rank"))
        if turn < ROUNDS:
            left = here.join(open_, bucket).where("comp <> main")
            pairs = left.select(F.least("class", "leader").alias("a"), F.greatest("class", "leader").alias("b"))
        else:
            some = here.join(open_.select(bucket), bucket, "left_semi").select("class").distinct()
            heads = map_columns(texts.join(some, "class").select("class", "text"), "class long, shingle long, before int, n int, rest double, total double, bits array<long>", _heads, idf, threshold)
            heads = placed(settle(heads, "heads"))
            left = heads.join(unmerged(heads, ["shingle"], F.col("class")), "shingle").where("comp <> main")
            left = settle(left, "left")  # so that both sides of the join are exchanged and a hot shingle can be split
            right = heads.select("shingle", *[F.col(c).alias(f"{c}2") for c in ("class", "before", "n", "rest", "total", "bits", "comp")])
            part = threshold / (1 + threshold)
            # A bit that only one text has set is a shingle, of weight 1 or more, that the other lacks.
            lacks = [" + ".join(f"bit_count({x}[{i}] & ~{y}[{i}])" for i in range(LONGS)) for x, y in (("bits", "bits2"), ("bits2", "bits"))]
            plain = f"least(n - before, n2 - before2, n - ({lacks[0]}), n2 - ({lacks[1]})) >= {part} * (n + n2) - 1e-6"
            heavy = f"least(rest, rest2, total - ({lacks[0]}), total2 - ({lacks[1]})) >= {part} * (total + total2) * (1 - 1e-6)"
            far = f"{plain} OR {heavy}"
            met = left.join(right, "shingle").where(f"comp <> comp2 AND (comp2 = main OR class < class2) AND ({far})")
            pairs = met.select(F.least("class", "class2").alias("a"), F.greatest("class", "class2").alias("b"))
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = settle(pairs, "pairs")
        if pairs.isEmpty():
            continue
        tested = pairs if tested is None else tested.unionByName(pairs)
        fresh = settle(verified(pairs).distinct(), "links")
        links = fresh if links is None else links.unionByName(fresh)
        comps = components(links)

    of = classes
    if links is not None:
        degree = links.select("a").unionAll(links.select("b")).groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("n_links"))
        of = classes.join(comps.join(degree, "node").withColumnRenamed("node", "class"), "class", "left")
    else:
        of = classes.withColumn("comp", F.lit(None).cast("long")).withColumn("n_links", F.lit(None).cast("long"))
    of = settle(of.select("class", "rep", F.coalesce("comp", "class").alias("comp"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "classes")
    stays = of.groupBy("comp").agg(F.min("rep").alias("stays"))
    of = of.join(stays, "comp").select("class", F.col("rep.id").alias("rep_id"), F.col("stays.id").alias("class_id"), F.col("stays.place").alias("stays"), "n_links")
    out = sketch.select("id", "place", "class").join(of, "class", "left")
    alone = F.col("class").isNull()
    return out.select(
        "id", "place", F.when(alone, F.col("id")).otherwise(F.col("rep_id")).alias("rep_id"), F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (alone | (F.col("id").eqNullSafe(F.col("class_id")) & (F.col("place") == F.col("stays")))).alias("kept"),
    )


def keep_one(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, with docs' own columns: one of each group. Of rows that repeat id and text the first by
    their other columns stays, but null and wordless ones all stay. Texts are dealt out once, rows that repeat id and text
    reduced before."""
    names = [F.col("id").isNull().alias("__none"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("__name"), F.col("place").alias("__place")]
    stays = _grouped(docs, THRESHOLD, text, id).where("kept").select(*names).distinct()
    row, order = whole_row(docs, text)
    worded = F.coalesce(F.col(text).rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    full = docs.select(row.alias("__row"), order.alias("__order"), F.col(id).alias("id"), F.xxhash64(F.col(text)).alias("place"), worded.alias("__worded"))
    once = full.where("__worded").select(*names, "__row", "__order").groupBy("__none", "__name", "__place").agg(F.min_by("__row", "__order").alias("__row"))
    kept = once.join(stays, ["__none", "__name", "__place"], "left_semi")
    return kept.select("__row.*").unionByName(full.where("NOT __worded").select("__row.*"))
