"""Substring dedup by sliding sentence spans.

A text is cut into sentences (after a word that ends in . ! or ?, and at line breaks; a sentence of more than UNIT_WORDS
words is cut on at places that its own words name, see inner_cuts). From each unit starts a run: RUN units or more,
until it has RUN_WORDS words. Every run's hash is joined globally; a unit covered by a run that stands earlier in the
corpus (by id, then position) is removed. Case is folded character by character.

Cuts agree wherever a passage starts, but for the first 2 * WINDOW - 2 words and the last 2 * WINDOW - 1, which words
outside it may cut. Of 51 words 18 lie between; the first cut of them and the RUN_WORDS - 1 + WINDOW words after it end
before the last 9, within which no cut is sure. So a repeated passage of 51 words or more always shares a run; at most 16
words stay at its start and 31 at its end, as the last run may stop up to 14 words before the last cut that agrees.

A document's own repeats need no join: it sends each hash once, from where it stands first, and knows the others when
it is cleaned. What is sent is pre-aggregated by hash, so a passage that a third of all documents share is one row a
task; only repeated hashes come back, by a join whose hot keys Spark may split. A document's text is read again only for
its own result.

Defined results: null and wordless texts have no runs and stay as they are; of repeated rows with equal id and text no
copy is first or later, so neither removes the other; null ids come last; very long texts are read whole, their marks
being as many as their own units at most; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, settle
from .rolling import Text, mixed, powers

RUN, RUN_WORDS, UNIT_WORDS, WINDOW = 2, 16, 11, 9
#: A word that ends in one of these ends a sentence.
STOPS = np.array([ord(c) for c in ".!?"], np.uint32)


def folded(text: str) -> str:
    """text in lower case, character by character: the one letter whose lower case is longer counts as its plain one."""
    low = text.lower()
    return low if len(low) == len(text) else text.replace("\u0130", "i").lower()


def inner_cuts(words: np.ndarray, sentence: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Words before which long sentences are cut: the least hash (the last of equal ones) of each WINDOW words of one
    sentence. So no cut depends on words WINDOW or more away, and none is more than WINDOW words after the one before."""
    n = len(words) - WINDOW + 1
    inside = np.flatnonzero(long[: max(n, 0)] & (sentence[: max(n, 0)] == sentence[WINDOW - 1 :]))
    seen = np.lib.stride_tricks.sliding_window_view(words, WINDOW)[inside, ::-1] if len(inside) else np.zeros((0, WINDOW), np.uint64)
    return np.unique(inside + WINDOW - 1 - seen.argmin(axis=1))


def units(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (code points, the break after it included), words and hash of each unit."""
    t = Text(folded(text))
    if not len(t.starts):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    lines = np.cumsum(t.codes == 10)
    new = np.isin(t.codes[t.ends[:-1] - 1], STOPS) | (lines[t.starts[1:]] > lines[t.ends[:-1] - 1])
    first = np.append(0, np.flatnonzero(new) + 1)
    counts = np.diff(np.append(first, len(t.starts)))
    words = t.words()
    if (counts > UNIT_WORDS).any():
        first = np.union1d(first, inner_cuts(words, np.repeat(np.arange(len(counts)), counts), np.repeat(counts > UNIT_WORDS, counts)))
        counts = np.diff(np.append(first, len(t.starts)))
    ranks = np.arange(len(t.starts)) - np.repeat(first, counts)
    sums = np.append(np.uint64(0), np.cumsum(mixed(words + mixed(ranks + 1))))
    hashes = mixed(sums[first + counts] - sums[first] + counts.astype(np.uint64))
    starts = t.starts[first]
    starts[0] = 0
    return starts, np.append(starts[1:], len(text)), counts, hashes


def runs(counts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First unit, length in units and hash of each run that has its words before the text ends."""
    n = len(counts)
    if n < RUN:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    words = np.append(0, np.cumsum(counts))
    end = np.maximum(np.searchsorted(words, words[:-1] + RUN_WORDS), np.arange(n) + RUN)
    at = np.flatnonzero(end <= n)
    size = end[at] - at
    up, down = powers(n + 1)
    sums = np.append(np.uint64(0), np.cumsum(hashes * up[:n]))
    return at, size, mixed((sums[end[at]] - sums[at]) * down[at] + size.astype(np.uint64))


def _runs():
    def step(keys, places, texts):
        sizes, at, hashes = [], [], []
        for t in texts:
            _, _, counts, own = units(t or "")
            a, _, h = runs(counts, own)
            h, first = np.unique(h, return_index=True)
            sizes.append(len(h))
            at.append(a[first])
            hashes.append(h.view(np.int64))
        row = np.repeat(np.arange(len(texts)), sizes)
        ids = pa.array(keys).take(pa.array(row)) if len(row) else []
        return ids, np.array(places, np.int64)[row], np.concatenate([np.zeros(0, np.int64), *at]).astype(np.int32), np.concatenate([np.zeros(0, np.int64), *hashes])

    return step


def _clean():
    def step(keys, texts, marks):
        n, gone, lost, clean = [], [], [], []
        for t, own in zip(texts, marks):
            starts, ends, counts, hashes = units(t or "")
            at, size, run = runs(counts, hashes)
            later = np.ones(len(at), bool)
            later[np.unique(run, return_index=True)[1]] = False
            if own:
                later |= np.isin(at, own)
            off = np.zeros(len(starts) + 1, np.int64)
            np.add.at(off, at[later], 1)
            np.add.at(off, (at + size)[later], -1)
            out = np.cumsum(off[:-1]) > 0
            n.append(len(starts))
            gone.append(int(out.sum()))
            lost.append(int(counts[out].sum()))
            clean.append(t if not out.any() else "".join(t[a:b] for a, b, x in zip(starts, ends, out) if not x))
        return keys, n, gone, lost, clean

    return step


def remove_repeats(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """id, n_units, n_removed, n_removed_words, text (what stays), a row for each row of docs."""
    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("id"), F.xxhash64(F.col(text)).alias("place"), F.col(text).alias("text"))
    found = settle(map_columns(rows, f"id {kind}, place long, at int, hash long", _runs), "runs")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "place")
    firsts = found.groupBy("hash").agg(F.min(order).alias("first"), F.max(order).alias("last")).where("first <> last").select("hash", "first")
    firsts = settle(firsts, "firsts")  # so that both sides of the join are exchanged and a hot hash can be split
    later = found.join(firsts, "hash").where(order != F.col("first"))
    # A text's marks: bounded by its own units, whatever the corpus holds.
    marks = later.groupBy(F.col("id").alias("of"), F.col("place").alias("there")).agg(F.collect_set("at").alias("marks"))
    marks = settle(marks, "marks")  # so that rows that repeat one id and text can be split
    met = rows.join(marks, F.col("id").eqNullSafe(F.col("of")) & (F.col("place") == F.col("there")), "left").select("id", "text", "marks")
    return map_columns(met, f"`{id}` {kind}, n_units int, n_removed int, n_removed_words long, `{text}` string", _clean)
