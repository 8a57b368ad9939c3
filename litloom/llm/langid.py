"""Language identification with a blended-spectrum string kernel.

A text is the set of its letter n-grams of lengths 1 to 3 (lower case, everything else a blank); the kernel of two texts
is the number of n-grams both have over the geometric mean of their numbers. Landmarks from the training sample give a
Nyström approximation, and one ridge regression a language is solved in it. A batch of texts is scored by two matrix
products: n-gram presence by landmark presence, and kernel values by the regression weights.

Training sample: PER_LANGUAGE distinct texts a language at most, chosen by a hash of the text; all else is exact.

Defined results: null texts and texts without a letter are `und` with score 0, as is every text if there is nothing to
learn from; ties go to the first language by code point; texts of any length are read whole; repeated rows and null ids
give a row each; other columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns

PER_LANGUAGE, LANDMARKS, RIDGE = 250, 32, 1e-2
BATCH, PIECE = 64, 1 << 20
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Code point -> its lower-case letter, or 32."""
    if not _letters:
        out = np.full(0x110000, 32, np.uint64)
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
                low = chr(c).lower()
                out[c] = ord(low) if len(low) == 1 else c
        _letters.append(out)
    return _letters[0]


def ngrams(text: str | None) -> np.ndarray:
    """The distinct n-grams of 1 to 3 letters, exactly, as ascending integers; empty if there is no letter."""
    x = letters()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not (x != 32).any():
        return np.zeros(0, np.uint64)
    x = np.concatenate([[np.uint64(32)], x, [np.uint64(32)]])
    x = x[np.append(True, (x[1:] != 32) | (x[:-1] != 32))]
    b = np.uint64(21)
    parts = []
    for a in range(0, max(1, len(x) - 2), PIECE):
        y = x[a : a + PIECE + 2]
        parts.append(np.unique((y[:-2] << np.uint64(42)) | (y[1:-1] << b) | y[2:]))
    three = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
    two = np.unique(np.append(three >> b, (x[-2] << b) | x[-1]))
    one = np.unique(np.append(two >> b, x[-1]))
    return np.concatenate([one, two, three])


class Model:
    """langs, vocabulary (n-grams of the landmarks), presence (vocabulary x landmarks), weights (landmarks x langs)."""

    def __init__(self, langs: list[str], grams: list[np.ndarray], labels: list[str]):
        self.langs = langs
        self.vocabulary = np.zeros(0, np.uint64)
        if not langs:
            return
        chosen = [i for lang in langs for i in [k for k, own in enumerate(labels) if own == lang][:LANDMARKS]]
        self.vocabulary = np.unique(np.concatenate([grams[i] for i in chosen]))
        self.presence = np.zeros((len(self.vocabulary), len(chosen)), np.float32)
        for j, i in enumerate(chosen):
            self.presence[np.searchsorted(self.vocabulary, grams[i]), j] = 1
        self.norms = np.sqrt([len(grams[i]) for i in chosen]).astype(np.float32)
        kernel = np.concatenate([self.kernel(grams[a : a + BATCH]) for a in range(0, len(grams), BATCH)]).astype(np.float64)
        between = kernel[chosen]
        y = np.where(np.array(labels)[:, None] == np.array(langs)[None, :], 1.0, -1.0)
        left = kernel.T @ kernel + RIDGE * len(grams) / len(chosen) * (between + between.T) / 2
        self.weights = np.linalg.solve(left + 1e-8 * np.trace(left) * np.eye(len(chosen)), kernel.T @ y).astype(np.float32)

    def kernel(self, grams: list[np.ndarray]) -> np.ndarray:
        own = np.zeros((len(grams), len(self.vocabulary)), np.float32)
        for row, g in zip(own, grams):
            at = np.searchsorted(self.vocabulary, g)
            at[at == len(self.vocabulary)] = 0
            row[at[self.vocabulary[at] == g]] = 1
        sizes = np.sqrt([max(1, len(g)) for g in grams]).astype(np.float32)
        return (own @ self.presence) / (sizes[:, None] * self.norms[None, :])

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return langs, scores
        for a in range(0, len(texts), BATCH):
            grams = [ngrams(t) for t in texts[a : a + BATCH]]
            full = [k for k, g in enumerate(grams) if len(g)]
            if full:
                values = self.kernel([grams[k] for k in full]) @ self.weights
                for k, best, value in zip(full, values.argmax(axis=1), values.max(axis=1)):
                    langs[a + k], scores[a + k] = self.langs[best], float(np.clip((value + 1) / 2, 0, 1))
        return langs, scores


def train(rows: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """rows: text, lang. Texts without letters and null languages teach nothing."""
    rows = rows.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("hash"))
    # As many rows as languages; the model has a column of weights for each.
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("hash").alias("n")).collect()
    if not sizes:
        return Model([], [], [])
    ring = 1 << 30
    part = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, int(min(1.0, 1.5 * per_language / max(1, r.n)) * ring))])
    near = rows.where(F.pmod("hash", F.lit(ring)) < F.element_at(part, F.col("lang")))
    some = near.groupBy("lang", "hash").agg(F.min("text").alias("text"))

    def make():
        return lambda langs, hashes, texts: (langs, hashes, [ngrams(t).tobytes() for t in texts])

    got = map_columns(some.select("lang", "hash", "text"), "lang string, hash long, grams binary", make).where("length(grams) > 0").collect()
    by: dict[str, list] = {}
    for lang, h, raw in sorted(got, key=lambda r: (r[0], r[1])):
        by.setdefault(lang, []).append(np.frombuffer(bytes(raw), np.uint64))
    pairs = [(lang, g) for lang in sorted(by) for g in by[lang][:per_language]]
    return Model(sorted(by), [g for _, g in pairs], [lang for lang, _ in pairs])


def identify(docs: DataFrame, model: Model, text: str = "text", id: str = "doc_id") -> DataFrame:
    """id, lang_pred, score, a row for each row of docs. The model is broadcast; its size is set by its landmarks."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def step(keys, texts):
            return keys, *shared.value.predict(texts)

        return step

    kind = docs.schema[id].dataType.simpleString()
    return map_columns(docs.select(id, text), f"`{id}` {kind}, lang_pred string, score double", make)
