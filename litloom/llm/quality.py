"""Quality rules by repetition coverage.

Rolling hashes of words, word n-grams of several lengths and lines are made in numpy; a text fails if too large a part
of its word characters lies inside n-grams that it repeats, or of its lines' characters in lines that it repeats.

Defined results: null and wordless texts have no words and fail the base rule; every text is measured whole, however
long; repeated rows and null ids give a row each; other columns are not looked at (keep_good gives them back); an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import map_arrow, map_columns, parts
from .rolling import Text, covered, grams, repeated

SYMBOLS = np.array([ord(c) for c in "#*$%&|<>"], np.uint32)
MIN_WORDS, BASE_WINDOW, BASE_PERCENT = 10, 5, 20
#: Words of an n-gram -> the largest part of the word characters that may lie in repeated ones.
LIMITS = {5: 0.20, 8: 0.16, 12: 0.12}
#: The largest part of the lines' word characters that may lie in lines seen before.
LINE_LIMIT = 0.30
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, coverage double, dup_line_chars double"


def measure(text: str | None) -> tuple:
    t = Text(text)
    words, sizes = t.words(), t.ends - t.starts
    n, chars = len(words), int(sizes.sum())
    symbols = int(np.isin(t.codes, SYMBOLS).sum())
    dup_lines, dup_chars, repeat, worst, fits = 0, 0, 0, 0.0, True
    if n:
        stops = np.append(np.flatnonzero(t.codes == 10), len(t.codes))
        begins = np.append(0, stops[:-1] + 1)
        first = np.searchsorted(t.starts, begins)
        own = np.searchsorted(t.starts, stops) - first
        full = own > 0
        if full.sum() > 1:
            _, at = np.unique(t.spans(begins[full], stops[full]), return_index=True)
            again = np.ones(int(full.sum()), bool)
            again[at] = False
            dup_lines = int(again.sum())
            if dup_lines:
                ends = np.append(0, np.cumsum(sizes))
                line = ends[first[full] + own[full]] - ends[first[full]]
                dup_chars = int(line[again].sum())
        for k, limit in LIMITS.items():
            inside = covered(repeated(grams(words, k)), k, n)
            if k == BASE_WINDOW:
                repeat = int(inside.sum())
            part = float(sizes[inside].sum()) / chars
            worst, fits = max(worst, part), fits and part <= limit
    failed = n < MIN_WORDS or 100 * repeat > BASE_PERCENT * n
    lines = dup_chars / chars if chars else 0.0
    return n, chars, symbols, dup_lines, repeat, failed, not failed and fits and lines <= LINE_LIMIT, worst, lines


def _measures():
    def step(*columns):
        *rest, texts = columns
        return [*rest, *map(list, zip(*map(measure, texts)))] if texts else [*rest, *([] for _ in MEASURES.split(","))]

    return step


def quality(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """id and the measures, a row for each row of docs."""
    kind = docs.schema[id].dataType.simpleString()
    return map_columns(docs.select(id, text), f"`{id}` {kind}, {MEASURES}", _measures)


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with docs' own columns, in one pass and without a shuffle."""
    import pyarrow as pa

    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            for part in parts(batch):
                yield part.filter(pa.array([measure(t)[6] for t in part.column(at).to_pylist()], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
