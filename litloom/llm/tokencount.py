"""Token counts without ids.

A text's pieces are counted first; the distinct pieces of a batch are cut into pre-tokens by the tokenizer itself,
each distinct pre-token is segmented once a worker (a bounded memo), and a document's count is the sum over its
pre-token frequencies. No list of a document's ids is ever made, and no text is shuffled. Segmenting each pre-token once in the whole corpus
instead, with a join of posting lists to its number, was built and measured (see the README): it shuffles more than the
input, as rare pre-tokens are most of the rows.

Special strings of the vocabulary count as one token where they stand, as is the library's default.

Defined results: null is empty: 0 bytes, 0 tokens; repeated rows and null ids give a row each; very long texts are counted
whole; other columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, map_columns

#: Bytes of the memos of pieces and of pre-tokens, a generation each, as Python counts them about.
MEMO_PIECES, MEMO_WORDS = 32 << 20, 32 << 20
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Every boundary of these pieces is a boundary of the pre-token pattern too: no pre-token holds white space after
#: its first character unless all of it is white space. So is a lone blank between two other characters.
PIECES = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
UNEVEN = re.compile(f"^ | $|[{WHITE}] | [{WHITE}]")


class Counts:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if self.tokenizer.normalizer is not None or "ByteLevel" not in repr(self.tokenizer.pre_tokenizer):
            raise ValueError("pieces are independent for byte-level vocabularies without a normalizer only")
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.of_piece, self.of_word = Memo(MEMO_PIECES, lambda p: 160 + len(p if isinstance(p, str) else p[0])), Memo(MEMO_WORDS, lambda w: 130 + len(w))

    def frequencies(self, text: str | None) -> tuple[int, Counter]:
        """Special tokens and the frequency of each piece. A str stands for the piece with its blank, a tuple for itself."""
        if not text:
            return 0, Counter()
        parts = self.special.split(text) if self.special else [text]
        count: Counter = Counter()
        for part in parts:
            if not part:
                continue
            if UNEVEN.search(part):
                count.update((p,) for p in PIECES.findall(part))
            else:
                first, *rest = part.split(" ")
                count.update(rest)
                count[(first,)] += 1
        return len(parts) - 1, count

    def _pieces(self, new: list) -> dict:
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        own = {p: [w for w, _ in cut(p[0] if isinstance(p, tuple) else " " + p)] for p in new}
        self.of_word.fill({w for words in own.values() for w in words}, self._words)
        memo = self.of_word.young
        return {p: sum(memo[w] for w in words) for p, words in own.items()}

    def _words(self, new: list[str]) -> dict:
        segment = self.tokenizer.model.tokenize
        return {w: len(segment(w)) for w in new}

    def count(self, texts: list[str | None]) -> list[int]:
        rows = [self.frequencies(t) for t in texts]
        self.of_piece.fill({p for _, own in rows for p in own}, self._pieces)
        memo = self.of_piece.young
        return [special + sum(n * memo[p] for p, n in own.items()) for special, own in rows]


_counts: dict[str, Counts] = {}


def counts(path: str) -> Counts:
    if path not in _counts:
        _counts[path] = Counts(path)
    return _counts[path]


def token_counts(docs: DataFrame, path: str, limit: int = 1024, text: str = "text", id: str = "doc_id") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit, a row for each row of docs. null text: 0, 0, false."""

    def make():
        def step(keys, texts):
            own, out = counts(path), []
            for at in range(0, len(texts), 1000):
                out += own.count(texts[at : at + 1000])
            return keys, [len((t or "").encode()) for t in texts], out

        return step

    kind = docs.schema[id].dataType.simpleString()
    return map_columns(docs.select(id, text), f"`{id}` {kind}, n_bytes long, n_tokens long", make).withColumn("over_limit", F.col("n_tokens") > limit)
