"""Byte-level BPE by DuckDB recursive queries inside each partition.

A batch's distinct pre-tokens are the words of a query. One recursive step unnests them to token-position rows, joins
neighbouring tokens to the merge table and contracts each word's leftmost pair of least rank; a word leaves when no
pair of it is in the table. The ids that are left join the vocabulary, and an ordered aggregation concatenates their
bytes: encoded and decoded in one query. Words are asked for once a worker (a memo bounded by bytes) and put back per
document.

A recursive query emits every step of a word, rows in the square of its length; so a query takes words up to SQUARES in
the sum of their squared lengths, and words of more than LONG bytes (runs of letters without a break) follow the same
rule with a heap. Nothing is cut.

Defined results: null texts count as empty: no ids, the hash of the empty string; repeated rows and repeated or null ids
give a row each; very long texts are read whole, their words in turns of TURN, and their hashes grow turn by turn; an
empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain, islice

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import Memo, map_columns

LONG = 128
#: Squared bytes of the words of one query, which bound its rows.
SQUARES = 4 << 20
#: Bytes that a worker's memo holds in one of its two generations, as Python counts them about.
MEMO_BYTES = 56 << 20
#: Characters of texts that are cut into words at once, and words of one longer text.
SLICE, TURN = 2 << 20, 1 << 18

MERGE = """
WITH RECURSIVE run AS (
  SELECT 0 AS step, w, ids FROM words
  UNION ALL
  SELECT s.step + 1, s.w, s.ids[:(best & 1048575) - 1] || [best >> 20] || s.ids[(best & 1048575) + 2:]
  FROM run s JOIN (
    SELECT w, min((m.id << 20) | p) AS best
    FROM (SELECT w, unnest(ids[:-2]) * 4294967296 + unnest(ids[2:]) AS pair, generate_subscripts(ids[2:], 1) AS p FROM run)
    JOIN merges m USING (pair) GROUP BY w
  ) b ON s.w = b.w
),
done AS (SELECT w, arg_max(ids, step) AS ids FROM run GROUP BY w),
bytes AS (
  SELECT w, unhex(string_agg(v.hex, '' ORDER BY p)) AS raw
  FROM (SELECT w, unnest(ids) AS id, generate_subscripts(ids, 1) AS p FROM done) JOIN vocabulary v USING (id) GROUP BY w
)
SELECT w, array_to_string(ids, ',') AS ids, raw FROM done JOIN bytes USING (w)
"""

DECODE = """
SELECT d, string_agg(v.hex, '' ORDER BY p) AS hex
FROM (SELECT d, unnest(ids) AS id, generate_subscripts(ids, 1) AS p FROM docs)
JOIN vocabulary v USING (id) GROUP BY d
"""
IDS_A_QUERY = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """Encoder and decoder of one worker for a tiktoken rank file and a pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        self.ranks, self.pattern = read_ranks(path), regex.compile(pattern)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        rows = [(self.ranks[k[:i]], self.ranks[k[i:]], id) for k, id in self.ranks.items() for i in range(1, len(k)) if k[:i] in self.ranks and k[i:] in self.ranks]
        pair, made = pa.array([(l << 32) + r for l, r, _ in rows], pa.int64()), pa.array([id for *_, id in rows], pa.int64())
        self._load("merges", {"pair": pair, "id": made})
        self._load("vocabulary", {"id": pa.array(list(self.ranks.values()), pa.int64()), "hex": pa.array([k.hex() for k in self.ranks], pa.string())})
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.of_word = Memo(MEMO_BYTES, lambda word: 220 + 4 * len(word))

    def _load(self, name: str, columns: dict) -> None:
        self.db.register("incoming", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def _query(self, sql: str, name: str, columns: dict) -> pa.Table:
        self.db.register(name, pa.table(columns))
        try:
            return self.db.sql(sql).to_arrow_table()
        finally:
            self.db.unregister(name)

    def _long(self, word: bytes) -> list[int]:
        """The same contraction with a heap, for words beyond LONG bytes."""
        n = len(word)
        part = [word[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := self.ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if part[i] is None or j >= n or self.ranks.get(part[i] + part[j]) != rank:
                continue
            part[i], part[j] = part[i] + part[j], None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (r := self.ranks.get(part[k] + part[after[k]])) is not None:
                    heapq.heappush(heap, (r, k))
        return [self.ranks[p] for p in part if p is not None]

    def words(self, words: list[str]) -> dict[str, str | tuple[str, bytes]]:
        """Of distinct pre-tokens the ids joined by commas, and beside them the decoded bytes where they aren't the word's own."""
        out, part, squares = {}, [], 0
        for word in words:
            raw = word.encode()
            if (id := self.ranks.get(raw)) is not None:
                out[word] = str(id)
            elif len(raw) > LONG:
                ids = self._long(raw)
                text, back = ",".join(map(str, ids)), self.decode([ids])[0]
                out[word] = text if back == raw else (text, back)
            else:
                if squares + len(raw) ** 2 > SQUARES:
                    self._merge(part, out)
                    part, squares = [], 0
                part.append((word, raw))
                squares += len(raw) ** 2
        if part:
            self._merge(part, out)
        return out

    def _merge(self, part: list[tuple[str, bytes]], out: dict) -> None:
        ends = np.cumsum([0, *(len(raw) for _, raw in part)], dtype=np.int32)
        flat = self.single[np.frombuffer(b"".join(raw for _, raw in part), np.uint8)]
        got = self._query(MERGE, "words", {"w": pa.array(range(len(part)), pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))})
        for k, ids, back in zip(*(got[c].to_pylist() for c in ("w", "ids", "raw"))):
            word, raw = part[k]
            out[word] = ids if back == raw else (ids, back)

    def joined(self, cut: list[list[str]]) -> tuple[list[int], list[str], list[bytes]]:
        """Of each list of words: the number of ids, the ids joined by commas, the decoded bytes."""
        offsets = np.cumsum([0, *map(len, cut)], dtype=np.int32)
        if not offsets[-1]:
            return [0] * len(cut), [""] * len(cut), [b""] * len(cut)
        flat = pa.array(chain.from_iterable(cut), pa.string()).dictionary_encode()
        words = flat.dictionary.to_pylist()
        self.of_word.fill(set(words), self.words)
        entries = [self.of_word.young[w] for w in words]
        ids = pa.array([e if isinstance(e, str) else e[0] for e in entries], pa.string())
        raw = flat.dictionary.cast(pa.binary())
        if any(isinstance(e, tuple) for e in entries):
            raw = pa.array([w if isinstance(e, str) else e[1] for e, w in zip(entries, raw.to_pylist())], pa.binary())
        sizes = pc.count_substring(ids, ",").to_numpy() + 1
        sums = np.append(0, np.cumsum(sizes[flat.indices.to_numpy()], dtype=np.int64))[offsets]
        texts = pc.binary_join(pa.ListArray.from_arrays(offsets, ids.take(flat.indices)), ",")
        back = pc.binary_join(pa.ListArray.from_arrays(offsets, raw.take(flat.indices)), b"")
        return np.diff(sums).tolist(), texts.to_pylist(), back.to_pylist()

    def each(self, texts: list[str | None]) -> Iterator[Iterator[tuple[int, str, bytes]]]:
        """Of each text (number of ids, ids joined by commas, decoded bytes), for a long one TURN words at once."""
        for a, b in slices(texts):
            if b == a + 1 and len(texts[a] or "") > SLICE:
                found = (m[0] for m in self.pattern.finditer(texts[a]))
                yield (tuple(x[0] for x in self.joined([own])) for own in iter(lambda: list(islice(found, TURN)), []))
            else:
                cut = [self.pattern.findall(t) if t else [] for t in texts[a:b]]
                yield from ([own] for own in zip(*self.joined(cut)))

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        return [[int(i) for n, ids, _ in turns if n for i in ids.split(",")] for turns in self.each(texts)]

    def decode(self, docs: list[list[int]]) -> list[bytes]:
        out, at = [b""] * len(docs), 0
        while at < len(docs):
            end, total = at, 0
            while end < len(docs) and (end == at or total + len(docs[end]) <= IDS_A_QUERY):
                total += len(docs[end])
                end += 1
            if total > IDS_A_QUERY:  # one document: its runs of ids in turn
                ids = docs[at]
                out[at] = b"".join(self.decode([ids[i : i + IDS_A_QUERY] for i in range(0, len(ids), IDS_A_QUERY)]))
            else:
                got = self._query(DECODE, "docs", {"d": pa.array(range(at, end), pa.int64()), "ids": pa.array(docs[at:end], pa.list_(pa.int64()))})
                for d, raw in zip(got["d"].to_pylist(), got["hex"].to_pylist()):
                    out[d] = bytes.fromhex(raw)
            at = end
        return out


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec; its merge table is loaded once a worker."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def slices(texts: list, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of texts of about most characters, one text at least."""
    at = 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and (end == at or total + len(texts[end] or "") <= most):
            total += len(texts[end] or "")
            end += 1
        yield at, end
        at = end


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """id, ids array<int>. Rows as in docs; null text: no ids."""

    def make():
        def step(keys, texts):
            return keys, codec(path, pattern).encode(texts)

        return step

    return map_columns(docs.select(id, text), f"`{id}` {docs.schema[id].dataType.simpleString()}, ids array<int>", make)


def decode(encoded: DataFrame, path: str, pattern: str, id: str = "doc_id") -> DataFrame:
    """id, bytes binary of a table of id, ids."""

    def make():
        def step(keys, ids):
            return keys, codec(path, pattern).decode([x or [] for x in ids])

        return step

    return map_columns(encoded.select(id, "ids"), f"`{id}` {encoded.schema[id].dataType.simpleString()}, bytes binary", make)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Encode and decode in one pass: id, n_tokens, ids_sha256, decoded_sha256.

    The ids of each distinct pre-token are decoded by the ordered aggregation; a text's bytes are theirs in order.
    """

    def make():
        def step(keys, texts):
            counts, of_ids, of_bytes = [], [], []
            for turns in codec(path, pattern).each(texts):
                total, ids, raw = 0, hashlib.sha256(), hashlib.sha256()
                for n, text, back in turns:
                    ids.update(("," if total and n else "").encode() + text.encode())
                    raw.update(back)
                    total += n
                counts.append(total)
                of_ids.append(ids.hexdigest())
                of_bytes.append(raw.hexdigest())
            return keys, counts, of_ids, of_bytes

        return step

    return map_columns(docs.select(id, text), f"`{id}` {docs.schema[id].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string", make)
