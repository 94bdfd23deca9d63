"""Whole-corpus encoding by a byte-level BPE vocabulary.

Text is cut by the vocabulary's pattern; the distinct pieces of a batch become rows of padded
matrices, one per length class. Each round every row merges its leftmost pair of least rank;
pair ranks are found in a hash table of all pairs, probed for a whole matrix at once, and rows
are compacted after each merge. Rows without a pair left leave the matrix.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache
from importlib import import_module

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Upper lengths, in bytes, of the matrices' classes. Longer pieces (runs without a boundary) take the queue, in the same merge order.
CLASSES = (4, 6, 8, 12, 16, 24, 40, 64)
#: Pieces remembered per worker: memory, not results, depends on it.
MEMORY = 200_000
#: Characters encoded at a time in a worker.
CHUNK_CHARS = 2_000_000
NONE = np.int64(1) << 40


def vocabulary_path(name: str = VOCABULARY) -> str:
    return str(import_module("public_tokenizers").path(name))


def vocabulary_pattern() -> str:
    return import_module("public_tokenizers").PATTERN


class PairTable:
    """Open-addressing hash table: (left id, right id) to rank, for arrays of pairs."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, vals = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append((a << 32) | b)
                    vals.append(rank)
        self.bits = max(4, int(np.ceil(np.log2(len(keys) * 2 + 1))))
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.vals = np.full(1 << self.bits, NONE, dtype=np.int64)
        todo, val = np.array(keys, dtype=np.int64), np.array(vals, dtype=np.int64)
        at = self._slot(todo)
        self.longest = 1
        while len(todo):
            free = self.keys[at] == -1
            where, first = np.unique(at[free], return_index=True)
            take = np.flatnonzero(free)[first]
            self.keys[where], self.vals[where] = todo[take], val[take]
            left = np.ones(len(todo), dtype=bool)
            left[take] = False
            todo, val, at = todo[left], val[left], (at[left] + 1) & ((1 << self.bits) - 1)
            self.longest += 1
        self.one = dict(zip(keys, vals))

    def _slot(self, k: np.ndarray) -> np.ndarray:
        h = k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where the two don't merge."""
        k = (left << 32) | right
        at = self._slot(k)
        got = self.keys[at]
        out = np.where(got == k, self.vals[at], NONE)
        miss = np.flatnonzero((got != k) & (got != -1))
        while len(miss):
            at[miss] = (at[miss] + 1) & ((1 << self.bits) - 1)
            got = self.keys[at[miss]]
            hit = got == k[miss]
            out[miss[hit]] = self.vals[at[miss[hit]]]
            miss = miss[~hit & (got != -1)]
        return out


def merge_matrix(ids: np.ndarray, lengths: np.ndarray, table: PairTable) -> list[np.ndarray]:
    """Token ids of each row. ``ids``: (rows, width) start ids, of which row r uses the first lengths[r]."""
    n, width = ids.shape
    result: list[np.ndarray] = [ids[0, :0]] * n
    rows, ids, lengths = np.arange(n), ids.astype(np.int64), lengths.copy()
    col = np.arange(width)
    r = np.full((n, width), NONE, dtype=np.int64)
    live = col[None, : width - 1] < (lengths - 1)[:, None]
    a, b = np.nonzero(live)
    r[a, b] = table.ranks(ids[a, b], ids[a, b + 1])
    while len(rows):
        at = r.argmin(axis=1)  # the first of equals: leftmost
        least = r[np.arange(len(rows)), at]
        done = least == NONE
        for k in np.flatnonzero(done):
            result[rows[k]] = ids[k, : lengths[k]].copy()
        if done.any():
            keep = ~done
            rows, ids, lengths, r, at, least = rows[keep], ids[keep], lengths[keep], r[keep], at[keep], least[keep]
            if not len(rows):
                break
        w = int(lengths.max())
        ids, r, col = ids[:, :w], r[:, :w], col[:w]
        # compaction: everything right of the merged pair moves one to the left
        src = np.minimum(col[None, :] + (col[None, :] > at[:, None]), w - 1)
        k = np.arange(len(rows))
        ids, r = np.take_along_axis(ids, src, 1), np.take_along_axis(r, src, 1)
        ids[k, at] = least
        lengths = lengths - 1
        r[k, lengths - 1] = NONE
        if w > 1:
            r[:, w - 1] = NONE
        for shift in (-1, 0):  # the two pairs the new token takes part in
            i = at + shift
            ok = np.flatnonzero((i >= 0) & (i + 1 < lengths))
            r[ok, i[ok]] = table.ranks(ids[ok, i[ok]], ids[ok, i[ok] + 1])
    return result


def merge_queue(start: list[int], table: PairTable) -> list[int]:
    """The same order of merges (least rank, then leftmost) for one long piece, in n log n steps."""
    n = len(start)
    ids, nxt, prv, alive = list(start), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    rank = table.one.get
    heap = [(v, i, start[i], start[i + 1]) for i in range(n - 1) if (v := rank((start[i] << 32) | start[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        v, i, a, b = heapq.heappop(heap)
        j = nxt[i] if alive[i] else n
        if j >= n or not alive[i] or ids[i] != a or ids[j] != b:
            continue
        ids[i], alive[j], nxt[i] = v, False, nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        for left in (prv[i], i):
            if left >= 0 and nxt[left] < n:
                pair = (ids[left], ids[nxt[left]])
                if (x := rank((pair[0] << 32) | pair[1])) is not None:
                    heapq.heappush(heap, (x, left, *pair))
    return [t for t, ok in zip(ids, alive) if ok]


class Encoder:
    """Texts to ids by one vocabulary; keeps the ids of pieces it has met, up to MEMORY of them."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks, self.table = ranks, PairTable(ranks)
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self.cut = regex.compile(pattern)
        self.known: dict[str, list[int]] = {}

    def _learn(self, pieces: list[str]) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {}
        todo: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            raw = p.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            if whole is not None:
                out[p] = [whole]
            elif len(raw) > CLASSES[-1]:
                out[p] = merge_queue([int(x) for x in self.byte[np.frombuffer(raw, dtype=np.uint8)]], self.table)
            else:
                todo.setdefault(next(c for c in CLASSES if len(raw) <= c), []).append((p, raw))
        for width, rows in todo.items():
            flat = np.frombuffer(b"".join(raw.ljust(width, b"\0") for _, raw in rows), dtype=np.uint8).reshape(len(rows), width)
            merged = merge_matrix(self.byte[flat], np.array([len(raw) for _, raw in rows]), self.table)
            out.update((p, m.tolist()) for (p, _), m in zip(rows, merged))
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; null and empty give an empty list, marker strings are ordinary text."""
        cut = [self.cut.findall(t) if t else [] for t in texts]
        new = {p for c in cut for p in c if p not in self.known}
        learned = self._learn(list(new))
        if len(self.known) + len(learned) > MEMORY:
            # what this batch needs stays; the rest can be found again
            self.known = {p: self.known[p] for c in cut for p in c if p in self.known}
        self.known.update(learned)
        known = self.known
        out = []
        for c in cut:
            ids: list[int] = []
            for p in c:
                ids += known[p]
            out.append(ids)
        return out


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def chunks(texts: list[str | None]) -> Iterator[slice]:
    """Stretches of a batch of at most CHUNK_CHARS characters, or one text."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > start and size + n > CHUNK_CHARS:
            yield slice(start, i)
            start, size = i, 0
        size += n
    if start < len(texts):
        yield slice(start, len(texts))


def _runner(path: str, pattern: str, count: bool, carry: tuple[str, ...] = ()) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path, pattern)
        for b in batches:
            texts = b["text"].tolist()
            for s in chunks(texts):
                ids = enc.encode(texts[s])
                yield pd.DataFrame({c: b[c].to_numpy()[s] for c in ("doc_id", *carry)} | ({"n_tokens": np.array([len(x) for x in ids], dtype="int64")} if count else {"ids": ids}))

    return run


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row of ``docs`` (doc_id, text).

    Null and empty texts give an empty list; blanks, control characters and marker strings are ordinary text. Very long
    texts are encoded whole. Repeated rows each give a row. Other columns of ``docs`` are not read.
    """
    run = _runner(path or vocabulary_path(), pattern or vocabulary_pattern(), False)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id bigint, ids array<int>")


def token_counts(docs: DataFrame, *carry: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ..., n_tokens) of every row of ``docs``, with the columns ``carry``; null and empty texts have 0."""
    run = _runner(path or vocabulary_path(), pattern or vocabulary_pattern(), True, carry)
    d = docs.select(F.col("doc_id").cast("long"), *carry, "text")
    return d.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.drop("text").schema) + ", n_tokens bigint")
