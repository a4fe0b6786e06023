"""Rank-synchronous byte-pair merging over ragged numpy arrays.

A batch of pre-tokens is one flat array of symbols with row offsets.  In every
round each unfinished row applies its lowest-rank adjacent pair (the leftmost of
equals) at the same time; rows without a mergeable pair leave the arrays.  Rows
of more than ``LONG`` symbols would need as many rounds as they have merges, so
they go through a heap that applies the same order.
"""

from __future__ import annotations

import heapq

import numpy as np

LONG = 512
NONE = np.int64(1 << 40)


class PairTable:
    """Sorted lookup (left symbol, right symbol) -> (rank, merged symbol)."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray, symbols: int):
        self.symbols = np.int64(symbols)
        key = left.astype(np.int64) * self.symbols + right
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.merged = key[order], rank[order].astype(np.int64), merged[order].astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (``NONE`` if the pair doesn't merge) and merged symbols; a
        negative symbol never merges."""
        if not len(self.key):
            return np.full(len(left), NONE), np.zeros(len(left), np.int64)
        key = left * self.symbols + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        hit = (self.key[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.rank[at], NONE), self.merged[at]

    @classmethod
    def of_pieces(cls, pieces: dict, ranks: dict) -> PairTable:
        """All ways to cut a piece into two pieces. pieces: text or bytes -> symbol;
        ranks: those that merges may make -> rank."""
        rows = [(a, b, rank, pieces[p]) for p, rank in ranks.items() for k in range(1, len(p)) if (a := pieces.get(p[:k])) is not None and (b := pieces.get(p[k:])) is not None]
        table = np.array(rows, dtype=np.int64).reshape(-1, 4).T
        return cls(*table, symbols=max(pieces.values(), default=0) + 1)


def merge(table: PairTable, symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Final symbols and offsets of all rows, in the order given."""
    rows = len(offsets) - 1
    length = np.diff(offsets)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (row numbers, lengths, flat symbols)
    for r in np.flatnonzero(length > LONG):
        out = _merge_long(table, symbols[offsets[r] : offsets[r + 1]])
        done.append((np.array([r]), np.array([len(out)]), out))
    row = np.flatnonzero(length <= LONG)
    take = np.repeat(length <= LONG, length)
    sym, size = symbols[take].astype(np.int64), length[row]
    empty = size == 0
    if empty.any():
        done.append((row[empty], size[empty], np.zeros(0, np.int64)))
        row, size = row[~empty], size[~empty]
    rank, made = _ranks(table, sym, size)
    while len(row):
        start = np.cumsum(size) - size
        best = np.minimum.reduceat(rank, start)
        live = best < NONE
        if not live.all():
            stay = np.repeat(live, size)
            done.append((row[~live], size[~live], sym[~stay]))
            row, size, sym, rank, made, best = row[live], size[live], sym[stay], rank[stay], made[stay], best[live]
            if not len(row):
                break
            start = np.cumsum(size) - size
        hits = np.flatnonzero(rank == np.repeat(best, size))
        owner = np.searchsorted(start, hits, side="right") - 1
        at = hits[np.concatenate(([True], owner[1:] != owner[:-1]))]  # one a row, the leftmost
        sym[at] = made[at]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        at = at - np.arange(len(at))  # one symbol has gone before each later row
        sym, rank, made = sym[keep], rank[keep], made[keep]
        size = size - 1
        start, end = np.cumsum(size) - size, np.cumsum(size)
        for i, ok in ((at, at + 1 < end), (at - 1, at > start)):
            i = i[ok] if i is not at else at
            if i is at:
                rank[at] = NONE
                i = at[ok]
            if len(i):
                rank[i], made[i] = table.find(sym[i], sym[i + 1])
    number = np.concatenate([d[0] for d in done]) if done else np.zeros(0, np.int64)
    sizes = np.concatenate([d[1] for d in done]) if done else np.zeros(0, np.int64)
    flat = np.concatenate([d[2] for d in done]) if done else np.zeros(0, np.int64)
    final = np.zeros(rows, np.int64)
    final[number] = sizes
    out_offsets = np.concatenate(([0], np.cumsum(final)))
    place = np.repeat(out_offsets[:-1][number] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flat))
    out = np.empty(len(flat), np.int64)
    out[place] = flat
    return out, out_offsets


def _ranks(table: PairTable, sym: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rank, made = np.full(len(sym), NONE), np.zeros(len(sym), np.int64)
    if len(sym) > 1:
        rank[:-1], made[:-1] = table.find(sym[:-1], sym[1:])
        rank[np.cumsum(size) - 1] = NONE
    return rank, made


def _merge_long(table: PairTable, symbols: np.ndarray) -> np.ndarray:
    """The same order of merges for one long row, by a heap over linked symbols."""
    sym = [int(x) for x in symbols]
    rank, made = _ranks(table, np.asarray(sym, dtype=np.int64), np.array([len(sym)]))
    follow, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
    heap = [(int(r), i, sym[i], sym[i + 1], int(m)) for i, (r, m) in enumerate(zip(rank, made, strict=True)) if r < NONE]
    heapq.heapify(heap)
    known: dict[tuple[int, int], tuple[int, int]] = {}

    def offer(i: int, j: int) -> None:
        pair = sym[i], sym[j]
        if pair not in known:
            r, m = table.find(np.array([pair[0]]), np.array([pair[1]]))
            known[pair] = int(r[0]), int(m[0])
        r, m = known[pair]
        if r < NONE:
            heapq.heappush(heap, (r, i, *pair, m))

    gone = -2
    while heap:
        _, i, a, b, m = heapq.heappop(heap)
        j = follow[i]
        if sym[i] != a or j >= len(sym) or sym[j] != b:
            continue
        sym[i], sym[j] = m, gone
        follow[i] = follow[j]
        if follow[i] < len(sym):
            before[follow[i]] = i
            offer(i, follow[i])
        if before[i] >= 0:
            offer(before[i], i)
    return np.array([x for x in sym if x != gone], dtype=np.int64)
