"""Byte-pair merging of many words at once: exact ranked merges, vectorised over a flat array of symbols.

A round makes one merge in each word, so words of many symbols are merged one by one with a heap instead.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np

_NONE = np.int64(1 << 60)
_FIRST = 512
LONG_WORD = 128  # symbols


class PairMerger:
    """Merges adjacent symbols by rank: in every word, again and again, the leftmost pair of least rank."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray) -> None:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        self.bits = max(8, int(len(keys) * 4).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, np.uint64(2**64 - 1), np.uint64)
        self.rank = np.full(size, _NONE, np.int64)
        self.merged = np.zeros(size, np.int32)
        self.pairs: dict[int, tuple[int, int]] | None = None  # of long words, made when there is one
        slots, at = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(at):  # linear probing: of those that want a free slot, the first gets it
            free = self.keys[slots[at]] == np.uint64(2**64 - 1)
            _, first = np.unique(slots[at], return_index=True)
            take = np.zeros(len(at), bool)
            take[first] = True
            take &= free
            own = at[take]
            self.keys[slots[own]], self.rank[slots[own]], self.merged[slots[own]] = keys[own], rank[own], merged[own]
            at = at[~take]
            slots[at] = (slots[at] + 1) & (size - 1)
            self.probes += 1
        # most first pairs are of single bytes: their places are told by a square table
        pairs = np.arange(_FIRST * _FIRST)
        self.first_rank, self.first_slot = self._find(pairs // _FIRST, pairs % _FIRST)
        self.first_slot = self.first_slot.astype(np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = self._slot(keys)
        rank, where = np.full(len(keys), _NONE), slot
        held = self.keys[slot]
        hit = held == keys
        rank[hit] = self.rank[slot[hit]]
        wait = np.flatnonzero(~hit & (held != np.uint64(2**64 - 1)))
        where = slot.copy()
        for _ in range(self.probes):
            if not len(wait):
                break
            where[wait] = (where[wait] + 1) & (len(self.keys) - 1)
            held = self.keys[where[wait]]
            hit = held == keys[wait]
            rank[wait[hit]] = self.rank[where[wait[hit]]]
            wait = wait[~hit & (held != np.uint64(2**64 - 1))]
        return rank, where

    def merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """One word after all merges, in n log n steps: a heap of (rank, place), symbols linked to their neighbours."""
        if self.pairs is None:
            used = self.rank < _NONE
            self.pairs = dict(zip(self.keys[used].tolist(), zip(self.rank[used].tolist(), self.merged[used].tolist(), strict=True), strict=True))
        pairs, n = self.pairs, len(symbols)
        rank, _ = self._find(symbols[:-1], symbols[1:])
        places = np.flatnonzero(rank < _NONE)
        heap = ((rank[places] << 32) | places).tolist()
        heapify(heap)
        own, after, before = symbols.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = heappop(heap)
            at = top & 0xFFFFFFFF
            right = after[at]
            if own[at] < 0 or right == n:
                continue
            found = pairs.get((own[at] << 32) | own[right])
            if found is None or found[0] != top >> 32:
                continue  # one of the two has been merged meanwhile
            own[at], own[right] = found[1], -1
            right = after[at] = after[right]
            if right < n:
                before[right] = at
                if (found := pairs.get((own[at] << 32) | own[right])) is not None:
                    heappush(heap, (found[0] << 32) | at)
            left = before[at]
            if left >= 0 and (found := pairs.get((own[left] << 32) | own[at])) is not None:
                heappush(heap, (found[0] << 32) | left)
        out = np.array(own, np.int32)
        return out[out >= 0]

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words laid end to end and their lengths (all at least 1) -> the same after all merges."""
        n = len(lengths)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        symbols, words = symbols.astype(np.int32), np.arange(n)
        lengths = lengths.astype(np.int64)
        long = lengths > LONG_WORD
        if long.any():
            ends = np.cumsum(lengths)
            for w in np.flatnonzero(long).tolist():
                merged = self.merge_long(symbols[ends[w] - lengths[w] : ends[w]])
                done.append((np.array([w]), np.array([len(merged)]), merged))
            symbols, words, lengths = symbols[np.repeat(~long, lengths)], words[~long], lengths[~long]
        rank = slot = None
        while len(words):
            starts = np.cumsum(lengths) - lengths
            if rank is None:
                rank = np.full(len(symbols), _NONE)
                slot = np.zeros(len(symbols), np.int64)
                if len(symbols) > 1 and int(symbols.max()) < _FIRST:
                    pair = symbols[:-1] * np.int32(_FIRST) + symbols[1:]
                    rank[:-1], slot[:-1] = self.first_rank[pair], self.first_slot[pair]
                elif len(symbols) > 1:
                    rank[:-1], slot[:-1] = self._find(symbols[:-1], symbols[1:])
                rank[starts + lengths - 1] = _NONE
            least = np.minimum.reduceat(rank, starts)
            live = least < _NONE
            if not live.all():
                keep = np.repeat(live, lengths)
                over = ~keep
                done.append((words[~live], lengths[~live], symbols[over]))
                words, lengths, symbols, rank, slot, least = words[live], lengths[live], symbols[keep], rank[keep], slot[keep], least[live]
                if not len(words):
                    break
                starts = np.cumsum(lengths) - lengths
            hits = np.flatnonzero(rank == np.repeat(least, lengths))
            _, first = np.unique(np.searchsorted(starts, hits, "right"), return_index=True)
            at = hits[first]  # one merge a word
            symbols[at] = self.merged[slot[at]]
            gone = np.ones(len(symbols), bool)
            gone[at + 1] = False
            rank[at] = rank[at + 1]  # the end of a word stays an end
            last = rank[at + 1] == _NONE
            shift = np.arange(len(at))
            symbols, rank, slot = symbols[gone], rank[gone], slot[gone]
            at = at - shift
            lengths = lengths - 1
            starts = np.cumsum(lengths) - lengths
            ends = starts + lengths - 1
            # new pairs: the merged symbol with its right and its left neighbour
            right = at[at < ends]
            rank[right], slot[right] = self._find(symbols[right], symbols[right + 1])
            rank[at[at == ends]] = _NONE
            left = at[at > starts] - 1
            rank[left], slot[left] = self._find(symbols[left], symbols[left + 1])
            del last
        out_lengths = np.zeros(n, np.int64)
        for w, size, _ in done:
            out_lengths[w] = size
        out = np.zeros(int(out_lengths.sum()), np.int32)
        begins = np.cumsum(out_lengths) - out_lengths
        for w, size, s in done:
            place = np.repeat(begins[w] - (np.cumsum(size) - size), size) + np.arange(len(s))
            out[place] = s
        return out, out_lengths
