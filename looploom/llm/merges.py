"""Byte-pair encoding of many pre-tokens at once, in numpy: a step makes the next merge of each of them.

As in the library, the next merge of a pre-token is the one of lowest rank among its neighbours, and the first of equal ones.
"""

from __future__ import annotations

import numpy as np

#: Rank of a pair that is not merged, and a key that no pair has.
NONE, EMPTY = np.int32(1 << 30), np.uint32(0xFFFFFFFF)
#: log2 of the slots of the table of pairs.
SLOTS = 18
#: So many pre-tokens are taken at once, as they fit a core's cache.
BLOCK = 1 << 14


class Merges:
    """The merges of a vocabulary: ``first`` and ``last`` are the ids of each byte inside a pre-token and at its end."""

    def __init__(self, first: np.ndarray, last: np.ndarray, pairs: np.ndarray, merged: np.ndarray):
        self.first, self.last, self.merged = first.astype(np.int32), last.astype(np.int32), merged.astype(np.int32)
        # open addressing: a pair is in the first slot from its own on that was free
        self.keys, self.ranks = np.full(1 << SLOTS, EMPTY), np.full(1 << SLOTS, NONE)
        key, rank = self._key(pairs[:, 0], pairs[:, 1]), np.arange(len(pairs), dtype=np.int32)
        slot = self._slot(key)
        while len(key):
            _, i = np.unique(slot, return_index=True)
            i = i[self.keys[slot[i]] == EMPTY]
            self.keys[slot[i]], self.ranks[slot[i]] = key[i], rank[i]
            left = np.ones(len(key), bool)
            left[i] = False
            key, rank, slot = key[left], rank[left], slot[left] + 1 & (1 << SLOTS) - 1

    @classmethod
    def of(cls, model: dict, letters: dict[int, str]) -> Merges | None:
        """The merges of a BPE model as its file gives it, ``letters`` being what it writes for each byte; None if it has others than plain merges."""
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            return None
        ids, end = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        used = {s for a, b in pairs for s in (a, b, a + b)} | {x + e for x in letters.values() for e in ("", end)}
        if not used <= ids.keys() or len(set(pairs)) < len(pairs) or 3 * len(pairs) > 1 << SLOTS or max(ids.values()) >= 1 << 16:
            return None
        each = lambda e: np.array([ids[letters[k] + e] for k in range(256)])
        return cls(each(""), each(end), np.array([(ids[a], ids[b]) for a, b in pairs]).reshape(-1, 2), np.array([ids[a + b] for a, b in pairs]))

    def _key(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.astype(np.uint32) << np.uint32(16) | b.astype(np.uint32)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key * np.uint32(0x9E3779B1) >> np.uint32(32 - SLOTS)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE if it is not merged."""
        key = self._key(a, b)
        slot = self._slot(key)
        found = self.keys.take(slot)
        out = self.ranks.take(slot)
        at = np.flatnonzero((found != key) & (found != EMPTY))
        out[found == EMPTY] = NONE
        key, slot = key[at], slot[at]
        while len(at):
            slot = slot + 1 & (1 << SLOTS) - 1
            found = self.keys.take(slot)
            out[at] = np.where(found == key, self.ranks.take(slot), NONE)
            more = np.flatnonzero((found != key) & (found != EMPTY))
            at, key, slot = at[more], key[more], slot[more]
        return out

    def encode(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, given as bytes one after another with the length of each (1 at least), and how many ids each has."""
        ends = np.r_[0, np.cumsum(size)]
        done = [self._encode(data[ends[i] : ends[min(i + BLOCK, len(size))]], size[i : i + BLOCK]) for i in range(0, len(size), BLOCK)]
        return np.concatenate([np.zeros(0, np.uint32), *[x for x, _ in done]]), np.concatenate([np.zeros(0, np.int64), *[n for _, n in done]])

    def _encode(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum(size)
        out, n_out, to = np.zeros(len(data), np.uint32), np.zeros(len(size), np.int64), ends - size
        ids = self.first.take(data)
        ids[ends - 1] = self.last.take(data[ends - 1])
        rank = np.full(len(ids), NONE)
        rank[:-1] = self.rank(ids[:-1], ids[1:])
        rank[ends - 1] = NONE
        which, n, start = np.arange(len(size)), size.astype(np.int64), to
        while len(n):
            least = np.minimum.reduceat(rank, start)
            done = least == NONE
            if done.any():
                gone, w = np.repeat(done, n), which[done]
                k = n[done]
                n_out[w] = k
                out[np.arange(k.sum()) + np.repeat(to[w] - np.cumsum(k) + k, k)] = ids[gone]
                np.logical_not(gone, out=gone)
                np.logical_not(done, out=done)
                ids, rank, which, n, least = ids.compress(gone), rank.compress(gone), which.compress(done), n.compress(done), least.compress(done)
                if not len(n):
                    break
                start = np.cumsum(n) - n
            # the first place of the least rank in each; all have one
            at = np.flatnonzero(rank == np.repeat(least, n))
            if len(at) > len(n):
                at = at[np.searchsorted(at, start)]
            ids[at] = self.merged.take(least)
            stays = np.ones(len(ids), bool)
            stays[at + 1] = False
            # a place's rank is that of its pair with the next; the one that goes leaves its own to be found anew
            ids, rank = ids.compress(stays), rank.compress(stays)
            at -= np.arange(len(at))
            n -= 1
            ends = np.cumsum(n)
            start = ends - n
            here = at < ends - 1
            rank[at] = NONE
            p = at.compress(here)
            rank[p] = self.rank(ids.take(p), ids.take(p + 1))
            p = at.compress(at > start)
            rank[p - 1] = self.rank(ids.take(p - 1), ids.take(p))
        return out[np.arange(n_out.sum()) + np.repeat(to - np.cumsum(n_out) + n_out, n_out)], n_out
