"""Token counts of texts under a unigram vocabulary, by dynamic programming that a trie shares between pre-tokens.

Distinct pre-tokens (a word with the space mark in front) of a batch of texts make a trie: in sorted order, a prefix is a node where it is not one of the
pre-token before. The best segmentation of a prefix depends on the prefix alone, so its forward score and number of pieces are computed once, in
numpy for all nodes of a depth at once, whichever pre-tokens continue it; the node where a pre-token ends gives its count. The pieces that end at
a node are those of its state in the Aho-Corasick automaton of the vocabulary. Pre-tokens of more than LONG bytes are inserted one by one in a trie that a worker
keeps between batches, up to a bound.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from looploom.llm.text import keep, table

VOCABULARY = "piece_bpe_32k.model"
SPACE = "▁"
#: Nodes of a worker's trie of long pre-tokens; beyond them it starts anew.
NODES = 600_000
#: Longer words (bytes) are inserted one by one. So many shorter ones are taken at once, of so many texts and, but for a single longer text, bytes.
LONG, BLOCK, BATCH_ROWS, BATCH_BYTES = 64, 1 << 15, 1024, 4_000_000
#: What a character outside the vocabulary costs beside the lowest score; it is as many tokens as it has UTF-8 bytes.
UNKNOWN = 10.0
#: Scores that a vocabulary gives to pieces that no text may yield (runs of spaces).
UNREACHABLE = -1e8


def log_probabilities(scores: dict[str, float]) -> dict[str, float]:
    """Unigram log-probabilities of pieces whose scores are negative ranks (0, -1, -2, ..., as in files of merges), by Zipf's law: the
    probability of rank r is 1 / (r + 1) over the sum of these. Scores that are no ranks, as in files of unigrams, are log-probabilities
    already. Pieces that no text may yield keep their scores."""
    usual = {p: s for p, s in scores.items() if s > UNREACHABLE}
    if not usual or any(s > 0 or s != int(s) for s in usual.values()):
        return scores
    total = math.log(sum(1 / (1 - s) for s in usual.values()))
    return {p: -math.log(1 - s) - total if s > UNREACHABLE else s for p, s in scores.items()}


#: Bytes of the character that a byte begins; 0 where it continues one.
_WIDTH = np.array([1 if b < 0x80 else 0 if b < 0xC0 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4 for b in range(256)], np.uint8)


class Pieces:
    """The Aho-Corasick automaton of pieces, over their UTF-8 bytes. State 0 is the empty string; ``next`` has a column for each byte of
    ``columns`` (0: in no piece), ``first`` the longest suffix of a state that is a piece, as a state (0: none), ``link`` the longest proper one,
    ``size`` and ``score`` the bytes and the score of states that are pieces."""

    def __init__(self, pieces: dict[str, float]):
        child: dict[tuple[int, int], int] = {}
        ends = []
        for p in pieces:
            state = 0
            for b in p.encode():
                state = child.setdefault((state, b), len(child) + 1)
            ends.append(state)
        n = len(child) + 1
        self.columns = np.zeros(256, np.uint8)
        used = sorted({b for _, b in child})
        self.columns[used] = np.arange(1, len(used) + 1)
        self.size, self.score = np.zeros(n, np.int64), np.zeros(n)
        self.size[ends], self.score[ends] = [len(p.encode()) for p in pieces], list(pieces.values())
        edges = np.array([(a, b) for a, b in child], np.int64).reshape(-1, 2)
        above, column, below = edges[:, 0], self.columns[edges[:, 1]], np.arange(1, n)
        depth = np.zeros(n, np.int64)
        for a, b in zip(above.tolist(), below.tolist(), strict=True):  # a state's number is above that of the one before it
            depth[b] = depth[a] + 1
        self.next, fail = np.zeros((n, len(used) + 1), np.int32), np.zeros(n, np.int64)
        self.first, self.link = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.next[0, column[above == 0]] = below[above == 0]
        for d in range(1, int(depth.max()) + 1):
            at = np.flatnonzero(depth == d)
            self.link[at] = self.first[fail[at]]
            self.first[at] = np.where(self.size[at] > 0, at, self.link[at])
            self.next[at] = self.next[fail[at]]
            e = np.flatnonzero(depth[above] == d)
            fail[below[e]] = self.next[above[e], column[e]]
            self.next[above[e], column[e]] = below[e]


class Trie:
    """Forward scores and piece counts of prefixes.

    Node 0 is the empty prefix. A prefix's score is the best over its last piece: the score of the prefix before that piece plus the
    piece's; of equal scores the one of fewer pieces wins.
    """

    def __init__(self, pieces: dict[str, float], nodes: int = NODES):
        self.pieces, self.most = pieces, nodes
        self.longest = max(map(len, pieces), default=1)
        self.unknown = min((s for s in pieces.values() if s > UNREACHABLE), default=0.0) - UNKNOWN
        # for each last character, the lengths of pieces that end in it: others need no look-up
        ends: dict[str, set[int]] = {}
        for p in pieces:
            ends.setdefault(p[-1], set()).add(len(p))
        self.ends = {c: sorted(n) for c, n in ends.items()}
        self.automaton = Pieces(pieces)
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.score, self.count, self.terminal = [0.0], [0], {}

    @classmethod
    def of(cls, file: str) -> Trie:
        """The trie of this process for a vocabulary file (a name of the public collection, or a path)."""

        def made() -> Trie:
            import public_tokenizers
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=file if os.path.isabs(file) else public_tokenizers.path(file))
            usual = (i for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i)))
            return cls(log_probabilities({sp.id_to_piece(i): sp.get_score(i) for i in usual}))

        return keep(("trie", file), made)

    def insert(self, token: str) -> int:
        """The number of tokens of a pre-token."""
        child, score, count, pieces, node, path = self.child, self.score, self.count, self.pieces, 0, [0]
        for k, c in enumerate(token, 1):
            below = child.get((node, c))
            if below is None:
                best, fewest = score[node] + self.unknown, count[node] + len(c.encode())
                for n in self.ends.get(c, ()):
                    if n > k:
                        break
                    s = pieces.get(token[k - n : k])
                    if s is not None:
                        s, m = s + score[path[k - n]], count[path[k - n]] + 1
                        if s > best or s == best and m < fewest:
                            best, fewest = s, m
                below = child[node, c] = len(score)
                score.append(best)
                count.append(fewest)
            node = below
            path.append(node)
        self.terminal[token] = count[node]
        return count[node]

    def count_texts(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        """Words and tokens of each text."""
        words, tokens = self.count_array(pa.array(texts, pa.large_string()))
        return words.tolist(), tokens.tolist()

    def count_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`count_texts`, for an array of large strings."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        different = lists.flatten().dictionary_encode()
        tokens, at = self.count_words(different.dictionary), different.indices.to_numpy()
        cuts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        # what is split off before the first and after the last white space may be empty: no word, no tokens
        return tuple(np.diff(np.r_[0, np.cumsum(x[at], dtype=np.int64)][cuts]) for x in (tokens > 0, tokens))

    def count_words(self, words: pa.Array) -> np.ndarray:
        """The number of tokens of each of some different words; none for an empty one."""
        size = pc.binary_length(words).to_numpy().astype(np.int64)
        out = np.zeros(len(words), np.int64)
        for i in np.flatnonzero(size > LONG).tolist():
            if len(self.score) > self.most:
                self.clear()
            token = SPACE + words[i].as_py()
            out[i] = self.terminal[token] if token in self.terminal else self.insert(token)
        order = pc.sort_indices(words).to_numpy()
        order = order[(size[order] > 0) & (size[order] <= LONG)]
        for k in range(0, len(order), BLOCK):
            at = order[k : k + BLOCK]
            _, offsets, data = words.take(pa.array(at)).cast(pa.large_binary()).buffers()
            offsets = np.frombuffer(offsets, np.int64)[: len(at) + 1]
            out[at] = self._count(np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], np.diff(offsets))
        return out

    def _count(self, data: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of tokens of words in order, given as bytes one after another with the length of each (1 at least)."""
        mark, auto, n = np.frombuffer(SPACE.encode(), np.uint8), self.automaton, len(size)
        size = size + len(mark)
        most = int(size.max())
        rows = np.zeros((n, most), np.uint8)
        rows[:, : len(mark)] = mark
        rows[:, len(mark) :][np.arange(len(mark), most) < size[:, None]] = data
        # bytes that a pre-token shares with the one before: its nodes are the prefixes beyond them
        other = rows[1:] != rows[:-1]
        shared = np.r_[0, np.minimum(np.where(other.any(axis=1), other.argmax(axis=1), most), size[:-1])]
        rows = np.ascontiguousarray(rows.T)
        column, width = auto.columns[rows], _WIDTH[rows]
        whole = np.zeros((most + 1, n), np.uint8)  # bytes of the character that ends at a place
        for w in range(1, min(4, most) + 1):
            whole[w:][width[: most - w + 1] == w] = w
        # by depth and pre-token: score, tokens and state of the prefix
        score, count, state = np.zeros((most + 1) * n), np.zeros((most + 1) * n, np.int64), np.zeros((most + 1) * n, np.int32)
        live = np.arange(n)
        for k in range(1, most + 1):
            live = live.compress(size.take(live) >= k)
            new = shared.take(live) < k
            i = live.compress(new)
            s = auto.next[state.take(i + (k - 1) * n), column[k - 1].take(i)]
            c = whole[k].take(i).astype(np.int64)
            before = i + (k - c) * n
            best, fewest = np.where(c > 0, score.take(before) + self.unknown, -np.inf), count.take(before) + c
            piece = auto.first.take(s)
            at = np.flatnonzero(piece)
            while len(at):
                piece = piece.compress(piece > 0)
                before = i.take(at) + (k - auto.size.take(piece)) * n
                x, m, b = auto.score.take(piece) + score.take(before), count.take(before) + 1, best.take(at)
                better = (x > b) | ((x == b) & (m < fewest.take(at)))
                w = at.compress(better)
                best[w], fewest[w] = x.compress(better), m.compress(better)
                piece = auto.link.take(piece)
                at = at.compress(piece > 0)
            node, to = np.cumsum(new) - 1, live + k * n
            score[to], count[to], state[to] = best.take(node), fewest.take(node), s.take(node)
        return count.take(size * n + np.arange(n))


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """``texts`` in slices of up to BATCH_ROWS texts and, but for a single longer text, BATCH_BYTES bytes."""
    start = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > start and (i - start >= BATCH_ROWS or size + n > BATCH_BYTES):
            yield texts.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < len(texts):
        yield texts.slice(start)


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(``doc_id``, ``n_words``, ``n_tokens``) of each row of ``docs`` (``doc_id``, ``text``; other columns are ignored).

    Tokens are those of the segmentation of each word, space mark in front, with the highest sum of log-probabilities (see
    :func:`log_probabilities`). Null and empty texts have none; rows without a doc_id and repeated rows are counted like any other; equal
    texts count alike; whole texts are counted, whatever their length; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie.of(vocabulary)
        for b in batches:
            got = [trie.count_array(x) for x in _slices(b.column(1).cast(pa.large_string()))]
            if got:
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(np.concatenate(x)) for x in zip(*got, strict=True)]], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and tokens of every document; see :func:`count_tokens`."""
    return count_tokens(table(spark, sf_dir, "documents"))
