"""Language-model scores: masked pseudo-likelihood of a bidirectional window network, in numpy.

Each token is predicted from the two tokens on either side, itself masked; a text's score is the sum of the conditional log-probabilities of all
its tokens. Tokens are lower-cased words: the most frequent of the whole corpus stand for themselves, others are predicted by their ending
(hashed) and then by their share of the ending's words. The output is a two-level softmax (class, then token in class) with that share as a third
level, so probabilities are exact and sum to one.

What is gathered from the corpus grows with it: word counts of all texts make the vocabulary (all words of LEAST or more, with classes to match),
the starting biases and the shares. Texts are cut into token numbers once, for all rounds and scores; training is data-parallel, each
partition training on every place of all its texts once, half of them in each of two rounds, and the weights of the partitions are averaged in a tree of bounded fan-in.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from looploom.llm.text import free, table
from looploom.tables import materialize

#: Least numbers of classes of the softmax and tokens in each; words that stand for themselves; the rest are endings. One row more is the edge of a text.
CLASSES = INSIDE = 64
TOKENS = CLASSES * INSIDE
OWN = 3072
ENDINGS = TOKENS - OWN
EDGE = TOKENS
#: Words of so many finds all stand for themselves; beyond OWN of them classes and tokens in each are more than 64.
LEAST = 1000
#: Up to so many counts of other words (12 bytes each) are sent to the workers; more are joined.
BROADCAST_WORDS = 2_000_000
SIDES = (-2, -1, 1, 2)
DIM, BATCH, SEED = 16, 1024, 5
#: Learning rates of the rounds; in each, one place of SHARE is trained on, so the rounds together train on every place.
ROUNDS, SHARE = (0.08, 0.03), 2
#: Models that one task averages, and endings that a worker remembers.
FAN_IN, REMEMBERED = 16, 200_000
#: Exponentials of logits up to this, either way, and sums of many of them are whole in single precision.
SAFE = 60
#: Classes whose weights a step changes at once, as they fit a core's cache.
AT_ONCE = 8
#: Texts whose words are parted at once, places that are scored at once, in the order of their classes, and those whose logits are there at once.
TEXTS = 1 << 12
PLACES = 1 << 15
ROWS = 1 << 10
#: Gradients of a token met up to so often in a batch are added one by one.
FEW = 4


def ending(word: str) -> int:
    return zlib.crc32(word[-3:].encode()) % ENDINGS


def _words(texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of the texts, and how many each text has. They are parted at the characters U+0009 to U+000D and spaces, and nowhere else."""
    parts = pc.ascii_split_whitespace(pa.array([(t or "").lower() for t in texts], pa.string()))
    found = parts.flatten()
    some = pc.not_equal(found, "")
    upto = np.r_[0, np.cumsum(some.to_numpy(zero_copy_only=False), dtype=np.int64)]
    return found.filter(some), np.diff(upto[parts.offsets.to_numpy()])


def _order(values: np.ndarray, below: int) -> np.ndarray:
    """Stable order of numbers from 0 to ``below``, by their digits of 16 bits, which is much faster."""
    order = np.argsort(values.astype(np.uint16), kind="stable")
    return order if below <= 1 << 16 else order[_order(values[order] >> 16, below + 0xFFFF >> 16)]


def _peak(a: np.ndarray) -> np.ndarray:
    """The largest of each row, as a column: by halves, which is faster than a row at a time."""
    while a.shape[1] > 8 and a.shape[1] % 2 == 0:
        a = np.maximum(a[:, : a.shape[1] // 2], a[:, a.shape[1] // 2 :])
    return a.max(axis=1, keepdims=True)


def _lower(a: np.ndarray) -> None:
    """Take the largest of each row off it, if any logit is so large that its exponential is not safe."""
    if a.size and not (a.max() < SAFE and a.min() > -SAFE):
        a -= _peak(a)


def _bound(layer: np.ndarray) -> float:
    """What no logit of a layer with its biases exceeds, either way: hidden values are from -1 to 1."""
    return float(np.abs(layer).sum(axis=-2).max())


def _sums(a: np.ndarray) -> np.ndarray:
    """The sum of each row: a product, which is faster."""
    return a @ np.ones(a.shape[1], a.dtype)


def _powers(a: np.ndarray) -> np.ndarray:
    """Turn logits into their exponentials, up to a factor of each row, and return the sum of each row."""
    _lower(a)
    return _sums(np.exp(a, out=a))


def _softmax(a: np.ndarray, by: float = 1) -> np.ndarray:
    """The softmax of each row over ``by``, in place."""
    n = _powers(a)
    n *= by
    a *= np.reciprocal(n, out=n)[:, None]
    return a


def _errors(a: np.ndarray, rows: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Turn logits into gradients of a mean over ``n`` places, of which ``rows`` have their token ``at`` a place: of each row, up to a factor.

    Returns the probabilities of the tokens and the factors, as a column: fewer values are to be multiplied by them later.
    """
    total = _powers(a)
    of, whole = a[rows, at], total.take(rows)
    a[rows, at] = of - whole
    of /= whole
    total *= n
    return of, np.reciprocal(total, out=total)[:, None]


def _totals(rows: np.ndarray, values: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``rows`` (numbers up to ``below``), and the sum of each one's ``values``, which repeat as often as ``rows`` is longer than they are."""
    order = _order(rows, below)
    r, at = rows[order], order % len(values)
    new = np.ones(len(r) + 1, bool)
    np.not_equal(r[1:], r[:-1], out=new[1:-1])
    first = np.flatnonzero(new)
    count, first = first[1:] - first[:-1], first[:-1]
    out = values.take(at.take(first), axis=0)
    for k in range(1, FEW):
        some = np.flatnonzero((count > k) & (count <= FEW))
        if len(some):
            out[some] += values.take(at.take(first[some] + k), axis=0)
    many = count > FEW
    if many.any():
        ends = np.cumsum(count[many])
        out[many] = np.add.reduceat(values.take(at[np.repeat(many, count)], axis=0), ends - count[many], axis=0)
    return r.take(first), out


def _parts(a: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """``a`` in pieces of these sizes."""
    ends = np.cumsum(size).tolist()
    return [a[i:j] for i, j in zip([0, *ends], ends)]


def _summed(a: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The sum of each piece of ``a``."""
    total, ends = np.r_[0.0, np.cumsum(a, dtype=np.float64)], np.cumsum(size)
    return total[ends] - total[ends - size]


class _Endings(dict):
    """Token numbers of endings (UTF-8), which follow those of ``own`` words, made when they are first met; begun anew beyond a bound."""

    def __init__(self, own: int):
        self.own = own

    def __missing__(self, end: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self[end] = self.own + zlib.crc32(end) % ENDINGS
        return n


class Model:
    """Weights: ``E`` (sides, tokens + edge, DIM), ``b`` (DIM), class layer ``C``, ``c`` and inner layers ``T``, ``t``.

    ``ended`` has the finds of each ending's words. ``counts`` (``h``, ``log_count``) has the words of two finds or more that don't stand for
    themselves, as a table of the driver; ``known`` the same as sorted arrays, or None where they are too many. A word that is not there has one
    find, as has the unseen word that each ending keeps a share for.
    """

    NAMES = ("E", "b", "C", "c", "T", "t")

    def __init__(self, vocabulary: list[str], weights: dict[str, np.ndarray]):
        self.own, self.w = {w: i for i, w in enumerate(vocabulary)}, weights
        self.classes, self.inside = weights["t"].shape
        self.edge = self.classes * self.inside
        self.first = self.edge - ENDINGS
        self.ends, self.listed = _Endings(self.first), pa.array(vocabulary, pa.string())
        self.ended, self.known, self.counts = np.zeros(ENDINGS), None, None
        #: How token numbers are stored.
        self.stored = "<u2" if self.edge <= 1 << 16 else "<u4"

    def __getstate__(self) -> dict:
        return self.__dict__ | {"counts": None}

    @property
    def joins(self) -> bool:
        """Whether counts of other words are joined (asked of the driver's model, which has the table)."""
        return self.known is None and self.counts is not None

    @staticmethod
    def start(frequency: np.ndarray, seed: int = SEED) -> dict[str, np.ndarray]:
        """Random weights, biases from the frequency of each token."""
        r = np.random.default_rng(seed)
        p = (frequency + 0.5) / (frequency + 0.5).sum()
        k = math.isqrt(len(p))
        by = p.reshape(k, k).sum(axis=1)
        n = lambda *s: (r.standard_normal(s) * 0.1).astype(np.float32)
        return {"E": n(len(SIDES), k * k + 1, DIM), "b": np.zeros(DIM, np.float32), "C": n(DIM, k), "c": np.log(by).astype(np.float32), "T": n(k, DIM, k), "t": np.log(p.reshape(k, k) / by[:, None]).astype(np.float32)}

    def to_bytes(self) -> bytes:
        return b"".join(self.w[k].astype("<f4").tobytes() for k in self.NAMES)

    @staticmethod
    def from_bytes(data: bytes, k: int) -> dict[str, np.ndarray]:
        shapes = ((len(SIDES), k * k + 1, DIM), (DIM,), (DIM, k), (k,), (k, DIM, k), (k, k))
        flat, out, at = np.frombuffer(data, "<f4"), {}, 0
        for k, s in zip(Model.NAMES, shapes, strict=True):
            out[k] = flat[at : at + int(np.prod(s))].reshape(s).copy()
            at += int(np.prod(s))
        return out

    def cut(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of words of each text, and of all places: the token, the word's log-share in it, and its hash (0 for words that stand for themselves)."""
        found, size = _words(texts)
        coded = found.dictionary_encode()
        different, at = coded.dictionary, coded.indices.to_numpy()
        token = pc.index_in(different, self.listed).fill_null(-1).to_numpy().astype(np.int64)
        other = token < 0
        rest = different.filter(pa.array(other))
        end = pc.utf8_slice_codeunits(rest, -3).dictionary_encode()
        token[other] = np.array([self.ends[x] for x in end.dictionary.cast(pa.binary()).to_pylist()], np.int64)[end.indices.to_numpy()]
        hashes = np.zeros(len(token), np.int64)
        # an array of objects, made at once
        hashes[other] = np.array([xxhash.xxh64_intdigest(x, 42) for x in rest.cast(pa.binary()).to_numpy(zero_copy_only=False)], np.uint64).view(np.int64)
        return size, token[at], self.share(token, hashes[other])[at], hashes[at]

    def tokens(self, texts: list[str | None]) -> list[np.ndarray]:
        """Token numbers of each text."""
        size, token, _, _ = self.cut(texts)
        return _parts(token, size)

    def share(self, token: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Log-share of each word in its token: 0 for words that stand for themselves. Without ``known``, the log-counts are left out."""
        out, other = np.zeros(len(token)), token >= self.first
        out[other] = -np.log1p(self.ended[token[other] - self.first])
        if self.known is not None and len(self.known[0]) and len(others):
            at = np.minimum(np.searchsorted(self.known[0], others), len(self.known[0]) - 1)
            out[other] += np.where(self.known[0][at] == others, self.known[1][at], 0)
        return out

    def sides(self, texts: list[np.ndarray], first: int = 0, share: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Places of the texts, one in ``share`` from ``first``: the token there, and (sides, places) the tokens around it (the edge beyond a text)."""
        gap = np.full(2, self.edge)
        flat = np.concatenate([gap, *[x for t in texts for x in (t, gap)]])
        size = np.array([len(t) for t in texts], np.int64)
        place = (np.arange(size.sum()) + np.repeat(2 + 2 * np.arange(len(texts)), size))[first::share]
        return flat[place], np.stack([flat[place + s] for s in SIDES])

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """The class layer and the inner layers, the biases of each as its last row."""
        return tuple(np.concatenate([self.w[a], self.w[b][..., None, :]], axis=-2) for a, b in (("C", "c"), ("T", "t")))

    def hidden(self, around: np.ndarray) -> np.ndarray:
        """Hidden values of places, and a column of ones for the biases."""
        e = self.w["E"]
        a = e[0].take(around[0], axis=0)
        for k in range(1, len(SIDES)):
            a += e[k].take(around[k], axis=0)
        a += self.w["b"]
        out = np.ones((len(a), DIM + 1), a.dtype)
        np.tanh(a, out=out[:, :DIM])
        return out

    def log_probability(self, token: np.ndarray, around: np.ndarray, layers: tuple[np.ndarray, np.ndarray] | None = None, safe: bool = False) -> np.ndarray:
        """Log-probability of each token given those around it; ``layers`` are those of :meth:`joined`, ``safe`` if their bounds are below SAFE."""
        outer, inside = layers or self.joined()
        kind, order, ends = self._by_class(token)
        rows, inner = np.arange(len(token)), token[order] % self.inside
        around, at, k = around.take(order, axis=1), ends.tolist(), 0
        logp = np.zeros(len(token), outer.dtype)
        for i in range(0, len(token), ROWS):
            # all of some rows in one go, as they fit a core's cache
            to = min(i + ROWS, len(token))
            h = self.hidden(around[:, i:to])
            self._add(logp[i:to], h @ outer, rows[: to - i], kind[i:to], safe)
            a, begun = np.empty((to - i, self.inside), h.dtype), i
            while begun < to:
                while at[k + 1] <= begun:
                    k += 1
                done = min(at[k + 1], to)
                h[begun - i : done - i].dot(inside[k], a[begun - i : done - i])
                begun = done
            self._add(logp[i:to], a, rows[: to - i], inner[i:to], safe)
        out = np.empty_like(logp)
        out[order] = logp
        return out

    @staticmethod
    def _add(logp: np.ndarray, a: np.ndarray, rows: np.ndarray, at: np.ndarray, safe: bool) -> None:
        """Add the log-probabilities that the logits of each row give what is ``at`` a place in it."""
        if not safe:
            _lower(a)
        logp += a[rows, at]
        logp -= np.log(_sums(np.exp(a, out=a)))

    def _by_class(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Classes of the tokens in ascending order, the order, and where each class begins and the last ends."""
        kind = token // self.inside
        order = _order(kind, self.classes)
        kind = kind[order]
        return kind, order, np.searchsorted(kind, np.arange(self.classes + 1))

    def _inside(self, h: np.ndarray, inside: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Inner logits of places in the order of their classes."""
        a = np.empty((len(h), self.inside), h.dtype)
        at = ends.tolist()
        for k in np.flatnonzero(np.diff(ends)).tolist():
            h[at[k] : at[k + 1]].dot(inside[k], a[at[k] : at[k + 1]])
        return a

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and summed log-probability of each text."""
        size, token, share, _ = self.cut(texts)
        return size, self.score_tokens(_parts(token, size))[1] + _summed(share, size)

    def score_tokens(self, ids: list[np.ndarray], places: int = PLACES) -> tuple[np.ndarray, np.ndarray]:
        """Number and summed log-probability of the tokens of each text, without the shares of words in them."""
        size = np.array([len(t) for t in ids], np.int64)
        token, around = self.sides(ids)
        layers = self.joined()
        safe = max(map(_bound, layers)) < SAFE
        logp = [self.log_probability(token[i : i + places], around[:, i : i + places], layers, safe) for i in range(0, len(token), places)]
        return size, _summed(np.concatenate([np.zeros(0), *logp]), size)

    def gradients(self, token: np.ndarray, around: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Mean negative log-probability, gradients of all weights but E, and that of the hidden sum (for E)."""
        layers = self.joined()
        inside = np.zeros_like(layers[1])

        def each(k: int, some: np.ndarray) -> None:
            inside[k : k + len(some)] = some

        p, outer, order, _, dh = self.backward(token, around, layers, each)
        ds = np.empty_like(dh)
        ds[order] = dh
        return float(-np.log(p + 1e-30).mean()), {"C": outer[:DIM], "c": outer[DIM], "T": inside[:, :DIM], "t": inside[:, DIM], "b": ds.sum(axis=0)}, ds

    def backward(self, token: np.ndarray, around: np.ndarray, layers: tuple[np.ndarray, np.ndarray], each: Callable[[int, np.ndarray], None]) -> tuple[np.ndarray, ...]:
        """Of places in the order of their classes: probabilities; the gradient of the class layer; the order; the tokens around them; the gradients of the hidden sums.

        ``each`` gets the gradients of the inner layers, AT_ONCE classes at a time, with the number of the first; it may change them, and the layers of these classes.
        Classes without a place are left out where those beside them are.
        """
        n, rows = len(token), np.arange(len(token))
        kind, order, ends = self._by_class(token)
        around, inner = around.take(order, axis=1), token.take(order) % self.inside
        h, (outer, inside) = self.hidden(around), layers
        p = h @ outer
        of_kind, by = _errors(p, rows, kind, n)
        grad_outer, dh = (h * by).T @ p, p @ outer[:DIM].T
        dh *= by
        q = self._inside(h, inside, ends)
        of_inner, by = _errors(q, rows, inner, n)
        of_q, turned = np.empty((n, DIM), h.dtype), (h * by).T
        at, back = ends.tolist(), inside[:, :DIM].transpose(0, 2, 1)
        grad = np.empty((AT_ONCE, *inside.shape[1:]), h.dtype)
        for i in range(0, self.classes, AT_ONCE):
            to = min(i + AT_ONCE, self.classes)
            if at[i] == at[to]:
                continue
            for k in range(i, to):
                a, b = at[k], at[k + 1]
                if a == b:
                    grad[k - i] = 0
                    continue
                some = q[a:b]
                turned[:, a:b].dot(some, grad[k - i])
                some.dot(back[k], of_q[a:b])
            each(i, grad[: to - i])
        of_q *= by
        dh += of_q
        h = h[:, :DIM]
        dh *= 1 - h * h
        return of_kind * of_inner, grad_outer, order, around, dh


class Trainer:
    """Adagrad over batches of places."""

    def __init__(self, model: Model, rate: float):
        self.model, self.rate, self.places = model, rate, 0
        w = model.w
        self.layers = outer, inside = model.joined()
        # the model's own layers are parts of these
        w["C"], w["c"], w["T"], w["t"] = outer[:DIM], outer[DIM], inside[:, :DIM], inside[:, DIM]
        w["E"] = np.ascontiguousarray(w["E"])
        self.square = [np.full_like(v, 1e-3) for v in (w["b"], outer, inside, w["E"])]
        self.scratch = np.empty((AT_ONCE, *inside.shape[1:]), inside.dtype)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, token: np.ndarray, around: np.ndarray) -> None:
        self.held.append((token, around))
        if sum(len(t) for t, _ in self.held) >= BATCH:
            self.flush()

    def flush(self) -> None:
        if self.held:
            token, around = np.concatenate([t for t, _ in self.held]), np.concatenate([a for _, a in self.held], axis=1)
            self.held = []
            for i in range(0, len(token), BATCH):
                self._step(token[i : i + BATCH], around[:, i : i + BATCH])
                self.places += len(token[i : i + BATCH])

    def _change(self, w: np.ndarray, square: np.ndarray, g: np.ndarray, root: np.ndarray | None = None) -> None:
        root = np.multiply(g, g, root)
        np.add(square, root, square)
        np.sqrt(square, root)
        np.multiply(g, self.rate, g)
        np.divide(g, root, g)
        np.subtract(w, g, w)

    def _step(self, token: np.ndarray, around: np.ndarray) -> None:
        (b, outer, inside, squares), (own, (c, t)) = self.square, (self.model.w, self.layers)

        def each(k: int, g: np.ndarray) -> None:
            to = k + len(g)
            self._change(t[k:to], inside[k:to], g, self.scratch[: len(g)])

        _, grad, _, around, ds = self.model.backward(token, around, self.layers, each)
        self._change(own["b"], b, np.ones(len(ds), ds.dtype) @ ds)
        self._change(c, outer, grad)
        # the rows of all sides at once, whole
        e, s = own["E"].reshape(-1, DIM), squares.reshape(-1, DIM)
        r, g = _totals((around + len(e) // len(SIDES) * np.arange(len(SIDES))[:, None]).reshape(-1), ds, len(e))
        new = s.take(r, axis=0)
        now = e.take(r, axis=0)
        self._change(now, new, g)
        row = np.dtype((np.void, e.itemsize * DIM))
        s.view(row)[:, 0][r] = new.view(row)[:, 0]
        e.view(row)[:, 0][r] = now.view(row)[:, 0]


def _averaged(models: DataFrame) -> bytes | None:
    """Weighted mean of the models (``places``, ``weights``), FAN_IN at a time or so, read where they lie; None if there are none."""

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, places = 0.0, 0
        for b in batches:
            for n, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                total = total + n * np.frombuffer(data.as_buffer(), "<f4").astype(np.float64)
                places += n
        if places:
            yield pa.RecordBatch.from_arrays([pa.array([places], pa.int64()), pa.array([(total / places).astype("<f4").tobytes()], pa.binary())], ["places", "weights"])

    n = models.count()
    while n > 1:
        # coalesced parts of the table, so nothing is shuffled; each gives one model at most
        models = materialize(models.coalesce(-(-n // FAN_IN)).mapInArrow(mean, models.schema), "models")
        n = models.count()
    row = models.select("weights").first()
    return bytes(row["weights"]) if row else None


def vocabulary(docs: DataFrame, seed: int = SEED) -> Model:
    """An untrained model of ``docs`` (``text``): vocabulary, biases and shares from all words."""
    spark = docs.sparkSession

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free()
        for b in batches:
            for i in range(0, b.num_rows, TEXTS):
                n = _words(b.slice(i, TEXTS).column(0).to_pylist())[0].value_counts()
                yield pa.RecordBatch.from_arrays([n.field(0), n.field(1)], ["word", "count"])

    count = docs.select(F.col("text").cast("string")).mapInArrow(counted, "word string, count long")
    count = materialize(count.groupBy("word").agg(F.sum("count").alias("count")), "words")
    k = math.isqrt(max(OWN, count.where(F.col("count") >= LEAST).count()) + ENDINGS - 1) + 1
    first = k * k - ENDINGS
    top = [r["word"] for r in count.orderBy(F.desc("count"), "word").limit(first).select("word").collect()]
    own = spark.createDataFrame([(w, i) for i, w in enumerate(top)], "word string, i int")
    unit = F.coalesce("i", first + F.crc32(F.expr("right(word, 3)")) % ENDINGS)
    frequency = np.zeros(k * k)
    for r in count.join(F.broadcast(own), "word", "left").groupBy(unit.cast("int").alias("unit")).agg(F.sum("count").alias("n")).collect():  # a row a token at most
        frequency[r["unit"]] = r["n"]
    other = count.where("count > 1").join(F.broadcast(own), "word", "left_anti")
    other = materialize(other.select(F.xxhash64("word").alias("h"), F.log("count").alias("log_count")), "counts")
    model = Model(top, Model.start(frequency, seed))
    model.ended, model.counts = frequency[first:], other
    if other.count() <= BROADCAST_WORDS:
        t = other.toArrow()
        h, n = t.column("h").to_numpy(), t.column("log_count").to_numpy()
        order = np.argsort(h, kind="stable")
        model.known = h[order], n[order].astype(np.float32)
    return model


def _cut(batches: Iterator[pa.RecordBatch], model: Model, joined: bool) -> Iterator[pa.RecordBatch]:
    """The columns of :func:`encoded`, of batches of ids and texts."""
    for b in batches:
        for i in range(0, b.num_rows, TEXTS):
            rows = b.slice(i, TEXTS)
            size, token, share, hashes = model.cut(rows.column(1).to_pylist())
            out = [rows.column(0), pa.array([t.tobytes() for t in _parts(token.astype(model.stored), size)], pa.binary()), pa.array(_summed(share, size))]
            if joined:
                upto = np.r_[0, np.cumsum(token >= model.first)][np.r_[0, np.cumsum(size)]]
                out.append(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(hashes[token >= model.first])))
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "tokens", "share", "others"][: len(out)])


def _scores(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Scores of batches of :func:`encoded`; hashes of other words stay beside them."""
    for b in batches:
        for i in range(0, b.num_rows, 256):
            rows = b.slice(i, 256)
            n, s = model.score_tokens([np.frombuffer(x, model.stored) for x in rows.column(1).to_pylist()])
            out = [rows.column(0), pa.array(n), pa.array(s + rows.column(2).to_numpy()), *rows.columns[3:]]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "log_probability", "others"][: len(out)])


def encoded(docs: DataFrame, model: Model) -> DataFrame:
    """(``doc_id``, ``tokens``, ``share``) of each row of ``docs`` (``doc_id``, ``text``): token numbers, and the summed log-shares of words in
    their tokens; where word counts are joined, also ``others``, the hashes of words that don't stand for themselves."""
    shared, joined = docs.sparkSession.sparkContext.broadcast(model), model.joins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free()
        yield from _cut(batches, shared.value, joined)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, tokens binary, share double" + ", others array<long>" * joined)


def train(coded: DataFrame, model: Model, rounds: tuple[float, ...] = ROUNDS, share: int = SHARE) -> None:
    """Train ``model`` on ``coded`` (``tokens``), one place in ``share`` each round.

    Every place is trained on where there are ``share`` rounds or more.
    """
    kind = model.stored
    for number, rate in enumerate(rounds):
        shared = coded.sparkSession.sparkContext.broadcast(model.w)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, rate=rate, number=number) -> Iterator[pa.RecordBatch]:
            free()
            local = Model([], {k: v.copy() for k, v in shared.value.items()})
            trainer = Trainer(local, rate)
            for b in batches:
                for i in range(0, b.num_rows, 256):
                    ids = [np.frombuffer(x, kind) for x in b.slice(i, 256).column(0).to_pylist()]
                    token, around = local.sides(ids, (i // 256 * 7 + number) % share, share)
                    if len(token):
                        trainer.add(token, around)
            trainer.flush()
            if trainer.places:
                yield pa.RecordBatch.from_arrays([pa.array([trainer.places], pa.int64()), pa.array([local.to_bytes()], pa.binary())], ["places", "weights"])

        trained = materialize(coded.select("tokens").mapInArrow(run, "places long, weights binary"), "models")
        weights = _averaged(trained)
        if weights is not None:
            model.w = Model.from_bytes(weights, model.classes)


def fit(docs: DataFrame, rounds: tuple[float, ...] = ROUNDS, share: int = SHARE, seed: int = SEED) -> Model:
    """A model of ``docs`` (``text``): vocabulary and biases from all words, weights from all places, one in ``share`` each round.

    Every place is trained on where there are ``share`` rounds or more.
    """
    model = vocabulary(docs, seed)
    coded = kept(encoded(docs.select(F.lit(None).alias("doc_id"), "text"), model))
    train(coded, model, rounds, share)
    coded.unpersist()
    return model


def kept(coded: DataFrame) -> DataFrame:
    """``coded``, cut once and kept on the executors' disks in the partitions of its texts; what is lost with an executor is cut again."""
    coded = coded.persist(StorageLevel.DISK_ONLY)
    coded.count()  # so that no task has a worker that cuts beside the one that trains
    return coded


def score_lm(docs: DataFrame, model: Model) -> DataFrame:
    """(``doc_id``, ``n_tokens``, ``log_probability``, ``mean_log_probability``) of each row of ``docs`` (``doc_id``, ``text``).

    ``log_probability`` is the sum over all tokens of the text, 0 for null and empty texts, whose mean is null. Equal texts score alike
    up to rounding; other columns are ignored; an empty table gives an empty one.
    """
    shared, joined = docs.sparkSession.sparkContext.broadcast(model), model.joins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free()
        yield from _scores(_cut(batches, shared.value, joined), shared.value)

    return _scored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, model)


def score_encoded(coded: DataFrame, model: Model) -> DataFrame:
    """As :func:`score_lm`, of the rows of :func:`encoded` by the same model."""
    shared = coded.sparkSession.sparkContext.broadcast(model.w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free()
        yield from _scores(batches, Model([], shared.value))

    return _scored(coded, run, model)


def _scored(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], model: Model) -> DataFrame:
    scored = rows.mapInArrow(run, "doc_id long, n_tokens long, log_probability double" + ", others array<long>" * model.joins)
    if model.joins:
        scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
        more = scored.select("row", F.explode("others").alias("h")).join(model.counts, "h").groupBy("row").agg(F.sum("log_count").alias("more"))
        scored = scored.join(more, "row", "left").select("doc_id", "n_tokens", (F.col("log_probability") + F.coalesce("more", F.lit(0.0))).alias("log_probability"))
    return scored.withColumn("mean_log_probability", F.when(F.col("n_tokens") > 0, F.col("log_probability") / F.col("n_tokens")))


def op2_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document under a model of all documents; see :func:`fit` and :func:`score_lm`. Texts are cut into tokens once for both."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = vocabulary(docs)
    coded = kept(encoded(docs, model))
    train(coded, model)
    return score_encoded(coded, model)
