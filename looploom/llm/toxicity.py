"""Toxicity: a bidirectional gated recurrent network (GRU) with attention pooling over word and character inputs, in numpy.

A word's input is an embedding of the word (words of the training sample) beside the mean embedding of its character trigrams (hashed), so
words never seen still have one. Windows of ``WINDOW`` words that overlap by half are scored, all of them, and a text's score is that of its
highest window. The network is trained in one task on a bounded sample of labelled rows, whose texts never reach the driver; it passes the
weights on (a few MB) to executors that score texts in batches, with the input projections of words they have met remembered.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from looploom.llm.text import WORD_RE, bound_batches, free, keep, table
from looploom.tables import materialize

WINDOW, STEP = 32, 16
#: Most labelled rows of each class that the classifier is fitted on, taken in the order of a hash.
SAMPLE_ROWS = 2000
#: Most characters of a class in that sample; texts beyond them (in the same order) are left out of the fit.
SAMPLE_CHARS = 64_000_000
#: Words that a worker remembers, words of the vocabulary, and windows scored at once.
REMEMBERED, VOCABULARY, BATCH_WINDOWS = 200_000, 20_000, 4096
#: Share of a batch with label 1.
POSITIVE = 0.2
#: Rounds in which words are known by their evidence alone, and texts from which embeddings learn at the full rate: fewer learn more slowly.
WITHOUT_EMBEDDINGS, FULL_RATE_TEXTS = 2, 2000
#: Decay of the weights a step (times the rate), and share of words that training hides, both against learning texts by heart.
DECAY, DROPPED = 0.01, 0.1
HIDDEN, WORD_DIM, CHAR_DIM, CHAR_ROWS, ATTENTION = 8, 12, 8, 2048, 8
#: The network takes STEPS steps, in rounds that each choose the windows to learn from anew.
ROUNDS, STEPS, BATCH, RATE, SEED = 4, 200, 128, 0.01, 11

_TRIM = ".,!?;:\"'()[]{}*%$&#|<>-_"


def normal(word: str) -> str:
    return word.lower().strip(_TRIM)


def trigrams(word: str) -> list[int]:
    w = f"^{word}$".encode()
    return [zlib.crc32(w[i : i + 3]) % CHAR_ROWS for i in range(max(1, len(w) - 2))]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Weights, forward and backward pass. Inputs are projections of words, gathered by window: see :meth:`forward`."""

    def __init__(self, vocabulary: list[str], seed: int = SEED):
        r = np.random.default_rng(seed)
        n = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        # embeddings start at zero, so what training never touched adds nothing; a word's first two coordinates hold its evidence
        self.ids = {w: i + 1 for i, w in enumerate(vocabulary)}  # row 0: words outside the vocabulary
        self.w = {
            "Ew": np.zeros((len(vocabulary) + 1, WORD_DIM), np.float32), "Ec": np.zeros((CHAR_ROWS, CHAR_DIM), np.float32), "W": n(2, d, 3 * h, scale=d**-0.5), "U": n(2, h, 3 * h, scale=h**-0.5),
            "b": np.zeros((2, 3 * h), np.float32), "Wa": n(2 * h, ATTENTION, scale=0.3), "va": n(ATTENTION, scale=0.3), "wo": n(2 * h, scale=0.3), "bo": np.zeros(1, np.float32),
        }
        self.scale, self.shift = 1.0, 0.0  # calibration of a text's highest logit

    def inputs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For normalised words: their vocabulary rows, and their trigrams as (rows, first trigram of each word, how many)."""
        grams = [trigrams(w) for w in words]
        size = np.array([len(g) for g in grams], np.int64)
        return np.array([self.ids.get(w, 0) for w in words], np.int64), np.array([x for g in grams for x in g], np.int64), np.r_[0, np.cumsum(size)[:-1]], size

    def embed(self, word_ids, grams, first, size) -> np.ndarray:
        chars = np.add.reduceat(self.w["Ec"][grams], first, axis=0) / size[:, None].astype(np.float32)
        return np.concatenate([self.w["Ew"][word_ids], chars], axis=1)

    def project(self, x: np.ndarray) -> np.ndarray:
        """(2, words, 3 * hidden): what a word adds to the gates of either direction."""
        return np.matmul(x, self.w["W"]) + self.w["b"][:, None]

    def forward(self, proj: np.ndarray, at: np.ndarray, real: np.ndarray, keep: bool = False):
        """Logits of windows. ``at`` (windows, WINDOW): rows of ``proj``; ``real``: where a word stands (padding is at the end)."""
        n, length = at.shape
        h, u = HIDDEN, self.w["U"]
        state = np.zeros((2, n, h), np.float32)
        out = np.zeros((length, n, 2 * h), np.float32)
        tape = []
        for t in range(length):
            back = length - 1 - t
            x = np.stack([proj[0][at[:, t]], proj[1][at[:, back]]])
            m = np.stack([real[:, t], real[:, back]])[:, :, None]
            g = np.matmul(state, u)
            zr = _sigmoid(x[:, :, : 2 * h] + g[:, :, : 2 * h])
            z, r = zr[:, :, :h], zr[:, :, h:]
            new = np.tanh(x[:, :, 2 * h :] + r * g[:, :, 2 * h :])
            before = state
            step = (1 - z) * (new - before)
            state = before + np.where(m, step, np.float32(0))
            out[t, :, :h] = state[0]
            out[back, :, h:] = state[1]
            if keep:
                tape.append((before, z, r, new, g[:, :, 2 * h :], m))
        a = np.tanh(out @ self.w["Wa"])
        e = a @ self.w["va"]
        e = np.where(real.T, e, np.float32(-30))
        e = np.exp(e - e.max(axis=0))
        p = e / e.sum(axis=0)
        pooled = (p[:, :, None] * out).sum(axis=0)
        logit = pooled @ self.w["wo"] + self.w["bo"][0]
        return (logit, (tape, out, a, p, pooled)) if keep else logit

    def backward(self, at, real, kept, d_logit) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the weights but W, b and the embeddings, and of the gathered projections (length, 2, windows, 3 * hidden)."""
        tape, out, a, p, pooled = kept
        length, n, h = out.shape[0], out.shape[1], HIDDEN
        grad = {"wo": pooled.T @ d_logit, "bo": np.array([d_logit.sum()], np.float32)}
        d_pool = d_logit[:, None] * self.w["wo"]
        d_out = p[:, :, None] * d_pool
        dp = (out * d_pool).sum(axis=2)
        de = p * (dp - (p * dp).sum(axis=0))
        de = np.where(real.T, de, np.float32(0))
        grad["va"] = np.tensordot(de, a, axes=([0, 1], [0, 1]))
        da = de[:, :, None] * self.w["va"] * (1 - a * a)
        grad["Wa"] = out.reshape(-1, 2 * h).T @ da.reshape(-1, ATTENTION)
        d_out = d_out + da @ self.w["Wa"].T
        d_state, du = np.zeros((2, n, h), np.float32), np.zeros_like(self.w["U"])
        d_x = np.zeros((length, 2, n, 3 * h), np.float32)
        for t in reversed(range(length)):
            back = length - 1 - t
            before, z, r, new, gn, m = tape[t]
            d_state = d_state + np.stack([d_out[t, :, :h], d_out[back, :, h:]])
            d = np.where(m, d_state, np.float32(0))
            d_new = d * (1 - z) * (1 - new * new)
            d_z = -d * (new - before) * z * (1 - z)
            d_r = d_new * gn * r * (1 - r)
            d_g = np.concatenate([d_z, d_r, d_new * r], axis=2)
            d_x[t] = np.concatenate([d_z, d_r, d_new], axis=2)
            du += np.matmul(before.transpose(0, 2, 1), d_g)
            d_state = np.where(m, d_state * z, d_state) + np.matmul(d_g, self.w["U"].transpose(0, 2, 1))
        grad["U"] = du
        return grad, d_x


def _sum_rows(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of the values that share a row number."""
    order = np.argsort(rows, kind="stable")
    r = rows[order]
    first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
    out = np.zeros((n, values.shape[1]), np.float32)
    out[r[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


def gradients(net: Network, features, at: np.ndarray, real: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean log loss of windows and its gradient for all weights. ``features``: :meth:`Network.inputs` of the words that ``at`` numbers."""
    used, at = np.unique(at, return_inverse=True)
    at = at.reshape(real.shape)
    word_ids, grams, first, size = features
    size, start = size[used], first[used]
    g = grams[np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
    part = (word_ids[used], g, np.r_[0, np.cumsum(size)[:-1]], size)
    x = net.embed(*part)
    logit, kept = net.forward(net.project(x), at, real, keep=True)
    loss = float(np.mean(np.logaddexp(0, logit) - y * logit))
    grad, d_x = net.backward(at, real, kept, ((_sigmoid(logit) - y) / len(y)).astype(np.float32))
    d_proj = np.stack([_sum_rows(d_x[:, 0].reshape(-1, 3 * HIDDEN), at.T.reshape(-1), len(used)), _sum_rows(d_x[:, 1].reshape(-1, 3 * HIDDEN), at.T[::-1].reshape(-1), len(used))])
    grad["W"], grad["b"] = np.matmul(x.T, d_proj), d_proj.sum(axis=1)
    d = np.matmul(d_proj, net.w["W"].transpose(0, 2, 1)).sum(axis=0)
    grad["Ew"] = _sum_rows(d[:, :WORD_DIM], part[0], len(net.w["Ew"]))
    grad["Ew"][0] = 0
    grad["Ec"] = _sum_rows(np.repeat(d[:, WORD_DIM:] / size[:, None], size, axis=0), g, CHAR_ROWS)
    return loss, grad


def windows(n: int) -> np.ndarray:
    """First words of the windows of a text of ``n`` words: each STEP words, to the end; one for a short or empty text."""
    return np.arange(0, max(n - WINDOW + STEP, 1), STEP) if n > WINDOW else np.zeros(1, np.int64)


def layout(rows: list[np.ndarray], pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of texts given as word rows: (rows, real, first window of each text)."""
    starts = [windows(len(r)) for r in rows]
    count = np.array([len(s) for s in starts])
    size = np.array([len(r) for r in rows])
    kind = np.int32 if size.sum() < 1 << 30 else np.int64
    base = np.r_[0, np.cumsum(size)[:-1]].astype(kind)
    flat = np.concatenate([*rows, np.zeros(1, np.int32)])
    place = np.concatenate(starts).astype(kind)[:, None] + np.arange(WINDOW, dtype=kind)
    real = place < np.repeat(size, count)[:, None]
    place += np.repeat(base, count)[:, None]
    place[~real] = len(flat) - 1
    at = flat[place]
    at[~real] = pad
    return at, real, np.r_[0, np.cumsum(count)[:-1]]


class Scorer:
    """Scores texts with a trained network. Keeps the projections of up to ``REMEMBERED`` words."""

    def __init__(self, net: Network):
        self.net, self.rows = net, {}
        self.proj = np.zeros((2, 1 << 12, 3 * HIDDEN), np.float32)  # row 0: padding
        self.n = 1

    def _add(self, words: list[str]) -> None:
        need = self.n + len(words)
        if need > self.proj.shape[1]:
            grown = np.zeros((2, max(need, 2 * self.proj.shape[1]), 3 * HIDDEN), np.float32)
            grown[:, : self.n] = self.proj[:, : self.n]
            self.proj = grown
        self.proj[:, self.n : need] = self.net.project(self.net.embed(*self.net.inputs([normal(w) for w in words])))
        self.rows.update(zip(words, range(self.n, need), strict=True))
        self.n = need

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """The highest logit of each text's windows."""
        split = [WORD_RE.findall(t) if t else [] for t in texts]
        if self.n > REMEMBERED:
            self.rows, self.n = {}, 1
        get = self.rows.get
        got = [list(map(get, w)) for w in split]
        new = list({w: None for words, rows in zip(split, got, strict=True) if None in rows for w, r in zip(words, rows, strict=True) if r is None})
        if new:
            self._add(new)
            got = [[self.rows[w] for w in words] if None in rows else rows for words, rows in zip(split, got, strict=True)]
        at, real, first = layout([np.array(r, np.int32) for r in got], 0)
        logit = np.concatenate([self.net.forward(self.proj, at[i : i + BATCH_WINDOWS], real[i : i + BATCH_WINDOWS]) for i in range(0, len(at), BATCH_WINDOWS)])
        return np.maximum.reduceat(logit, first)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return _sigmoid(self.net.scale * self.logits(texts).astype(np.float64) + self.net.shift)


def train(texts: Iterable[str], y: np.ndarray | list[int], prior: float, steps: int = STEPS, seed: int = SEED) -> Network | None:
    """Fit a network to texts and 0/1 labels; ``prior`` is the share of label 1 where scores are to be used. ``texts`` are read once, and ``y`` after
    them. None without texts of both labels.

    A text's label need not hold for each of its windows: the first round takes the window around the word that speaks most for label 1
    (log odds and signed root of the likelihood ratio of its document counts), later ones the window that the network scores highest, for texts of either label, beside a random
    window for texts of label 0; POSITIVE of each batch has label 1. The highest logit is then calibrated by logistic regression with classes weighted to the prior.
    """
    rng = np.random.default_rng(seed)
    number: dict[str, int] = {}  # texts are kept as numbers of words; 0 is padding
    split = [np.array([number.setdefault(normal(w), len(number) + 1) for w in WORD_RE.findall(t)], np.int32) for t in texts]
    y = np.asarray(y, np.int64)
    if len(set(y.tolist())) < 2:
        return None
    seen = np.zeros((2, len(number) + 1), np.int64)
    for s, k in zip(split, y, strict=True):
        seen[k, np.unique(s)] += 1
    n0, n1 = max(1, int((y == 0).sum())), max(1, int((y == 1).sum()))
    both = seen.sum(axis=0)
    vocabulary = sorted((w for w, i in number.items() if both[i] >= 3), key=lambda w: (-both[number[w]], w))[:VOCABULARY]
    net = Network(vocabulary, seed)
    found = [(int(seen[0, number[w]]), int(seen[1, number[w]])) for w in vocabulary]
    net.w["Ew"][1:, 0] = [np.clip(0.3 * _evidence(b, n1, a, n0), -3, 3) for a, b in found]
    net.w["Ew"][1:, 1] = [0.5 * (math.log((b + 1) / (n1 + 2)) - math.log((a + 1) / (n0 + 2))) for a, b in found]
    speech = np.zeros(len(number) + 1, np.float32)
    speech[0] = -99
    speech[[number[w] for w in vocabulary]] = net.w["Ew"][1:, :2].sum(axis=1)
    features = net.inputs(["", *number])
    at, real, first = layout(split, 0)
    count = np.diff(np.r_[first, len(at)])
    text_of = np.repeat(np.arange(len(split), dtype=np.int32), count)
    speaks = speech[at].max(axis=1)
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.w.items()}
    step, slow = 0, dict.fromkeys(("Ew", "Ec"), min(1.0, len(split) / FULL_RATE_TEXTS))

    def highest(value: np.ndarray) -> np.ndarray:
        order = np.lexsort((-value, text_of))
        return order[first]

    for number in range(ROUNDS):
        if number:
            proj = net.project(net.embed(*features))
            speaks = np.concatenate([net.forward(proj, at[i : i + BATCH_WINDOWS], real[i : i + BATCH_WINDOWS]) for i in range(0, len(at), BATCH_WINDOWS)])
        top = highest(speaks)
        other = first + rng.integers(0, count)
        positive = int(BATCH * POSITIVE)
        pools = np.r_[top[y == 0], other[y == 0]], top[y == 1]
        for _ in range(-(-steps // ROUNDS)):
            k = np.concatenate([pool[rng.integers(0, len(pool), n)] for pool, n in zip(pools, (BATCH - positive, positive), strict=True)])
            shown = np.where(rng.random(real[k].shape) < DROPPED, 0, at[k])
            _, grad = gradients(net, features, shown, real[k], y[text_of[k]].astype(np.float32))
            step += 1
            if number < WITHOUT_EMBEDDINGS:
                del grad["Ew"], grad["Ec"]
            for name, g in grad.items():
                m, v = moment[name]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                net.w[name] -= (RATE * slow.get(name, 1.0) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6) + RATE * DECAY * net.w[name]).astype(np.float32)
    proj = net.project(net.embed(*features))
    value = np.concatenate([net.forward(proj, at[i : i + BATCH_WINDOWS], real[i : i + BATCH_WINDOWS]) for i in range(0, len(at), BATCH_WINDOWS)])
    net.scale, net.shift = _calibrate(np.maximum.reduceat(value, first).astype(np.float64), y.astype(float), np.where(y == 1, prior / n1, (1 - prior) / n0))
    return net


def _evidence(k1: int, n1: int, k0: int, n0: int) -> float:
    """Signed root of the likelihood-ratio statistic of a word in k1 of n1 texts of label 1 and k0 of n0 of label 0."""
    p = (k1 + k0) / (n1 + n0)
    part = lambda k, n: sum(x * math.log(x / (n * q)) for x, q in ((k, p), (n - k, 1 - p)) if x)
    return math.copysign(math.sqrt(max(0.0, 2 * (part(k1, n1) + part(k0, n0)))), k1 / n1 - k0 / n0)


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    a, b, weight = 1.0, 0.0, weight / weight.sum()
    for _ in range(50):  # Newton with a small ridge on the slope
        p = _sigmoid(a * x + b)
        g = np.array([(weight * (p - y) * x).sum() + 1e-4 * (a - 1), (weight * (p - y)).sum()])
        s = weight * p * (1 - p)
        hess = np.array([[(s * x * x).sum() + 1e-4, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        step *= min(1.0, 1.0 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
    return max(a, 0.05), b


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = SEED) -> Network | None:
    """A network fitted to ``labels`` (``doc_id``, ``toxic``) of ``docs`` (``doc_id``, ``text``), or None without rows of both labels.

    Rows whose crc32(doc_id as text) mod 5 is 0 are held out. Up to ``sample_rows`` rows a class, the first by a hash of doc_id, are taken
    from ``labels`` before the texts are joined, and of these as many as have ``SAMPLE_CHARS`` characters together, so what reaches the
    training task is bounded. It reads them batch by batch in the order of that checksum and keeps them as numbers of words; the driver
    gets the weights. Rows without a doc_id, a label or a text teach nothing; repeated rows teach each.
    """
    known = labels.where("toxic is not null and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    count = {r["toxic"]: r["count"] for r in known.where("toxic in (0, 1)").groupBy("toxic").count().collect()}
    if len(count) < 2:
        return None
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string")))
    chosen = known.where("toxic = 0").orderBy(order, "doc_id").limit(sample_rows).unionByName(known.where("toxic = 1").orderBy(order, "doc_id").limit(sample_rows))
    rows = materialize(docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text", F.length("text").alias("chars"), order.alias("place")), "sample")
    upto = F.sum("chars").over(W.partitionBy("toxic").orderBy("place", "doc_id"))  # over the sample alone
    rows = rows.withColumn("upto", upto).where(F.col("upto") <= SAMPLE_CHARS)
    prior = count[1] / (count[0] + count[1])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free()
        y: list[int] = []

        def texts() -> Iterator[str]:
            for b in batches:
                y.extend(b.column(0).to_pylist())
                yield from (t.as_py() for t in b.column(1))

        net = train(texts(), y, prior, seed=seed)
        if net is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], ["net"])

    rows = rows.coalesce(1).sortWithinPartitions(F.crc32(F.col("doc_id").cast("string")), "doc_id").select("toxic", "text")
    found = rows.mapInArrow(learn, "net binary").collect()
    return pickle.loads(found[0]["net"]) if found else None


def score_toxicity(docs: DataFrame, net: Network | None) -> DataFrame:
    """``docs`` with ``score`` (double, 0 to 1) and ``predicted`` (1 from 0.5). Only ``text`` is read for them.

    Null and empty texts are one window of padding, scored like any other; equal texts score alike; very long texts are scored in all
    their windows. Without a network (nothing to learn from) every score is 0. Columns of ``docs`` named like the new ones are replaced.
    The session's Arrow batches are bounded (:func:`looploom.llm.text.bound_batches`), as whole texts are in them.
    """
    docs = docs.drop("score", "predicted")
    if net is None:
        return docs.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)})
    bound_batches(docs.sparkSession)
    shared, name = docs.sparkSession.sparkContext.broadcast(net), f"{id(net)}-{np.random.default_rng().integers(1 << 62)}"

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        s, out, part, size = keep(("toxicity", name), lambda: Scorer(shared.value)), [], [], 0
        for t in texts:
            part.append(t)
            size += len(t or "")
            if size > 400_000:
                out.append(s.scores(part))
                part, size = [], 0
        if part:
            out.append(s.scores(part))
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return docs.withColumn("score", score(F.col("text").cast("string"))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; see :func:`fit_toxicity` and :func:`score_toxicity`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", "predicted")
