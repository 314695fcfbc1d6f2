"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as the sum of a hashed word vector and of hashed vectors of its character n-grams, so
that unseen forms of a stem are known by their characters. A window of words is read in both
directions, the states are pooled by attention, and a logistic layer scores the window. All
overlapping windows of a text are scored; the text has the score of its worst window, calibrated.

The network is trained on the driver from a bounded sample of labelled texts. Scoring is a map over
Arrow batches; the network (a few megabytes, fixed by its parameters) is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import tokens

WINDOW, STRIDE = 32, 16
HIDDEN, WIDTH = 8, 16
WORD_ROWS, GRAM_ROWS = 1 << 15, 1 << 16
GRAMS = (4, 5)
#: Words and n-grams of fewer training texts than this, or than this share of them, carry no vector
#: of their own: they would only be learnt by heart.
LEAST, LEAST_SHARE = 4, 0.02
#: At most so many texts of each label are collected for training, each of them whole.
SAMPLE = 700
#: Bytes of text scored at a time: the n-grams of a word are hashed once for each.
SLICE = 1 << 19
U = np.uint64
f32 = np.float32


def features(h: np.ndarray, s: np.ndarray, e: np.ndarray, low: np.ndarray):
    """Hashed word row, hashed n-gram rows (flat) and their offsets, for words low[s:e]."""
    size = (e - s) + 2
    begin = np.concatenate([[0], np.cumsum(size)])
    flat = np.empty(begin[-1], U)
    flat[begin[:-1]], flat[begin[1:] - 1] = 2, 3
    body = np.ones(begin[-1], bool)
    body[begin[:-1]] = body[begin[1:] - 1] = False
    lead = np.concatenate([[0], np.cumsum(e - s)])[:-1]
    flat[body] = low[np.repeat(s - lead, e - s) + np.arange(body.sum())]
    word = np.repeat(np.arange(len(s)), size)
    left = np.repeat(begin[1:], size) - np.arange(begin[-1])
    rows, owner = [], []
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        code = np.full(len(at), n, U)
        for k in range(n):
            code = code * U(0x9E3779B97F4A7C15) + flat[at + k]
        rows.append((tokens.mix(code) % U(GRAM_ROWS)).astype(np.int64))
        owner.append(word[at])
    rows, owner = np.concatenate(rows), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return (h % U(WORD_ROWS)).astype(np.int64), rows[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(s)))])


def windows(size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts with `size` words: text, first word (from the text's own first) and words of each window."""
    many = np.where(size > 0, np.maximum(1, -(-(size - WINDOW) // STRIDE) + 1), 0)
    text = np.repeat(np.arange(len(size)), many)
    first = (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)) * STRIDE
    return text, first, np.minimum(WINDOW, size[text] - first)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Weights, the forward pass, and the gradient of the loss."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {"word": np.zeros((WORD_ROWS, WIDTH), f32), "gram": np.zeros((GRAM_ROWS, WIDTH), f32)}
        for d in "fb":
            self.p["w" + d] = r.normal(0, 0.4, (WIDTH, 3 * HIDDEN)).astype(f32)
            self.p["u" + d] = r.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)).astype(f32)
            self.p["c" + d] = np.zeros(3 * HIDDEN, f32)
        self.p["att"] = r.normal(0, 0.3, 2 * HIDDEN).astype(f32)
        self.p["out"] = r.normal(0, 0.3, 2 * HIDDEN).astype(f32)
        self.p["bias"] = np.zeros(1, f32)
        self.scale, self.shift, self.empty = 1.0, 0.0, 0.0

    def vectors(self, word, gram, off):
        n = np.maximum(np.diff(off), 1)
        total = np.add.reduceat(np.concatenate([self.p["gram"][gram], np.zeros((1, WIDTH), f32)]), off[:-1]) if len(word) else np.zeros((0, WIDTH), f32)
        total[np.diff(off) == 0] = 0
        return self.p["word"][word] + total / np.sqrt(n)[:, None].astype(f32)

    def read(self, x: np.ndarray, ids: np.ndarray, size: np.ndarray, keep: bool = False):
        """Logits of windows; x: vectors of distinct words, ids: windows by WINDOW word numbers."""
        n, steps, hid = len(ids), ids.shape[1], HIDDEN
        mask = np.arange(steps)[None, :] < size[:, None]
        states, trace = np.empty((steps, n, 2 * hid), f32), {}
        for d in "fb":
            proj = x @ self.p["w" + d] + self.p["c" + d]
            u = self.p["u" + d]
            h = np.zeros((n, hid), f32)
            log = [None] * steps
            for t in (range(steps) if d == "f" else range(steps - 1, -1, -1)):
                a = proj[ids[:, t]]
                b = h @ u
                zr = 1 / (1 + np.exp(-(a[:, : 2 * hid] + b[:, : 2 * hid])))
                c = np.tanh(a[:, 2 * hid:] + zr[:, hid:] * b[:, 2 * hid:])
                new = h + zr[:, :hid] * (c - h)
                m = mask[:, t: t + 1]
                new = np.where(m, new, h)
                if keep:
                    log[t] = (h, zr, c, b[:, 2 * hid:])
                h = new
                states[t, :, hid * (d == "b"): hid * (1 + (d == "b"))] = h
            trace[d] = log
        score = np.where(mask.T, states @ self.p["att"], -1e9)
        weight = np.exp(score - score.max(0))
        weight /= weight.sum(0)
        pooled = np.einsum("tn,tnk->nk", weight, states)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, (states, weight, pooled, mask, trace)) if keep else logit

    def gradient(self, batch, target, share):
        """Gradients of the logistic loss over some windows. batch: (word, gram, off, ids, size)."""
        word, gram, off, ids, size = batch
        x = self.vectors(word, gram, off)
        logit, (states, weight, pooled, mask, trace) = self.read(x, ids, size, True)
        g = {k: np.zeros_like(v) for k, v in self.p.items() if k not in ("word", "gram")}
        dl = ((_sigmoid(logit) - target) * share).astype(f32)
        g["out"], g["bias"] = pooled.T @ dl, np.array([dl.sum()], f32)
        dp = dl[:, None] * self.p["out"]
        ds = weight[:, :, None] * dp
        dw = np.einsum("tnk,nk->tn", states, dp)
        da = weight * (dw - (weight * dw).sum(0))
        g["att"] = np.einsum("tn,tnk->k", da, states)
        ds = ds + da[:, :, None] * self.p["att"]
        dx = np.zeros_like(x)
        hid, steps = HIDDEN, ids.shape[1]
        for d in "fb":
            u, dh = self.p["u" + d], np.zeros((len(ids), hid), f32)
            dproj = np.zeros((len(x), 3 * hid), f32)
            for t in (range(steps - 1, -1, -1) if d == "f" else range(steps)):
                h, zr, c, bc = trace[d][t]
                dh = dh + ds[t, :, hid * (d == "b"): hid * (1 + (d == "b"))]
                m = mask[:, t: t + 1]
                z, r = zr[:, :hid], zr[:, hid:]
                live = np.where(m, dh, 0)
                dc = live * z * (1 - c * c)
                dz = live * (c - h) * z * (1 - z)
                dr = dc * bc * r * (1 - r)
                db = np.concatenate([dz, dr, dc * r], 1)
                g["u" + d] += h.T @ db
                dh = np.where(m, dh * (1 - z), dh) + db @ u.T
                np.add.at(dproj, ids[:, t], np.concatenate([dz, dr, dc], 1))
            g["w" + d] += x.T @ dproj
            g["c" + d] += dproj.sum(0)
            dx += dproj @ self.p["w" + d].T
        n = np.maximum(np.diff(off), 1)
        spread = np.repeat(dx / np.sqrt(n)[:, None].astype(f32), np.diff(off), axis=0)
        return logit, g, (word, dx), (gram, spread)


def _rows_of(texts: list[str | None]):
    """Words of texts: (numbers of distinct words, words by text, features of the distinct words).
    The bytes are hashed some texts at a time, and a word met before adds only its number."""
    raw, off = tokens.parts(pa.array([t or "" for t in texts], pa.string()))
    size = np.zeros(len(texts), np.int64)
    hashes, numbers, feats, base = [], [], [], 0
    for i, j in tokens.slices(off, SLICE):
        h, row, s, e, low = tokens.words(raw[off[i]: off[j]], off[i: j + 1] - off[i])
        size[i:j] = np.bincount(row, minlength=j - i)
        distinct, one, number = np.unique(h, return_index=True, return_inverse=True)
        hashes.append(distinct)
        numbers.append((number + base).astype(np.int32))
        feats.append(features(distinct, s[one], e[one], low))
        base += len(distinct)
    if not hashes:
        return np.zeros(0, np.int32), size, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64))
    _, one, again = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    lead = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(o) for _, _, o in feats]))])
    cut = np.concatenate([[0], np.cumsum(lead[one + 1] - lead[one])])
    gram = np.concatenate([g for _, g, _ in feats])[np.repeat(lead[one] - cut[:-1], np.diff(cut)) + np.arange(cut[-1])]
    word = np.concatenate([w for w, _, _ in feats])[one]
    return again.astype(np.int32)[np.concatenate(numbers)], size, (word, gram, cut)


class _Windows:
    """The windows of some texts. Only their places are held; the word numbers of the windows at
    hand are laid out when they are read."""

    def __init__(self, number: np.ndarray, size: np.ndarray):
        text, first, count = windows(size)
        self.number, self.text, self.count = number, text.astype(np.int32), count.astype(np.int32)
        self.begin = (np.cumsum(size) - size)[text] + first

    def __len__(self):
        return len(self.text)

    def ids(self, rows) -> np.ndarray:
        step = np.arange(WINDOW)[None, :]
        at = np.minimum(self.begin[rows][:, None] + step, max(len(self.number) - 1, 0))
        return np.where(step < self.count[rows][:, None], self.number[at], 0)

    def blocks(self, size: int = 4096) -> Iterator[slice]:
        return (slice(k, min(k + size, len(self))) for k in range(0, len(self), size))


def _enriched(y: np.ndarray, size, number, word, gram, off) -> np.ndarray:
    """How much oftener each distinct word, or its likeliest n-gram, is in positive texts: a z-score."""
    begin = np.concatenate([[0], np.cumsum(size)])
    share = y.mean()
    best = np.zeros(len(word))
    for of_word, rows in ((np.diff(off), GRAM_ROWS), (np.ones(len(word), np.int64), WORD_ROWS)):
        flat = gram if rows == GRAM_ROWS else word
        lead = np.concatenate([[0], np.cumsum(of_word)])
        total, hit = np.zeros(rows), np.zeros(rows)
        for k in range(len(y)):  # a text at a time, for the memory
            v = np.unique(number[begin[k]: begin[k + 1]])
            cut = np.concatenate([[0], np.cumsum(of_word[v])])
            row = np.unique(flat[np.repeat(lead[v] - cut[:-1], of_word[v]) + np.arange(cut[-1])])
            total[row] += 1
            hit[row] += y[k]
        z = (hit - share * total) / np.sqrt(share * (1 - share) * total + 1)
        z = np.concatenate([z[flat], [0]])
        top = np.maximum.reduceat(z, lead[:-1])
        best = np.maximum(best, np.where(of_word > 0, top, 0))
    return best


def train(texts: list[str | None], labels: list[int], prior: float | None = None, steps: int = 500, seed: int = 7) -> Network:
    """Fit the network to labelled texts.

    A text's label says that some window is toxic, not which. The first pass takes the windows of a
    positive text that hold its most enriched words; later ones those that the network itself
    scores high, and always its best one. Every fifth text is kept for the calibration of the
    score, which is weighted to the share `prior` of positive texts (by default the sample's own).
    Without texts of both labels the network answers 0 for everything.
    """
    net = Network(seed)
    y = np.array(labels, f32)
    apart = np.arange(len(y)) % 5 == 4
    if not len(y) or y[~apart].min() == y[~apart].max() or (apart.any() and y[apart].min() == y[apart].max()):
        apart[:] = False
    if not len(y) or y.min() == y.max():
        net.p["bias"][:] = -10
        return net
    kept = [t for t, a in zip(texts, apart) if not a]
    goal = y[~apart]
    number, size, (word, gram, off) = _rows_of(kept)
    win = _Windows(number, size)
    text, count = win.text, win.count
    begin = np.concatenate([[0], np.cumsum(size)])
    held = np.zeros(len(word), np.int64)
    for i, j in zip(begin[:-1], begin[1:]):
        held[np.unique(number[i:j])] += 1
    least = max(LEAST, LEAST_SHARE * len(goal))
    often = {"word": np.bincount(word, held, WORD_ROWS) >= least,
             "gram": np.bincount(gram, np.repeat(held, np.diff(off)), GRAM_ROWS) >= least}
    rich = _enriched(goal, size, number, word, gram, off)
    z = np.concatenate([np.where(np.arange(WINDOW)[None, :] < count[b][:, None], rich[win.ids(b)], 0).max(1) for b in win.blocks()])
    top = np.zeros(len(goal))
    np.maximum.at(top, text, z)
    target = ((goal[text] > 0) & (z >= 0.6 * top[text])).astype(f32)
    rng = np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    step, epochs = 0, max(3, -(-steps * 256 // max(1, len(win))))
    for epoch in range(epochs):
        order = rng.permutation(np.flatnonzero((target > 0) | (goal[text] == 0)))
        for k in range(0, len(order), 256):
            w = order[k: k + 256]
            used, local = np.unique(win.ids(w), return_inverse=True)
            cut = np.concatenate([[0], np.cumsum(off[used + 1] - off[used])])
            flat = gram[np.repeat(off[used] - cut[:-1], np.diff(cut)) + np.arange(cut[-1])]
            batch = (word[used], flat, cut, local.reshape(len(w), WINDOW), count[w])
            _, g, (wr, wg), (gr, gg) = net.gradient(batch, target[w], np.full(len(w), 1 / len(w), f32))
            step += 1
            rate = 0.01 * min(1.0, step / 50)
            fix = rate * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
            for name, grad in g.items():
                first[name] += 0.1 * (grad - first[name])
                second[name] += 0.001 * (grad * grad - second[name])
                net.p[name] -= (fix * first[name] / (np.sqrt(second[name]) + 1e-8)).astype(f32)
            for name, rows, grad in (("word", wr, wg), ("gram", gr, gg)):
                rows, grad = rows[often[name][rows]], grad[often[name][rows]]
                rows, place = np.unique(rows, return_inverse=True)
                total = np.zeros((len(rows), WIDTH), f32)
                np.add.at(total, place, grad)
                second[name][rows] += total * total
                # the small constant keeps rows that hardly matter near zero
                net.p[name][rows] -= 0.05 * total / (np.sqrt(second[name][rows]) + 1e-3)
        if epoch < epochs - 1 and epoch % max(1, epochs // 3) == 0:
            logit = _all(net, (word, gram, off), win)
            best = np.full(len(goal), -np.inf)
            np.maximum.at(best, text, logit)
            target = ((goal[text] > 0) & ((logit > 0) | (logit >= best[text]))).astype(f32)
    check = apart if apart.any() else ~apart
    share = y[check].mean()
    weight = np.where(y[check] > 0, (share if prior is None else prior) / share, (1 - (share if prior is None else prior)) / (1 - share))
    net.empty = float(share if prior is None else prior)
    net.scale, net.shift = _calibrate(
        np.where(np.isfinite(best := _worst(net, pa.array([t for t, a in zip(texts, check) if a], pa.string()))), best, net.p["bias"][0]), y[check], weight)
    return net


def _worst(net: Network, texts: pa.Array) -> np.ndarray:
    """Logits of the worst windows of whole texts, some texts at a time; -inf for texts without words."""
    raw, off = tokens.parts(texts)
    out = np.empty(len(texts))
    for i, j in tokens.slices(off, SLICE):
        h, row, s, e, low = tokens.words(raw[off[i]: off[j]], off[i: j + 1] - off[i])
        _, one, number = np.unique(h, return_index=True, return_inverse=True)
        win = _Windows(number, np.bincount(row, minlength=j - i))
        best = np.full(j - i, -np.inf)
        np.maximum.at(best, win.text, _all(net, features(h[one], s[one], e[one], low), win))
        out[i:j] = best
    return out


def _all(net: Network, feats, win: _Windows) -> np.ndarray:
    word, gram, off = feats
    x = np.zeros((len(word), WIDTH), f32)
    for k in range(0, len(word), 16384):
        cut = off[k: k + 16385]
        x[k: k + 16384] = net.vectors(word[k: k + 16384], gram[cut[0]: cut[-1]], cut - cut[0])
    out = [net.read(x, win.ids(b), win.count[b]) for b in win.blocks()]
    return np.concatenate(out) if out else np.zeros(0, f32)


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic fit of the labels on the worst windows' logits, with a small ridge."""
    mean, std = x.mean(), max(float(x.std()), 1e-6)
    v = np.stack([(x - mean) / std, np.ones(len(x))], 1).astype(float)
    c = np.zeros(2)

    def loss(c):
        t = v @ c
        return (weight * (np.logaddexp(0, t) - y * t)).sum() + 0.05 * (c * c).sum()

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(v @ c, -30, 30)))
        move = np.linalg.solve((v * (weight * p * (1 - p))[:, None]).T @ v + 0.1 * np.eye(2), v.T @ (weight * (p - y)) + 0.1 * c)
        size = 1.0
        while size > 1e-6 and loss(c - size * move) > loss(c):
            size /= 2
        c = c - size * move
    a = max(c[0], 1e-3)
    return float(a / std), float(c[1] - a * mean / std)


def score_batch(net: Network, texts: pa.Array) -> np.ndarray:
    """Scores of whole texts, 0 to 1."""
    out = _worst(net, texts)
    return np.where(np.isfinite(out), _sigmoid(net.scale * np.where(np.isfinite(out), out, 0) + net.shift), net.empty)


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """Train on at most `sample` texts of each label, those of the smallest hashes of doc_id, never
    on held-out rows. Rows without a label or a doc_id are left out."""
    known = (labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", "toxic").where(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    count = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    # at most 2 * sample rows
    parts = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    ids = {r.doc_id: r.toxic for p in parts for r in p.collect()}
    rows = (docs.where(F.col("doc_id").isin(list(ids))).select("doc_id", "text").groupBy("doc_id").agg(F.min("text").alias("text"))
            .orderBy("doc_id").collect() if ids else [])
    return train([r.text for r in rows], [ids[r.doc_id] for r in rows], count.get(1, 0) / max(1, sum(count.values())))


def score(docs: DataFrame, net: Network) -> DataFrame:
    """`docs` (doc_id, text) -> doc_id, held_out, score, predicted, one row for each input row.
    Texts without words get the share of positive labels as their score; a null doc_id counts as not held out;
    other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = score_batch(shared.value, b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                                             ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return (docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
            .mapInArrow(tokens.lean(run), f"doc_id {kind}, held_out boolean, score double, predicted int"))


def clean(docs: DataFrame, net: Network) -> DataFrame:
    """The rows of `docs` that the network does not reject, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(score_batch(shared.value, b.column(at)) < 0.5))

    return docs.mapInArrow(tokens.lean(run), docs.schema)
