"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, sampling

LETTERS = 24  # of a word; a longer one counts as several
WORD = re.compile(r"\w{1,%d}" % LETTERS)
BUCKETS = 1 << 18
EMBEDDED = 1 << 12
BLOCK = 1 << 14  # words whose inputs are made together
PREFIXES = (4, 5, 6, 7)  # with the mark of the start
CHAR, OWN, HIDDEN = 6, 4, 8
INPUTS = 3 + CHAR + OWN + 1


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def grams(words: list[str]) -> dict[str, np.ndarray]:
    """Hashed inputs of words: the word, its prefixes, its runs of four letters and of three (for embeddings); -1: none."""
    n = len(words)
    if n > BLOCK:
        blocks = [grams(words[at : at + BLOCK]) for at in range(0, n, BLOCK)]
        return {k: np.concatenate([b[k] for b in blocks]) for k in blocks[0]}
    letters = np.zeros((n, LETTERS + 2), np.uint64)
    letters[:, 1:-1] = np.array(words, f"U{LETTERS}").view(np.uint32).reshape(n, LETTERS)
    size = (letters[:, 1:-1] > 0).sum(axis=1) + 2
    letters[:, 0] = 1
    letters[np.arange(n), size - 1] = 2
    factors = common.mix64(np.arange(LETTERS + 2, dtype=np.uint64) + np.uint64(77)) | np.uint64(1)

    def runs(width: int, buckets: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = sum(letters[:, k : letters.shape[1] - width + 1 + k] * factors[k] for k in range(width))
            h = common.mix64(h + np.uint64(width)) % np.uint64(buckets)
        out = h.astype(np.int32)
        out[np.arange(out.shape[1]) + width > size[:, None]] = -1
        return out

    with np.errstate(over="ignore"):
        own = common.mix64((letters * factors).sum(axis=1))
    prefixes = np.stack([runs(k, BUCKETS)[:, 0] for k in PREFIXES], axis=1)
    return {"word": (own % np.uint64(BUCKETS)).astype(np.int32), "own": (own % np.uint64(EMBEDDED)).astype(np.int32), "prefix": prefixes, "four": runs(4, BUCKETS), "three": runs(3, EMBEDDED)}


def odds(ones: np.ndarray, zeros: np.ndarray, prior: float, weight: float = 5.0) -> np.ndarray:
    """Smoothed log-odds of the label where an input occurs, against the prior."""
    ratio = (np.maximum(ones, 0) + weight * prior) / (np.maximum(zeros, 0) + weight * (1 - prior))
    return np.clip(np.log(ratio) - np.log(prior / (1 - prior)), -4, 4).astype(np.float32) / 2


def mean_of(rows: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Mean of the rows that ``index`` names, -1 for none."""
    have = index >= 0
    picked = rows[np.where(have, index, 0)]
    if picked.ndim == 3:
        return (picked * have[:, :, None]).sum(axis=1) / np.maximum(have.sum(axis=1), 1)[:, None]
    return (picked * have).sum(axis=1) / np.maximum(have.sum(axis=1), 1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    """Word inputs (log-odds of the word, its prefixes and letter runs, and embeddings of the word and its letters), read by a gated
    recurrent network in both directions; attention pools its states into one logit for each window of ``width`` words, at every
    ``stride`` words.  Four figures of a text's windows make its score."""

    width: int = 32
    stride: int = 16
    prior: float = 0.5
    tables: dict[str, np.ndarray] = field(default_factory=dict)
    p: dict[str, np.ndarray] = field(default_factory=dict)
    head: np.ndarray | None = None

    def inputs(self, g: dict[str, np.ndarray], label: int | None = None) -> np.ndarray:
        """Vectors of words; for training, without what the text itself (of this label) adds to the counts."""
        n = len(g["word"])
        if n > BLOCK:
            return np.concatenate([self.inputs({k: v[at : at + BLOCK] for k, v in g.items()}, label) for at in range(0, n, BLOCK)])
        out = np.ones((n, INPUTS), np.float32)

        def known(name: str, index: np.ndarray) -> np.ndarray:
            if label is None:
                return np.where(index >= 0, self.tables[name][index], 0)
            ones, zeros = self.tables[name + "1"], self.tables[name + "0"]
            return np.where(index >= 0, odds(ones[index] - (label == 1), zeros[index] - (label == 0), self.prior), 0)

        out[:, 0] = known("word", g["word"])
        prefix = known("word", g["prefix"])
        out[:, 1] = prefix[np.arange(len(prefix)), np.abs(prefix).argmax(axis=1)]
        four = known("word", g["four"])
        out[:, 2] = four.sum(axis=1) / np.maximum((g["four"] >= 0).sum(axis=1), 1)
        out[:, 3 : 3 + CHAR] = mean_of(self.p["chars"], g["three"])
        out[:, 3 + CHAR : -1] = self.p["own"][g["own"]]
        return out

    def windows(self, sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts that lie end to end: each window's text, first word and number of words."""
        text, start, length, base = [], [], [], 0
        for i, n in enumerate(sizes):
            at = np.arange(0, max(1, n - self.width + self.stride), self.stride)
            text.append(np.full(len(at), i))
            start.append(base + at)
            length.append(np.minimum(self.width, n - at))
            base += n
        none = np.zeros(0, np.int64)
        return (np.concatenate(text), np.concatenate(start), np.concatenate(length)) if text else (none, none, none)

    def scan(self, x: np.ndarray, mask: np.ndarray, side: str, trace: list | None = None) -> np.ndarray:
        """States (time, window, HIDDEN) from gate inputs (time, window, 3 HIDDEN)."""
        u, h = self.p["u" + side], np.zeros((x.shape[1], HIDDEN), np.float32)
        out = np.empty((*x.shape[:2], HIDDEN), np.float32)
        for t in range(len(x)) if side == "f" else reversed(range(len(x))):
            a = h @ u
            zr = sigmoid(x[t, :, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(x[t, :, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
            new = (n + z * (h - n)) * mask[t][:, None]
            if trace is not None:
                trace.append((t, h, a, z, r, n))
            out[t] = h = new
        return out

    def logits(self, gates: np.ndarray, mask: np.ndarray, trace: dict | None = None) -> np.ndarray:
        half, parts = 3 * HIDDEN, {}
        for i, side in enumerate("fb"):
            parts[side] = self.scan(gates[:, :, i * half : (i + 1) * half], mask, side, trace.setdefault(side, []) if trace is not None else None)
        h = np.concatenate([parts["f"], parts["b"]], axis=2)
        key = np.tanh(h @ self.p["wa"])
        e = np.where(mask > 0, key @ self.p["va"], -1e4)
        e = np.exp(e - e.max(axis=0))
        e /= e.sum(axis=0)
        pooled = (h * e[:, :, None]).sum(axis=0)
        if trace is not None:
            trace |= {"h": h, "key": key, "e": e, "pooled": pooled}
        return pooled @ self.p["wo"] + self.p["bo"][0]

    def score_windows(self, gates: np.ndarray, ids: np.ndarray, start: np.ndarray, length: np.ndarray, tile: int = 2048) -> np.ndarray:
        """Logits of windows; gates: by word number, ids: the words' numbers, end to end."""
        out = np.empty(len(start), np.float32)
        ids = np.r_[ids, np.zeros(self.width, ids.dtype)]
        steps = np.arange(self.width)[:, None]
        for at in range(0, len(start), tile):
            s, n = start[at : at + tile], length[at : at + tile]
            out[at : at + tile] = self.logits(gates[ids[s + steps]], (steps < n).astype(np.float32))
        return out

    def figures(self, logits: np.ndarray, text: np.ndarray, count: int) -> np.ndarray:
        """Of each text: highest and mean logit, mean probability, log of the number of windows, 1."""
        starts = np.searchsorted(text, np.arange(count))
        n = np.bincount(text, minlength=count)
        top = np.maximum.reduceat(logits, starts)
        return np.stack([top / 4, np.add.reduceat(logits, starts) / n / 4, np.add.reduceat(sigmoid(logits), starts) / n, np.log(n), np.ones(count)], axis=1)

    def gates_of(self, g: dict[str, np.ndarray], label: int | None = None) -> np.ndarray:
        return (self.inputs(g, label) @ self.p["wx"]).astype(np.float32)


def fit(sample: list[tuple[str, int]], prior: float, width: int = 32, stride: int = 16, epochs: int = 8, seed: int = 5) -> Network:
    """Learn from texts labelled 0 or 1.  Of a text labelled 1 the windows that score highest are taken to be so, of others the
    highest and a random one are taken not to be; ``prior`` is the share of label 1 where the sample was drawn."""
    net, rng = Network(width, stride, min(max(prior, 1e-3), 1 - 1e-3)), np.random.default_rng(seed)
    y = np.array([label for _, label in sample])
    if len(set(y.tolist())) < 2:
        return net
    vocab: dict[str, int] = {}
    docs = [np.array([vocab.setdefault(w, len(vocab)) for w in words_of(t)], np.int32) for t, _ in sample]
    vocab.setdefault("", len(vocab))
    g = grams(list(vocab))
    weight = np.array([(1 - net.prior) / max(1, (y == 0).sum()), net.prior / max(1, (y == 1).sum())]) * len(y)
    for name in ("word0", "word1"):
        net.tables[name] = np.zeros(BUCKETS, np.float32)
    for d, label in zip(docs, y, strict=True):
        here = np.unique(d)
        seen = np.unique(np.concatenate([g["word"][here], g["prefix"][here].ravel(), g["four"][here].ravel()]))
        net.tables[f"word{label}"][seen[seen >= 0]] += 1
    # counts are those of the sample, so its own share of label 1 is their prior
    own_prior, net.prior = net.prior, float(np.clip((y == 1).mean(), 1e-3, 1 - 1e-3))
    net.tables["word"] = odds(net.tables["word1"], net.tables["word0"], net.prior)
    scale = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    net.p = {"chars": scale(EMBEDDED, CHAR) * 8, "own": scale(EMBEDDED, OWN) * 4, "wx": scale(INPUTS, 6 * HIDDEN), "uf": scale(HIDDEN, 3 * HIDDEN), "ub": scale(HIDDEN, 3 * HIDDEN), "wa": scale(2 * HIDDEN, HIDDEN), "va": scale(HIDDEN), "wo": scale(2 * HIDDEN), "bo": np.zeros(1, np.float32)}
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    # words by the label of the text that they stand in: inputs are made for those alone
    used, ids = np.unique(np.concatenate([d + label * len(vocab) for d, label in zip(docs, y, strict=True)]), return_inverse=True)
    word, ids = (used % len(vocab)).astype(np.int32), ids.astype(np.int32)
    split = int(np.searchsorted(used, len(vocab)))

    def made() -> np.ndarray:
        out = np.empty((len(word), INPUTS), np.float32)
        for label, (a, b) in enumerate(((0, split), (split, len(word)))):
            for at in range(a, b, BLOCK):
                some = word[at : min(at + BLOCK, b)]
                out[at : at + len(some)] = net.inputs({k: v[some] for k, v in g.items()}, label)
        return out

    text, start, length = net.windows([len(d) for d in docs])
    inputs = made()
    known = inputs[ids, :3].max(axis=1) if len(ids) else np.zeros(0)
    padded = np.r_[known, np.full(width, -9.0)]
    steps = np.arange(width)[:, None]
    score = np.where(steps < length, padded[np.minimum(start + steps, len(padded) - 1)], -9).max(axis=0)
    step = 0
    for epoch in range(epochs):
        if epoch:
            inputs = made()
            score = net.score_windows(inputs @ net.p["wx"], ids, start, length)
        order = np.lexsort((-score, text))
        rank = np.arange(len(text)) - np.searchsorted(text, text)
        ranks = np.empty(len(text), np.int64)
        ranks[order] = rank
        of_text = np.bincount(text, minlength=len(docs))[text]
        chosen = (ranks == 0) | ((y[text] == 1) & (ranks < 0.4 * of_text) & (ranks < 4)) | ((y[text] == 0) & (rng.random(len(text)) < 1 / of_text))
        chosen = rng.permutation(np.flatnonzero(chosen & (length > 0)))
        rate = 0.01 * (1 - epoch / epochs) + 0.001
        size = int(np.clip(len(chosen) // 24, 16, 256))  # small samples need as many steps
        for at in range(0, len(chosen), size):
            step += 1
            descend(net, moment, gradients(net, g, ids, inputs, chosen[at : at + size], text, start, length, y, word), rate, step)
    # the score of a text from figures of its windows, weighed so that label 1 has the share it has outside the sample
    fair = net.score_windows(made() @ net.p["wx"], ids, start, length)
    x = net.figures(fair, text, len(docs))
    net.head = logistic(x, y, weight[y])
    net.prior = own_prior
    del net.tables["word0"], net.tables["word1"]
    return net


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> np.ndarray:
    """Weighted logistic regression by Newton's method; the last column is the constant and bears no penalty."""
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        q = sigmoid(x @ w)
        slope = x.T @ (weight * (q - y)) + penalty @ w
        bend = (x * (weight * q * (1 - q))[:, None]).T @ x + penalty + 1e-6 * np.eye(len(w))
        move = np.linalg.solve(bend, slope)
        w -= move * min(1, 4 / (np.abs(move).max() + 1e-9))
    return w


def gradients(net: Network, g: dict, ids: np.ndarray, inputs: np.ndarray, chosen: np.ndarray, text: np.ndarray, start: np.ndarray, length: np.ndarray, y: np.ndarray, word: np.ndarray) -> dict[str, np.ndarray]:
    """Slopes of the mean cross-entropy of some windows, by back-propagation through time."""
    p, steps = net.p, np.arange(net.width)[:, None]
    mask = (steps < length[chosen]).astype(np.float32)
    at = ids[np.minimum(start[chosen] + steps, len(ids) - 1)]
    some, inverse = np.unique(at, return_inverse=True)
    inverse = inverse.reshape(at.shape)
    pick = word[some]
    x = inputs[some]
    x[:, 3 : 3 + CHAR] = mean_of(p["chars"], g["three"][pick])
    x[:, 3 + CHAR : -1] = p["own"][g["own"][pick]]
    trace: dict = {}
    logits = net.logits((x @ p["wx"])[inverse], mask, trace)
    target = y[text[chosen]]
    d = ((sigmoid(logits) - target) / len(chosen)).astype(np.float32)
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    h, key, e, pooled = trace["h"], trace["key"], trace["e"], trace["pooled"]
    grad["wo"], grad["bo"] = pooled.T @ d, np.array([d.sum()], np.float32)
    dpool = d[:, None] * p["wo"]
    de = (h * dpool).sum(axis=2)
    de = e * (de - (e * de).sum(axis=0))
    grad["va"] = (key * de[:, :, None]).sum(axis=(0, 1))
    dkey = de[:, :, None] * p["va"] * (1 - key * key)
    grad["wa"] = h.reshape(-1, h.shape[2]).T @ dkey.reshape(-1, dkey.shape[2])
    dh = e[:, :, None] * dpool + dkey @ p["wa"].T
    dgates = np.zeros((*at.shape, 6 * HIDDEN), np.float32)
    for i, side in enumerate("fb"):
        u, back = p["u" + side], np.zeros((len(chosen), HIDDEN), np.float32)
        for t, before, a, z, r, n in reversed(trace[side]):
            new = (back + dh[t, :, i * HIDDEN : (i + 1) * HIDDEN]) * mask[t][:, None]
            dn = new * (1 - z) * (1 - n * n)
            dz = new * (before - n) * z * (1 - z)
            dr = dn * a[:, 2 * HIDDEN :] * r * (1 - r)
            da = np.concatenate([dz, dr, dn * r], axis=1)
            dgates[t, :, i * 3 * HIDDEN : (i + 1) * 3 * HIDDEN] = np.concatenate([dz, dr, dn], axis=1)
            grad["u" + side] += before.T @ da
            back = new * z + da @ u.T
    dword = np.zeros((len(some), 6 * HIDDEN), np.float32)
    np.add.at(dword, inverse.reshape(-1), dgates.reshape(-1, 6 * HIDDEN))
    grad["wx"] = x.T @ dword
    dx = dword @ p["wx"].T
    three = g["three"][pick]
    have = three >= 0
    each = dx[:, None, 3 : 3 + CHAR] / np.maximum(have.sum(axis=1), 1)[:, None, None]
    np.add.at(grad["chars"], three[have], np.broadcast_to(each, (*three.shape, CHAR))[have])
    np.add.at(grad["own"], g["own"][pick], dx[:, 3 + CHAR : -1])
    return grad


def descend(net: Network, moment: dict, grad: dict[str, np.ndarray], rate: float, step: int) -> None:
    """One step of Adam."""
    for k, p in net.p.items():
        m, v = moment[k]
        m *= 0.9
        m += 0.1 * grad[k]
        v *= 0.98
        v += 0.02 * grad[k] ** 2
        p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-7)


class Scorer:
    """A worker's network with a bounded memory of words' gate inputs."""

    def __init__(self, net: Network, most: int = 150_000):
        self.net, self.most = net, most
        self.known: dict[str, int] = {"": 0}
        self.gates = np.zeros((1, 6 * HIDDEN), np.float32)

    def score(self, texts: list[str | None]) -> np.ndarray:
        net = self.net
        if net.head is None:
            return np.full(len(texts), net.prior)
        docs = [words_of(t) for t in texts]
        if len(self.known) > self.most:
            self.known, self.gates = {"": 0}, np.zeros((1, 6 * HIDDEN), np.float32)
        new = list(set().union(*docs).difference(self.known))
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            blocks = [net.gates_of(grams(new[at : at + 20_000])) for at in range(0, len(new), 20_000)]
            self.gates = np.concatenate([self.gates, *blocks])
        sizes = [len(d) for d in docs]
        ids = np.fromiter((self.known[w] for d in docs for w in d), np.int32, sum(sizes))
        text, start, length = net.windows(sizes)
        logits = net.score_windows(self.gates, ids, start, np.maximum(length, 0))
        score = sigmoid(net.figures(logits, text, len(docs)) @ net.head)
        score[np.array(sizes) == 0] = 0.0
        return score


def score(docs: DataFrame, net: Network, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with ``into`` (0 to 1; replaced if there) of the whole of each text; null, empty and wordless texts score 0.

    Every window of a text is scored, whatever its length; where nothing could be learned, each score, of wordless texts too, is the share of label 1.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    return common.with_score(docs, text, into, lambda: Scorer(shared.value).score)


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 3, kept_back: int = 1, per_class: int = 1500, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, by a network fitted on ``per_class`` documents of each class at most.

    A row is held out where crc32 of its doc_id's text, modulo ``modulus``, is ``kept_back``; one without doc_id is not, but nothing is
    learned from it.  Null, empty and wordless texts score 0 where anything could be learned, repeated rows keep their rows, an empty table gives an empty result, and
    other columns are ignored.
    """
    train = sampling.remainder(F.col("doc_id"), modulus) != kept_back
    net = sampling.fitted(*sampling.labelled(docs, labels, "toxic", train, per_class), fit)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = score(rows, net).select("doc_id", "score")
    return scored.select("doc_id", sampling.held_out(F.col("doc_id"), modulus, kept_back).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
