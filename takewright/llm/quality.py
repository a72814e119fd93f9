"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, sampling
from .toxicity import logistic, sigmoid

#: Classes of characters: other, letter, capital, digit, space, sentence mark, exclamation, bar, symbol.
OTHER, LETTER, CAPITAL, DIGIT, SPACE, MARK, SHOUT, BAR, SYMBOL = range(9)
FIGURES = 24


def _classes() -> np.ndarray:
    kinds = np.full(0x250, OTHER, np.uint8)
    for c in range(0x250):
        x = chr(c)
        kinds[c] = LETTER if x.islower() else CAPITAL if x.isalpha() else DIGIT if x.isdigit() else SPACE if x.isspace() else kinds[c]
    for some, kind in ((".,;:?'\"-()", MARK), ("!", SHOUT), ("|", BAR), ("#$%&*@<>{}[]\\^~_=+/", SYMBOL)):
        kinds[[ord(x) for x in some]] = kind
    return kinds


CLASSES = _classes()


def lines_of(text: str | None) -> list[str]:
    return (text or "").split("\n")


def figures(lines: list[str]) -> np.ndarray:
    """Raw features of each line by itself."""
    codes = np.frombuffer("\n".join([*lines, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(x) + 1 for x in lines])
    starts = np.cumsum(sizes) - sizes
    kinds = np.where(codes < 0x250, CLASSES[np.minimum(codes, 0x24F)], LETTER).astype(np.uint8)
    n = np.maximum(sizes - 1, 1)
    share = np.stack([np.add.reduceat((kinds == k).astype(np.int32), starts) for k in range(9)], axis=1) / n[:, None]
    share[:, SPACE] -= 1 / n
    count, unique, again, capital = (np.zeros(len(lines)) for _ in range(4))
    for i, line in enumerate(lines):
        words = line.split()
        count[i], unique[i] = len(words), len(set(words))
        again[i] = sum(map(str.__eq__, words[1:], words))
        capital[i] = line[:1].isupper()
    least = np.maximum(count, 1)
    last = codes[np.maximum(starts + sizes - 2, 0)]
    ends = np.isin(last, [ord("."), ord("!"), ord("?")]) & (sizes > 1)
    extra = np.stack([unique / least, again / least, np.minimum(1, count / 5), np.log1p(count) / 5, np.log1p(sizes) / 8, np.minimum(3, sizes / least / 8), ends, capital, sizes == 1], axis=1)
    steep = np.minimum(1, 15 * share[:, [CAPITAL, DIGIT, SHOUT, BAR, SYMBOL, OTHER]])
    return np.concatenate([share, extra, steep], axis=1)


def neighbours(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A line's features with those of the lines before and after it in its document, whether there are such, and a constant."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    same = np.r_[doc[1:] == doc[:-1], False][:, None]
    after = np.concatenate([x[1:], x[-1:]]) * same
    earlier = np.r_[False, doc[1:] == doc[:-1]][:, None]
    before = np.concatenate([x[:1], x[:-1]]) * earlier
    return np.concatenate([x, before, after, same, earlier, np.ones((len(x), 1))], axis=1)


@dataclass
class Field:
    """Weights of the two states' line features and of the four transitions; and of the document's figures."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray  # (features, 2)
    move: np.ndarray  # (2, 2), from row to column
    head: np.ndarray | None = None
    prior: float = 0.5

    def inputs(self, lines: list[str], sizes: np.ndarray) -> np.ndarray:
        return neighbours(np.clip((figures(lines) - self.mean) / self.scale, -4, 4), sizes)


def forward_backward(unary: np.ndarray, move: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of the states (line, 2), summed expected transitions (2, 2), and log of the partition function, of all documents at once.

    unary: log-potentials of lines that lie end to end; documents are stepped through together, longest first.
    """
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    longest = int(sizes.max(initial=0))
    alive = [int(np.searchsorted(-sizes[order], -t, "left")) for t in range(longest)]  # documents with more than t lines
    m = np.exp(move - move.max())
    top = unary.max(axis=1, keepdims=True)
    u = np.exp(unary - top)
    alpha, scales = np.empty_like(u), np.empty(len(u))
    for t in range(longest):
        at = starts[: alive[t]] + t
        a = u[at] if not t else (alpha[at - 1] @ m) * u[at]
        scales[at] = s = a.sum(axis=1)
        alpha[at] = a / s[:, None]
    beta, expected = np.ones_like(u), np.zeros((2, 2))
    for t in range(longest - 1, 0, -1):
        at = starts[: alive[t]] + t
        b = u[at] * beta[at] / scales[at][:, None]
        beta[at - 1] = b @ m.T
        expected += m * (alpha[at - 1].T @ b)
    marginal = alpha * beta
    marginal /= marginal.sum(axis=1, keepdims=True)
    return marginal, expected, float(np.log(scales).sum() + top.sum() + (len(unary) - len(sizes)) * move.max())


def train(x: np.ndarray, states: np.ndarray, sizes: np.ndarray, weight: np.ndarray, rounds: int = 120, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Maximise the (document-weighted) likelihood of line states, by Adam on all documents."""
    w, move = np.zeros((x.shape[1], 2)), np.zeros((2, 2))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    inner = np.setdiff1d(np.arange(len(doc)), starts)
    seen = np.zeros((2, 2))
    np.add.at(seen, (states[inner - 1], states[inner]), 1)
    truth = np.eye(2)[states]
    each = (weight / np.maximum(sizes, 1))[doc][:, None]
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(move), np.zeros_like(move)]
    for step in range(1, rounds + 1):
        marginal, expected, _ = forward_backward(x @ w, move, sizes)
        slopes = (x.T @ ((marginal - truth) * each) / weight.sum() + ridge * w, (expected - seen) / max(1, len(inner)) + ridge * move)
        for i, (value, slope) in enumerate(zip((w, move), slopes, strict=True)):
            m, v = moments[2 * i], moments[2 * i + 1]
            m += 0.1 * (slope - m)
            v += 0.02 * (slope**2 - v)
            value -= 0.08 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-8)
    return w, move


def summary(good: np.ndarray, lines: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each document: the length-weighted mean marginal of a good line, its log-odds, that of the logs, the log of its length, 1."""
    starts = np.cumsum(sizes) - sizes
    total = np.add.reduceat(lines, starts)
    mean = np.add.reduceat(good * lines, starts) / total
    deep = np.add.reduceat(np.log(good + 1e-3) * lines, starts) / total
    clipped = np.clip(mean, 1e-3, 1 - 1e-3)
    return np.stack([mean, np.log(clipped / (1 - clipped)) / 4, deep / 4, np.log(total) / 8, np.ones(len(sizes))], axis=1)


def lay_out(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    docs = [lines_of(t) for t in texts]
    lines = [x for d in docs for x in d]
    return lines, np.array([len(d) for d in docs]), np.array([len(x) + 1.0 for x in lines])


def fit(sample: list[tuple[str, int]], prior: float, passes: int = 3) -> Field:
    """Learn from texts labelled 1 (good) or 0.

    Lines have no labels of their own: those of good texts are good, those of bad texts are bad at first; then, between passes, lines
    of bad texts whose marginal says good become good, but for the worst line of each.
    """
    y = np.array([label for _, label in sample])
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    if len(set(y.tolist())) < 2:
        return Field(np.zeros(FIGURES), np.ones(FIGURES), np.zeros((0, 2)), np.zeros((2, 2)), None, prior)
    lines, sizes, long = lay_out([t for t, _ in sample])
    raw = figures(lines)
    field = Field(raw.mean(axis=0), raw.std(axis=0) + 1e-3, np.zeros((0, 2)), np.zeros((2, 2)), None, prior)
    x = neighbours(np.clip((raw - field.mean) / field.scale, -4, 4), sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    weight = np.array([0.5 / max(1, (y == 0).sum()), 0.5 / max(1, (y == 1).sum())])[y] * len(y)
    states = y[doc].copy()
    starts = np.cumsum(sizes) - sizes
    for k in range(passes):
        field.w, field.move = train(x, states, sizes, weight)
        good = forward_backward(x @ field.w, field.move, sizes)[0][:, 1]
        if k < passes - 1:
            worst = good == np.minimum.reduceat(good, starts)[doc]
            states = np.where((y[doc] == 0) & ((good < 0.6) | worst), 0, 1)
    share = np.array([(1 - prior) / max(1, (y == 0).sum()), prior / max(1, (y == 1).sum())])[y] * len(y)
    field.head = logistic(summary(good, long, sizes), y, share)
    return field


def score_texts(field: Field, texts: list[str | None]) -> np.ndarray:
    if field.head is None:
        return np.full(len(texts), field.prior)
    lines, sizes, long = lay_out(texts)
    marginal, _, _ = forward_backward(field.inputs(lines, sizes) @ field.w, field.move, sizes)
    return sigmoid(summary(marginal[:, 1], long, sizes) @ field.head)


def score(docs: DataFrame, field: Field, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with ``into`` (0 to 1; replaced if there) of the whole of each text; a null text counts as one empty line.

    Where nothing could be learned (no labels, or of one class alone), each score is the share of label 1, or a half.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    return common.with_score(docs, text, into, lambda: lambda texts: score_texts(shared.value, texts))


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 5, kept_back: int = 0, per_class: int = 2000, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, by a field fitted on ``per_class`` documents of each class at most.

    A row is held out where crc32 of its doc_id's text, modulo ``modulus``, is ``kept_back``; one without doc_id is not, but nothing is
    learned from it.  A null or empty text scores as one empty line, repeated rows keep their rows, an empty table gives an empty result, and other columns are ignored.
    """
    train_rows = sampling.remainder(F.col("doc_id"), modulus) != kept_back
    field = sampling.fitted(*sampling.labelled(docs, labels, "quality", train_rows, per_class), fit)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = score(rows, field).select("doc_id", "score")
    return scored.select("doc_id", sampling.held_out(F.col("doc_id"), modulus, kept_back).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
