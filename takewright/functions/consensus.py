"""``sequences.consensus`` by columns: words as numbers, times as arrays, and one by one only what other hypotheses alone have."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import sequences as Q


@dataclass(frozen=True)
class Heard:
    """A hypothesis of a recording: numbers of its words, and a row a word of times and support."""

    kind: str
    model: str
    signal: str
    words: np.ndarray
    start_ms: np.ndarray
    end_ms: np.ndarray
    support: np.ndarray


@dataclass(frozen=True)
class Told:
    """The consensus: its words, and of the whole which hypothesis is the anchor and how many words were rejected, recovered and written otherwise."""

    anchor: str
    words: np.ndarray
    start_ms: np.ndarray
    end_ms: np.ndarray
    votes: np.ndarray
    confidence: np.ndarray
    rejected: int
    recovered: int
    fuzzy: int


def _marks(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words of at most 64 letters the letters, those that come twice, and the pairs of neighbours, as 64 bits each."""
    size = np.array([len(w) for w in words], np.int64)
    letters = np.zeros((int(size.max(initial=0)) + 1, len(words)), np.uint64)
    there = np.arange(len(letters))[:, None] < size
    letters.T[there.T] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    bits = lambda x, at: np.where(at, np.uint64(1) << (x & np.uint64(63)), np.uint64(0))
    once, twice = np.zeros((2, len(words)), np.uint64)
    for x in bits(letters, there):
        twice |= once & x
        once |= x
    return once, twice, np.bitwise_or.reduce(bits(letters[:-1] * np.uint64(37) + letters[1:], there[1:]), axis=0)


def compatible_pairs(media: list[list[str]]) -> list[np.ndarray]:
    """For each medium's distinct keys the pairs (x < y) of different ones that are ``sequences.compatible``, by place.

    Words are compared with those of their length and the next two; an edit adds or takes a letter and at most two pairs of neighbours, so that few pairs are left whose
    edits are counted, those of all media at once.
    """
    texts, medium, places, left, right = [], [], [], [], []
    for k, words in enumerate(media):
        long = sorted((len(w), x) for x, w in enumerate(words) if len(w) >= 4)
        texts += [words[x] for _, x in long]
        places += [x for _, x in long]
        medium += [k] * len(long)
    if not texts:
        return [np.zeros((0, 2), np.int64)] * len(media)
    size = np.array([len(w) for w in texts], np.int64)
    fits = size <= 64
    letters, twice, neighbours = _marks([w if len(w) <= 64 else "" for w in texts])
    medium, places = np.array(medium, np.int64), np.array(places, np.int64)
    # a few words are compared with all of their medium at once, of many those of a length with those that may be alike
    wide = int(size.max(initial=0)) + 3
    code = medium * wide + np.where(np.bincount(medium)[medium] > 512, size, 0)
    groups = np.flatnonzero(np.diff(code, prepend=-1))
    ends = np.searchsorted(medium * wide + size, medium[groups] * wide + np.where(code[groups] % wide > 0, size[groups] + 2, wide - 1), "right")
    most_of = np.where(size <= 4, 0, np.floor(0.28 * size + 1e-9)).astype(np.uint8)
    lacks = lambda marks, i, j: np.bitwise_count(marks[i] & ~marks[j])
    for first, upto, end in zip(groups.tolist(), [*groups[1:].tolist(), len(size)], ends.tolist(), strict=True):
        both = fits[first:end].all()
        for at in range(first, upto, 128):
            rows = slice(at, min(at + 128, upto))
            if both:
                x, y = letters[rows, None], letters[None, at:end]
                i, j = np.nonzero(np.maximum(np.bitwise_count(x & ~y), np.bitwise_count(~x & y)) <= most_of[at:end])
            else:
                i, j = (v.ravel() for v in np.indices((rows.stop - at, end - at)))
            i, j = i + at, j + at
            edits = most_of[j]
            some = (i < j) & (edits > 0) & (size[j] - size[i] <= 2)
            i, j, edits = i[some], j[some], edits[some]
            if both:
                some = np.maximum(lacks(neighbours, i, j), lacks(neighbours, j, i)) <= 2 * edits
                some &= np.maximum(lacks(letters, i, j) + lacks(twice, i, j), lacks(letters, j, i) + lacks(twice, j, i)) <= edits
                i, j = i[some], j[some]
            left.append(i)
            right.append(j)
    none = np.zeros(0, np.int64)
    left, right = np.concatenate([none, *left]), np.concatenate([none, *right])
    longest = np.maximum(size[left], size[right])
    alike = 1 - Q.edit_distances(texts, left, right) / longest >= np.where(longest <= 5, 0.8, 0.72) if len(left) else none.astype(bool)
    left, right = left[alike], right[alike]
    cuts = np.searchsorted(medium[left], np.arange(1, len(media)))
    return [np.stack([x, y], axis=1) for x, y in zip(np.split(places[left], cuts), np.split(places[right], cuts), strict=True)]


class Keys:
    """Of a medium's distinct words the numbers of their keys (0: nothing is left of it), and which keys are compatible."""

    def __init__(self, texts: list[str]):
        number = {"": 0}
        self.of = np.array([number.setdefault(w.lower() if w.isascii() and w.isalnum() else Q.word_key(w), len(number)) for w in texts], np.int64)
        self.words, self.count = list(number), len(number)

    def paired(self, pairs: np.ndarray) -> Keys:
        """These keys, of which ``pairs`` are compatible, as each but the empty one is with itself."""
        self.near = {x: [x] for x in range(1, self.count)}
        for x, y in pairs.tolist():
            self.near[x].append(y)
            self.near[y].append(x)
        self.pairs = {x * self.count + y for x, others in self.near.items() for y in others}
        self.codes = np.array(sorted(self.pairs), np.int64)
        return self

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        asked = a * self.count + b
        if not len(self.codes):
            return np.zeros(len(asked), bool)
        return self.codes[np.minimum(np.searchsorted(self.codes, asked), len(self.codes) - 1)] == asked


def _shared(a: list[int], b: list[int], near: dict[int, list[int]]) -> float:
    """``sequences.agreement`` of numbered keys."""
    if not a or not b:
        return 0.0
    at = Q._places(b)
    masks = {}
    for x in set(a):
        mask = 0
        for y in near[x]:
            mask |= at.get(y, 0)
        masks[x] = mask
    return Q.js_round(2 * Q.common_length([masks[x] for x in a], len(b)) / (len(a) + len(b)), 3)


def _near_in_time(start: np.ndarray, end: np.ndarray, start_: np.ndarray, end_: np.ndarray) -> np.ndarray:
    longest = np.maximum(end - start, end_ - start_)
    return np.abs((start + end) / 2 - (start_ + end_) / 2) <= np.maximum(450, np.minimum(1200, 1.5 * longest))


def _matches(a: Heard, b: Heard, keys: Keys) -> np.ndarray:
    """For each word of ``a`` the place in ``b`` that goes with it, or -1."""
    out = np.full(len(a.words), -1)
    if not len(b.words):
        return out
    twice, middle = b.start_ms + b.end_ms, a.start_ms + a.end_ms
    order = np.argsort(twice, kind="stable")
    low, high = np.searchsorted(twice[order], middle - 2400, "left"), np.searchsorted(twice[order], middle + 2400, "right")
    many = high - low
    i = np.repeat(np.arange(len(many)), many)
    j = order[np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)]
    like = keys.compatible(keys.of[a.words[i]], keys.of[b.words[j]])
    i, j = i[like], j[like]
    close = _near_in_time(a.start_ms[i], a.end_ms[i], b.start_ms[j], b.end_ms[j])
    masks = [0] * len(out)
    for x, y in zip(i[close].tolist(), j[close].tolist(), strict=True):
        masks[x] |= 1 << y
    pairs = Q.common_pairs(masks, len(b.words))
    if pairs:
        x, y = np.array(pairs).T
        out[x] = y
    return out


def _rounded(x: np.ndarray, digits: int = 0) -> np.ndarray:
    f = 10**digits
    return np.floor(x * f + 0.5) / f


def _sum(rows: np.ndarray) -> np.ndarray:
    """Of each row, as Python sums floats: with what each step loses added at last."""
    total, lost = rows[:, 0].copy(), np.zeros(len(rows))
    for x in rows[:, 1:].T:
        t = total + x
        lost += np.where(np.abs(total) >= np.abs(x), (total - t) + x, (x - t) + total)
        total = t
    return total + lost


def _middle(rows: np.ndarray, there: np.ndarray) -> np.ndarray:
    """The median of those of each row that are there."""
    x, n = np.sort(np.where(there, rows, np.inf), axis=1), there.sum(axis=1)
    each = np.arange(len(x))
    return (x[each, (n - 1) // 2] + x[each, n // 2]) / 2


def consensus_all(media: list[tuple[list[Heard], list[str]]]) -> list[Told]:
    """``sequences.consensus`` of each medium's hypotheses, whose words are numbers of its distinct words."""
    keys = [Keys(texts) for _, texts in media]
    return [consensus(hypotheses, k.paired(p)) for (hypotheses, _), k, p in zip(media, keys, compatible_pairs([k.words for k in keys]), strict=True)]


def consensus(hypotheses: list[Heard], keys: Keys) -> Told:
    """Of one medium, whose keys know their pairs."""
    said = [keys.of[h.words].tolist() for h in hypotheses]
    known = [[k for k in s if k] for s in said]
    shared = {(x, y): _shared(known[x], known[y], keys.near) for y in range(len(known)) for x in range(y)}

    def score(x: int) -> float:
        h = hypotheses[x]
        if not len(h.words):
            return -100.0
        others = [shared[min(x, y), max(x, y)] for y in range(len(hypotheses)) if y != x]
        bonus = 0.35 * (h.model == "base") + 0.12 * (h.signal == "spectral_vocal")
        return 3.4 * (sum(others) / len(others) if others else 0.5) + bonus - 1.2 * (Q.longest_run(said[x]) >= 4)

    best = max(range(len(hypotheses)), key=score)
    anchor, others = hypotheses[best], [h for x, h in enumerate(hypotheses) if x != best]
    matches = [_matches(anchor, h, keys) for h in others]
    place = np.stack([np.arange(len(anchor.words)), *matches], axis=1)
    there = place >= 0
    votes = there.sum(axis=1)
    kept = votes >= (2 if len(hypotheses) >= 3 else 1)
    place, there, votes, rejected = place[kept], there[kept], votes[kept], int((~kept).sum())
    every = [anchor, *others]
    column = lambda f, none: np.stack([np.where(there[:, k], getattr(h, f)[place[:, k]], none) if len(h.words) else np.full(len(place), none) for k, h in enumerate(every)], axis=1)
    words = column("words", -1)
    key = np.where(there, keys.of[words], -1)
    fuzzy = int((there & (key != key[:, :1])).sum())
    counts = ((key[:, :, None] == key[:, None, :]) & there[:, :, None]).sum(axis=2)
    word = words[np.arange(len(words)), (counts == counts.max(axis=1, initial=0)[:, None]).argmax(axis=1)]
    start = np.maximum(0, _rounded(_middle(column("start_ms", 0), there))).astype(np.int64)
    end = np.maximum(start + 1, _rounded(_middle(column("end_ms", 0), there))).astype(np.int64)
    support = _sum(column("support", 0.0)) / np.maximum(votes, 1)
    part = (votes - 1) / len(others) if others else np.full(len(votes), 0.5)
    confidence = _rounded(0.18 + 0.47 * part + 0.25 * support + (0.1 if anchor.model == "base" else 0.04), 3)
    more = _recovered(hypotheses, others, matches, len(anchor.words), keys) if len(hypotheses) >= 3 else []
    if more:
        word, start, end, votes, confidence = (np.concatenate([a, np.array(b)]) for a, b in zip((word, start, end, votes, confidence), zip(*more, strict=True), strict=True))
    order = np.lexsort((end, start))
    word, start, end, votes, confidence = word[order], start[order], end[order], votes[order], confidence[order]
    for k in np.flatnonzero(end[:-1] > start[1:]).tolist():
        edge = max(int(start[k]) + 1, min(int(end[k + 1]) - 1, int(Q.js_round((int(end[k]) + int(start[k + 1])) / 2))))
        end[k] = start[k + 1] = edge
    return Told(anchor.kind, word, start, end, votes, confidence, rejected, len(more), fuzzy)


def _recovered(hypotheses: list[Heard], others: list[Heard], matches: list[np.ndarray], length: int, keys: Keys) -> list[tuple]:
    """(word, start_ms, end_ms, votes, confidence) of words that the anchor does not have and two others share between the same of its words."""
    clusters: list[list[tuple]] = []
    of_gap: dict[int, list[list[tuple]]] = {}
    for x, (h, match) in enumerate(zip(others, matches, strict=True)):
        matched = np.flatnonzero(match >= 0)
        after = np.full(len(h.words) + 1, length)
        after[match[matched]] = matched
        free = np.ones(len(h.words), bool)
        free[match[matched]] = False
        gaps = np.minimum.accumulate(after[::-1])[::-1][1:]  # matches are in order
        free = np.flatnonzero(free)
        rows = zip(gaps[free].tolist(), h.words[free].tolist(), keys.of[h.words[free]].tolist(), h.start_ms[free].tolist(), h.end_ms[free].tolist(), h.support[free].tolist(), strict=True)
        for gap, word, key, start, end, support in rows:
            found = of_gap.setdefault(gap, [])
            for members in found:
                if members[-1][0] != x and any(key * keys.count + k in keys.pairs and abs((s + e) / 2 - (start + end) / 2) <= max(450, min(1200, 1.5 * max(end - start, e - s))) for _, _, k, s, e, _ in members):
                    members.append((x, word, key, start, end, support))
                    break
            else:
                clusters.append([(x, word, key, start, end, support)])
                found.append(clusters[-1])
    out = []
    for members in clusters:
        if len(members) < 2:
            continue
        liked = max(members, key=lambda m: 2 * (others[m[0]].model == "base") + (others[m[0]].signal == "spectral_vocal"))
        order = [liked, *(m for m in members if m is not liked)]
        same = [sum(o[2] == m[2] for o in order) for m in order]
        _, _, _, starts, ends, supports = zip(*members, strict=True)
        middle = lambda v: (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2
        start = max(0, int(Q.js_round(middle(sorted(starts)))))
        end = max(start + 1, int(Q.js_round(middle(sorted(ends)))))
        support = Q.js_round(sum(supports) / len(supports), 3)
        out.append((order[same.index(max(same))][1], start, end, len(members), Q.js_round(0.22 + 0.55 * len(members) / len(hypotheses) + 0.23 * support, 3)))
    return out
