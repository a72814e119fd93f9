"""Alignment of word sequences: one table of costs, call-site-specific ties."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from statistics import median

import numpy as np


def fold(text: str) -> str:
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not "̀" <= c <= "ͯ").lower()


@lru_cache(1 << 16)
def word_key(text: str) -> str:
    return re.sub(r"[\W_]", "", fold(text))


def js_round(x: float, digits: int = 0) -> float:
    f = 10**digits
    return float(int((x * f + 0.5) // 1)) / f


def _places(b: list[str] | str) -> dict[str, int]:
    """Each token's places in ``b`` as bits."""
    at: dict[str, int] = {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << j
    return at


def _edit_rows(a: list[str] | str, b: list[str] | str) -> Iterator[tuple[int, int, int, int]]:
    """The table of edit costs row by row as bits (Myers): where a row rises and falls along ``b``, and where above the row before."""
    at, ones = _places(b), (1 << len(b)) - 1
    rises, falls = ones, 0
    for x in a:
        same = at.get(x, 0)
        level = ((((same & rises) + rises) ^ rises) | same | falls) & ones
        higher, lower = falls | (ones & ~(level | rises)), level & rises
        left, drop = (higher << 1 | 1) & ones, (lower << 1) & ones
        rises, falls = drop | (ones & ~(level | left)), left & level
        yield rises, falls, higher, lower


def edit_distance(a: list[str] | str, b: list[str] | str) -> int:
    rises, falls = (1 << len(b)) - 1, 0
    for rises, falls, _, _ in _edit_rows(a, b):  # noqa: B007
        pass
    return len(a) + rises.bit_count() - falls.bit_count()


def similarity(a: str, b: str) -> float:
    longest = max(len(a), len(b))
    return 1 - edit_distance(a, b) / longest if longest else 0.0


def compatible(a: str, b: str) -> bool:
    """Equal and not empty; or of four letters, at most two longer or shorter, and alike enough for their length."""
    if not a or not b:
        return False
    longest = max(len(a), len(b))
    return a == b or (min(len(a), len(b)) >= 4 and abs(len(a) - len(b)) <= 2 and similarity(a, b) >= (0.8 if longest <= 5 else 0.72))


@lru_cache(1 << 16)
def _letters(word: str) -> int:
    return sum(1 << k for k in {ord(c) & 63 for c in word})


def _unlike(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of words a lower bound of their edits (letters that only one of them has) and the longer one's length."""

    def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return np.array([_letters(w) for w in words], np.uint64), np.array([len(w) for w in words], np.int64)

    (x, n), (y, m) = letters(a), letters(b)
    x, n = x[:, None], n[:, None]
    least = np.maximum(np.bitwise_count(x & ~y), np.bitwise_count(y & ~x)).astype(np.int64)
    return np.maximum(least, np.abs(n - m)), np.maximum(n, m)


def edit_distances(words: list[str], left: np.ndarray, right: np.ndarray, pairs: int = 4096) -> np.ndarray:
    """The edits between ``words`` number left[k] and right[k] for each k: Myers' rows for ``pairs`` of them at a time, a word of 64 bits each; longer words one by one."""
    out = np.zeros(len(left), np.int64)
    size = np.array([len(w) for w in words], np.int64)
    fits = (size[left] <= 64) & (size[right] <= 64) & (size[right] > 0)
    for k in np.flatnonzero(~fits).tolist():
        out[k] = edit_distance(words[left[k]], words[right[k]])
    fits = np.flatnonzero(fits)
    one = np.uint64(1)
    short = [w if len(w) <= 64 else "" for w in words]
    letters = np.zeros((len(words), max(map(len, short), default=0)), np.uint32)
    letters[np.arange(letters.shape[1]) < np.array([len(w) for w in short])[:, None]] = np.frombuffer("".join(short).encode("utf-32-le", "surrogatepass"), np.uint32)
    for k in range(0, len(fits), pairs):
        at = fits[k : k + pairs]
        at = at[np.argsort(-size[left[at]], kind="stable")]  # those that still have letters come first
        used, where = np.unique(np.concatenate([left[at], right[at]]), return_inverse=True)
        x, y, n = where[: len(at)], where[len(at) :], size[used]
        alphabet, codes = np.unique(letters[used], return_inverse=True)
        codes = codes.reshape(len(used), -1)
        places = np.zeros((len(used), len(alphabet)), np.uint64)  # of each letter in each word, as bits
        for q in range(int(n.max())):
            rows = np.flatnonzero(n > q)
            places[rows, codes[rows, q]] |= one << np.uint64(q)
        last = (n[y] - 1).astype(np.uint64)
        rises, falls, edits = np.full(len(at), ~np.uint64(0)), np.zeros(len(at), np.uint64), n[y].copy()
        for q in range(int(n[x].max())):
            m = int(np.searchsorted(-n[x], -q))  # pairs whose left word is longer than q
            same, r, f = places[y[:m], codes[x[:m], q]], rises[:m], falls[:m]
            level = (((same & r) + r) ^ r) | same
            higher, lower = f | ~(level | r), r & level
            edits[:m] += ((higher >> last[:m]) & one).astype(np.int64) - ((lower >> last[:m]) & one).astype(np.int64)
            higher, lower = (higher << one) | one, lower << one
            beside = same | f
            rises[:m], falls[:m] = lower | ~(beside | higher), higher & beside
        out[at] = edits
    return out


def compatible_words(words: Iterable[str], rows: int = 256) -> dict[str, list[str]]:
    """Each of the distinct words that are not empty with those that are compatible with it; ``rows`` words are compared at a time, with
    those alone that are at most two longer."""
    each = sorted({w for w in words if w}, key=lambda w: (len(w), w))
    found = {w: [w] for w in each}
    long = [w for w in each if len(w) >= 4]
    sizes = [len(w) for w in long]
    for k in range(0, len(long), rows):
        block = long[k : k + rows]
        others = long[k : bisect_right(sizes, len(block[-1]) + 2)]
        least, longest = _unlike(block, others)
        # no more edits than compatible() allows, of which the exact test is made only for these
        i, j = np.nonzero(least <= np.maximum(1, 0.28 * longest + 1e-9))
        i, j = i[i < j], j[i < j]
        top = longest[i, j]
        alike = 1 - edit_distances(others, i, j) / top >= np.where(top <= 5, 0.8, 0.72)
        for x, y in zip(i[alike].tolist(), j[alike].tolist(), strict=True):
            if sizes[k + y] - sizes[k + x] <= 2:
                found[others[x]].append(others[y])
                found[others[y]].append(others[x])
    return found


def compatible_masks(a: list[str], b: list[str], near: dict[str, list[str]]) -> list[int]:
    """For each word of ``a`` the places in ``b`` of the words that are compatible with it, as bits."""
    at = _places(b)
    masks = {}
    for x in set(a):
        masks[x] = 0
        for y in near.get(x, []):
            masks[x] |= at.get(y, 0)
    return [masks[x] for x in a]


def _near_in_time(a: dict, b: dict) -> bool:
    longest = max(a["end_ms"] - a["start_ms"], b["end_ms"] - b["start_ms"])
    return abs((a["start_ms"] + a["end_ms"]) / 2 - (b["start_ms"] + b["end_ms"]) / 2) <= max(450, min(1200, 1.5 * longest))


def compatible_timings(a: dict, b: dict) -> bool:
    """Compatible words whose middles are near, measured by the longer of them."""
    return compatible(word_key(a["word"]), word_key(b["word"])) and _near_in_time(a, b)


def timing_masks(a: list[dict], b: list[dict], near: dict[str, list[str]]) -> list[int]:
    """For each word of ``a`` the places in ``b`` of compatible timings; only middles within 1200 ms are looked at, as none is farther."""
    order = sorted(range(len(b)), key=lambda j: b[j]["start_ms"] + b[j]["end_ms"])
    twice = [b[j]["start_ms"] + b[j]["end_ms"] for j in order]
    keys = [word_key(w["word"]) for w in b]
    masks = []
    for w in a:
        middle, like, mask = w["start_ms"] + w["end_ms"], near.get(word_key(w["word"]), []), 0
        for j in order[bisect_left(twice, middle - 2400) : bisect_right(twice, middle + 2400)]:
            if keys[j] in like and _near_in_time(w, b[j]):
                mask |= 1 << j
        masks.append(mask)
    return masks


def _common_rows(masks: list[int], m: int) -> Iterator[int]:
    """The table of common lengths row by row as bits, which are 0 where a row rises."""
    ones = (1 << m) - 1
    row = ones
    for mask in masks:
        both = row & mask
        row = ((row + both) | (row - both)) & ones
        yield row


def common_length(masks: list[int], m: int) -> int:
    row = (1 << m) - 1
    for row in _common_rows(masks, m):  # noqa: B007
        pass
    return m - row.bit_count()


def common_pairs(masks: list[int], m: int) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence, traced back from the end; ``masks`` has the places among ``m`` that go with each
    item, as bits.

    At a match the trace goes diagonally; else up on equal lengths.  The table takes a bit a cell; the length where the trace stands is
    known, so that bits are counted only where neither of them tells the way.
    """
    rows = [(1 << m) - 1, *_common_rows(masks, m)]
    pairs, i, j = [], len(masks), m
    here = m - rows[i].bit_count()
    while here:
        if masks[i - 1] >> (j - 1) & 1:
            i, j, here = i - 1, j - 1, here - 1
            pairs.append((i, j))
        elif not rows[i] >> (j - 1) & 1 or j - (rows[i - 1] & (1 << j) - 1).bit_count() == here:
            i -= 1
        else:
            j -= 1
    return pairs[::-1]


def transcript_match(expected: list[str], observed: list[str]) -> dict:
    """1 - edits / longest to two places; words missing and extra as differences of bags."""
    if not observed:
        return {"score": 0.0, "source": "prompt_only", "missing": [], "extra": []}
    score = 1 - edit_distance(expected, observed) / max(len(expected), len(observed), 1)
    missing, extra = Counter(expected) - Counter(observed), Counter(observed) - Counter(expected)
    return {"score": js_round(max(0.0, score), 2), "source": "web_speech", "missing": list(missing.elements()), "extra": list(extra.elements())}


def agreement(a: list[str], b: list[str], near: dict[str, list[str]] | None = None) -> float:
    """Dice's measure over a fuzzy longest common subsequence, to three places; ``near``: compatible_words of both, if known."""
    if not a or not b:
        return 0.0
    near = compatible_words([*a, *b]) if near is None else near
    shared = common_length(compatible_masks(a, b, near), len(b))
    return js_round(2 * shared / (len(a) + len(b)), 3)


def compare_timings(estimated: list[dict], heard: list[dict]) -> dict:
    """Boundary differences of words that two timings share, and how good that is."""
    number = {"": 0}
    keys = [[number.setdefault(word_key(w["word"]), len(number)) for w in words] for words in (estimated, heard)]
    times = [np.array([(w["start_ms"], w["end_ms"]) for w in words], np.int64).reshape(-1, 2) for words in (estimated, heard)]
    return compare_numbered(*keys, *times)


def compare_numbered(a: list[int], b: list[int], told: np.ndarray, heard: np.ndarray) -> dict:
    """``compare_timings`` of the numbers of words' keys (0: nothing of it is left) and of their boundaries, a row a word."""
    at = _places(b) | {0: 0}
    pairs = np.array(common_pairs([at.get(x, 0) for x in a], len(b)), np.int64).reshape(-1, 2)
    gaps = np.abs(told[pairs[:, 0]] - heard[pairs[:, 1]]).max(axis=1)
    rate = js_round(len(pairs) / max(len(a), len(b), 1), 3)
    middle = float(np.median(gaps)) if len(gaps) else None
    status = "insufficient" if rate < 0.7 or not len(gaps) else "strong" if middle <= 80 else "acceptable" if middle <= 180 else "review"
    return {"match_rate": rate, "median_ms": middle, "maximum_ms": float(gaps.max()) if len(gaps) else None, "status": status}


@lru_cache(1 << 16)
def token_similarity(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    short, longest = min(len(a), len(b)), max(len(a), len(b))
    if a.startswith(b) or b.startswith(a):
        return max(0.5, short / longest)
    d = edit_distance(a, b)
    return 1 - d / longest if d <= max(2, -(-45 * longest // 100)) else 0.0


def _similarities(sides: list[tuple[list[str], list[str]]]) -> list[np.ndarray]:
    """For two lists of distinct words the similarity of each pair, or 0 where it is below 0.5; the edits of all lists' pairs at once."""
    number: dict[str, int] = {}
    asked, left, right = [], [], []
    for a, b in sides:
        least, longest = _unlike(a, b)
        i, j = np.nonzero((2 * least <= longest) & (longest > 0))
        asked.append((i, j, longest[i, j]))
        left.append(np.array([number.setdefault(w, len(number)) for w in a], np.int64)[i])
        right.append(np.array([number.setdefault(w, len(number)) for w in b], np.int64)[j])
    edits, at, out = edit_distances(list(number), np.concatenate(left), np.concatenate(right)), 0, []
    for (a, b), (i, j, longest) in zip(sides, asked, strict=True):
        d = edits[at : at + len(i)]
        at += len(i)
        s = np.where(d <= np.maximum(2, -(-45 * longest // 100)), 1 - d / longest, 0.0)
        alike = np.zeros((len(a), len(b)))
        alike[i, j] = np.where(s >= 0.5, s, 0.0)
        rows, columns = {x: k for k, x in enumerate(a)}, {y: k for k, y in enumerate(b)}
        for x, k in rows.items():  # beginnings of each other are alike whatever their lengths
            for n in range(1, len(x) + 1):
                if x[:n] in columns:
                    alike[k, columns[x[:n]]] = max(0.5, n / len(x))
        for y, k in columns.items():
            for n in range(1, len(y)):
                if y[:n] in rows:
                    alike[rows[y[:n]], k] = max(0.5, n / len(y))
        out.append(alike)
    return out


def align_spoken(prompt: list[str], spoken: list[str]) -> dict:
    """``align_all`` of one pair."""
    return align_all([(prompt, spoken)])[0]


def align_all(pairs: list[tuple[list[str], list[str]]], cells: int = 1 << 21) -> list[dict]:
    """Global alignment of what was said with a prompt of which only the beginning may be said, for each pair of (prompt, spoken).

    Match 0.35 + similarity from 0.5 on, else -0.82; a prompt word skipped -0.34, a spoken one -0.58.  The best end in the last
    column counts, the later of equals.  Pairs of like lengths are aligned together, as long as their tables have ``cells`` bytes at most.
    """
    out = [{"coverage": 0.0, "matched": 0, "position": 0, "score": 0.0} for _ in pairs]
    order = sorted((k for k, (a, b) in enumerate(pairs) if a and b), key=lambda k: (len(pairs[k][0]) + len(pairs[k][1]), len(pairs[k][0])))
    group: list[int] = []
    n = m = 0
    for k in order:
        a, b = pairs[k]
        if group and (len(group) + 1) * (max(n, len(a)) + 1) * (max(m, len(b)) + 1) > cells:
            for g, found in zip(group, _aligned([pairs[g] for g in group]), strict=True):
                out[g] = found
            group, n, m = [], 0, 0
        group.append(k)
        n, m = max(n, len(a)), max(m, len(b))
    if group:
        for g, found in zip(group, _aligned([pairs[g] for g in group]), strict=True):
            out[g] = found
    return out


def _aligned(pairs: list[tuple[list[str], list[str]]]) -> list[dict]:
    """Tables of all pairs by anti-diagonals, whose cells do not depend on each other; of the costs two diagonals and the last columns stay."""
    sides = [(sorted(set(a)), sorted(set(b))) for a, b in pairs]
    tables = _similarities(sides)
    count, n, m = len(pairs), max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs)
    gains = np.concatenate([np.where(t >= 0.5, 0.35 + t, -0.82).ravel() for t in tables])
    down, along, starts, at = np.zeros((count, n), np.int64), np.zeros((count, m), np.int64), [], 0
    for k, ((a, b), (x, y), t) in enumerate(zip(pairs, sides, tables, strict=True)):
        rows, columns = {w: i for i, w in enumerate(x)}, {w: j for j, w in enumerate(y)}
        down[k, : len(a)] = np.array([rows[w] for w in a]) * len(y) + at
        along[k, : len(b)] = [columns[w] for w in b]
        starts.append(at)
        at += t.size
    width = np.array([len(b) for _, b in pairs])
    height = np.array([len(a) for a, _ in pairs])
    top, side = np.concatenate([[0.0], np.cumsum(np.full(m, -0.58))]), np.concatenate([[0.0], np.cumsum(np.full(n, -0.34))])
    step = np.zeros((count, n + 1, m + 1), np.int8)
    step[:, 1:, 0], step[:, 0, 1:] = 1, 2
    last = np.full((count, n + 1), -np.inf)  # of each row the cost in the pair's last column
    last[:, 0] = top[width]
    each = np.arange(count)
    before, here = np.full((count, n + 1), -np.inf), np.full((count, n + 1), -np.inf)  # diagonals d - 2 and d - 1, by row
    before[:, 0] = 0.0
    here[:, 0], here[:, 1] = top[1], side[1]
    for d in range(2, n + m + 1):
        low, high = max(1, d - m), min(n, d - 1)
        i = slice(low, high + 1)
        j = d - np.arange(low, high + 1)
        gain = gains[np.minimum(down[:, low - 1 : high] + along[:, j - 1], len(gains) - 1)]
        match, skip, insert = before[:, low - 1 : high] + gain, here[:, low - 1 : high] - 0.34, here[:, i] - 0.58
        now = np.full((count, n + 1), -np.inf)
        now[:, i] = np.maximum(np.maximum(match, skip), insert)
        step[:, np.arange(low, high + 1), j] = np.where((match >= skip) & (match >= insert), 0, np.where(skip >= insert, 1, 2))
        if d <= m:
            now[:, 0] = top[d]
        if d <= n:
            now[:, d] = side[d]
        row = d - width  # where the diagonal meets the pair's last column
        meets = (row >= 1) & (row <= height)
        last[each[meets], row[meets]] = now[each[meets], row[meets]]
        before, here = here, now
    out = []
    for k, ((a, b), t) in enumerate(zip(pairs, tables, strict=True)):
        ends = last[k, : len(a) + 1]
        i, j = len(a) - int(ends[::-1].argmax()), len(b)
        ways, rows, columns = step[k], down[k], along[k]
        flat, first = t.ravel(), starts[k]
        matched, total, position = 0, 0.0, None
        while i or j:
            way = ways[i, j]
            if way == 0:
                s = float(flat[rows[i - 1] - first + columns[j - 1]])
                if s >= 0.5:
                    matched, total = matched + 1, total + s
                    position = i - 1 if position is None else position
                i, j = i - 1, j - 1
            elif way == 1:
                i -= 1
            else:
                j -= 1
        out.append({"coverage": matched / len(a), "matched": matched, "position": position or 0, "score": total / len(b)})
    return out


def merge_transcripts(a: str, b: str, most: int = 12) -> str:
    """``b`` after ``a`` without the longest run of words, up to ``most``, that ends the one and begins the other."""
    left, right = a.split(), b.split()
    x, y = [word_key(w) for w in left], [word_key(w) for w in right]
    for n in range(min(most, len(x), len(y)), 0, -1):
        if x[-n:] == y[:n]:
            return " ".join([*left, *right[n:]])
    return " ".join([*left, *right])


def edit_operations(a: list[str], b: list[str]) -> list[tuple[str, int, int]]:
    """Operations from ``a`` to ``b``; the trace prefers match, substitution, deletion, insertion."""
    rows = [((1 << len(b)) - 1, 0, 0, 0), *_edit_rows(a, b)]
    out, i, j = [], len(a), len(b)

    def bit(k: int, what: int) -> int:
        return rows[k][what] >> (j - 1) & 1

    while i or j:
        if i and j and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append(("match", i, j))
        elif i and j and bit(i, 2) - bit(i, 3) + bit(i - 1, 0) - bit(i - 1, 1) == 1:
            i, j = i - 1, j - 1
            out.append(("substitute", i, j))
        elif i and (not j or bit(i, 2)):
            i -= 1
            out.append(("delete", i, -1))
        else:
            j -= 1
            out.append(("insert", -1, j))
    return out[::-1]


def error_rates(reference: list[str], predicted: list[str]) -> dict:
    """Word and character error rates and the part of reference words found, to three places."""
    a, b = [word_key(w) for w in reference], [word_key(w) for w in predicted]
    ops = Counter(o for o, _, _ in edit_operations(a, b))
    wrong = ops["substitute"] + ops["delete"] + ops["insert"]
    left, right = "".join(a), "".join(b)
    return {"wer": js_round(wrong / max(1, len(a)), 3), "cer": js_round(edit_distance(left, right) / max(1, len(left)), 3), "matched": js_round(ops["match"] / max(1, len(a)), 3)}


def longest_run(words: list[str]) -> int:
    best = run = 0
    last = None
    for w in words:
        run = run + 1 if w and w == last else int(bool(w))
        best, last = max(best, run), w
    return best


def consensus(hypotheses: list[dict]) -> dict:
    """One word list of several hypotheses of a recording.

    A hypothesis has kind, model, signal, words (word, start_ms, end_ms, support) and optionally overlap, acceptance, status,
    density.  The best scored is the anchor; words that others share are voted on, with three or more hypotheses at least two votes
    are needed, and words that two others share between anchor words are recovered.
    """
    mean = lambda xs: sum(xs) / len(xs) if xs else 0.0
    keys_of = {id(h): [word_key(w["word"]) for w in h["words"]] for h in hypotheses}
    near = compatible_words(k for keys in keys_of.values() for k in keys)

    def score(h: dict) -> float:
        if not h["words"]:
            return -100.0
        keys = keys_of[id(h)]
        others = [o for o in hypotheses if o is not h]
        shared = mean([agreement([k for k in keys if k], [k for k in keys_of[id(o)] if k], near) for o in others]) if others else 0.5
        bonus = 0.65 * (h.get("status") == "review") + 0.35 * (h["model"] == "base") + 0.12 * (h["signal"] == "spectral_vocal")
        return 3.4 * shared + 0.9 * h.get("overlap", 0) + 0.7 * h.get("acceptance", 0) + bonus - 1.2 * (longest_run(keys) >= 4) - 1.4 * (h.get("density", 0) > 320)

    def mode(first: dict, others: list[dict]) -> str:
        counts = Counter(word_key(w["word"]) for w in (first, *others))
        top = max(counts.values())
        return next(w["word"] for w in (first, *others) if counts[word_key(w["word"])] == top)

    def voted(words: list[dict], first: dict, confidence: float) -> dict:
        start = max(0, int(js_round(median(w["start_ms"] for w in words))))
        end = max(start + 1, int(js_round(median(w["end_ms"] for w in words))))
        return {"word": mode(first, [w for w in words if w is not first]), "start_ms": start, "end_ms": end, "votes": len(words), "confidence": js_round(confidence, 3)}

    anchor = max(hypotheses, key=score)
    others = [h for h in hypotheses if h is not anchor]
    aligned = [(h, dict(common_pairs(timing_masks(anchor["words"], h["words"], near), len(h["words"])))) for h in others]
    out, rejected, fuzzy = [], 0, 0
    for i, word in enumerate(anchor["words"]):
        same = [h["words"][m[i]] for h, m in aligned if i in m]
        if 1 + len(same) < (2 if len(hypotheses) >= 3 else 1):
            rejected += 1
            continue
        fuzzy += sum(word_key(w["word"]) != word_key(word["word"]) for w in same)
        part = len(same) / len(others) if others else 0.5
        support = mean([w.get("support", 0.0) for w in (word, *same)])
        out.append(voted([word, *same], word, 0.18 + 0.47 * part + 0.25 * support + (0.1 if anchor["model"] == "base" else 0.04)))
    clusters: list[list[tuple[dict, dict]]] = []
    of_gap: dict[int, list[list[tuple[dict, dict]]]] = {}
    for h, m in aligned if len(hypotheses) >= 3 else []:
        taken = {j: i for i, j in m.items()}
        gap, gaps = len(anchor["words"]), {}
        for j in range(len(h["words"]) - 1, -1, -1):
            gaps[j] = gap
            gap = taken.get(j, gap)
        for j, word in enumerate(h["words"]):
            if j in taken:
                continue
            for members in of_gap.get(gaps[j], []):
                if all(o is not h for o, _ in members) and any(compatible_timings(w, word) for _, w in members):
                    members.append((h, word))
                    break
            else:
                clusters.append([(h, word)])
                of_gap.setdefault(gaps[j], []).append(clusters[-1])
    recovered = 0
    for members in clusters:
        if len(members) > 1:
            recovered += 1
            first = max(members, key=lambda x: 2 * (x[0]["model"] == "base") + (x[0]["signal"] == "spectral_vocal"))[1]
            words = [w for _, w in members]
            support = js_round(mean([w.get("support", 0.0) for w in words]), 3)
            out.append(voted(words, first, 0.22 + 0.55 * len(members) / len(hypotheses) + 0.23 * support))
    out.sort(key=lambda w: (w["start_ms"], w["end_ms"]))
    for a, b in zip(out, out[1:], strict=False):
        if a["end_ms"] > b["start_ms"]:
            edge = max(a["start_ms"] + 1, min(b["end_ms"] - 1, int(js_round((a["end_ms"] + b["start_ms"]) / 2))))
            a["end_ms"] = b["start_ms"] = edge
    return {"anchor": anchor["kind"], "words": out, "rejected": rejected, "recovered": recovered, "fuzzy": fuzzy, "confidence": js_round(mean([w["confidence"] for w in out]), 3)}
