"""Rule-based phonemes of French and English words, and their intervals."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequences import fold, js_round

#: Spellings of French sounds, the first that fits counts; None is silent.
FRENCH = {
    "eaux": "o", "eau": "o", "aux": "o", "au": "o", "ain": "in", "ein": "in", "aim": "in", "eim": "in", "ien": "in", "oin": "oin", "an": "an", "am": "an", "en": "an", "em": "an", "on": "on", "om": "on", "ou": "ou",
    "oi": "wa", "ui": "ui", "eu": "eu", "oeu": "eu", "ill": "j", "gn": "gn", "ch": "sh", "ph": "f", "th": "t", "qu": "k", "gu": "g", "ss": "s", "er": "e", "ez": "e", "es": "e", "ent": None,
}
#: Single French letters whose sound is not their own; h is silent.
FRENCH_LETTERS = {c: c for c in "abdefgiklmnoprstuvwz"} | {"c": "k", "j": "zh", "q": "k", "x": "ks", "y": "i"}
#: Spellings of English sounds, the first that fits counts.
ENGLISH = {
    "tion": "SH AH N", "sion": "ZH AH N", "ough": "OW", "igh": "AY", "air": "EH R", "ear": "IH R", "th": "TH", "sh": "SH", "ch": "CH", "ng": "NG", "ph": "F", "wh": "W", "ck": "K", "qu": "K W", "ee": "IY",
    "ea": "IY", "oo": "UW", "ou": "AW", "ow": "AW", "oy": "OY", "oi": "OY", "ay": "EY", "ai": "EY", "er": "ER", "ar": "AA R", "or": "AO R",
}
#: Single English letters whose sound is not their own capital; x is one sound of two.
ENGLISH_LETTERS = {c: c.upper() for c in "bdfgklmnprstvwyz"} | {"a": "AE", "c": "K", "e": "EH", "h": "HH", "i": "IH", "j": "JH", "o": "AA", "q": "K", "u": "AH", "x": "K S"}

_FR = re.compile("|".join(FRENCH) + "|.", re.S)
_EN = re.compile("|".join(ENGLISH) + "|.", re.S)


def normalize_token(text: str) -> str:
    kept = re.sub(r"[^a-z0-9'.-]+", "", fold(re.sub("[’ʼ`]", "'", text)))
    return re.sub(r"^[^a-z0-9]+|[^a-z0-9]+$", "", kept)


def french(word: str) -> list[str]:
    found = [FRENCH.get(x, FRENCH_LETTERS.get(x)) for part in word.split("'") for x in _FR.findall(part)]
    return [p for p in found if p] or ["spn"]


def english(word: str) -> list[str]:
    out: list[str] = []
    for x in _EN.findall(re.sub("([aeiou])e$", r"\1", word)):
        if x in ENGLISH:
            out += ENGLISH[x].split(" ")
        elif x in ENGLISH_LETTERS:
            out.append(ENGLISH_LETTERS[x])
    return out or ["SPN"]


def phonemes(word: str, language: str) -> list[str]:
    return french(word) if language == "fr" else english(word)


#: How long kinds of sounds last against each other.
VOWEL = re.compile("^(a|aa|ae|ah|ao|aw|ay|eh|er|ey|ih|iy|oh|ow|oy|uh|uw|an|in|on|eu|oe|ou)$", re.I)
STOP = re.compile("^(p|t|k|b|d|g|P|T|K|B|D|G)$")
FRICATIVE = re.compile("^(s|z|sh|zh|f|v|S|Z)$")


def weight(phone: str) -> float:
    return 1.25 if VOWEL.match(phone) else 0.72 if STOP.match(phone) else 1.05 if FRICATIVE.match(phone) else 1.0


def weight_column(phone: Column) -> Column:
    """``weight`` as a column expression."""
    return F.when(phone.rlike("(?i)" + VOWEL.pattern), 1.25).when(phone.rlike(STOP.pattern), 0.72).when(phone.rlike(FRICATIVE.pattern), 1.05).otherwise(1.0)


def intervals(phones: list[str], start: float, end: float) -> list[tuple[str, int, int]]:
    """Proportional parts of [start, end]; each rounded end starts the next, the last one is the end."""
    total, length, at, out = sum(map(weight, phones)), max(1, end - start), start, []
    for i, p in enumerate(phones):
        begin = int(js_round(at))
        at = end if i == len(phones) - 1 else js_round(at + length * weight(p) / total)
        out.append((p, begin, int(at)))
    return out


def syllables(word: str, language: str) -> int:
    bare = re.sub("[^a-z]", "", word)
    n = len(re.findall("[aeiouy]+", bare))
    return max(1, n - (language == "fr" and bare.endswith("e") and n > 1))


def confidence(word: str, phones: list[str]) -> float:
    c = 0.82 - 0.14 * bool(re.search(r"\d", word)) - 0.18 * ("spn" in phones) - 0.05 * bool(re.search("[.-]", word)) - 0.03 * (len(word) <= 2)
    return js_round(max(0.45, c), 2)


@lru_cache(1 << 17)
def told(word: str, language: str) -> tuple[str, tuple[str, ...], float, float]:
    """A word as ``normalize_token`` has it, and its phonemes, weight without pause and confidence; a worker keeps those of as many words."""
    w = normalize_token(word)
    phones = tuple(phonemes(w, language))
    return w, phones, max(1, len(phones)) + 0.45 * syllables(w, language), confidence(w, phones)


TOKEN = re.compile(r"[^\W_]+(?:['.\-][^\W_]+)*")

SENTENCE, CLAUSE = re.compile("[.!?]"), re.compile("[,;:]")


def align(text: str, duration_ms: int, language: str, activity: list[tuple[int, int]] | None = None, with_intervals: bool = True) -> list[dict]:
    """Words of a text over a recording, by weight of sounds, syllables and pauses, within its speech segments.

    The last word ends with the recording.
    """
    spans = sorted((s, min(e, duration_ms)) for s, e in activity or [(0, duration_ms)] if min(e, duration_ms) > s) or [(0, duration_ms)]
    merged = [spans[0]]
    for s, e in spans[1:]:
        if s <= merged[-1][1] + 120:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
        else:
            merged.append((s, e))
    total = sum(e - s for s, e in merged)

    def real(t: float) -> int:
        for s, e in merged:
            if t <= e - s:
                return int(js_round(s + t))
            t -= e - s
        return merged[-1][1]

    rows = []
    for m in TOKEN.finditer(text):
        w, phones, part, sure = told(m[0], language)
        if w:
            after = text[m.end() : m.end() + 4]
            pause = 0.9 if SENTENCE.search(after) else 0.42 if CLAUSE.search(after) else 0.0
            rows.append((m[0], phones, part + pause, sure))
    whole, at, out = sum(r[2] for r in rows) or 1.0, 0.0, []
    for i, (word, phones, part, sure) in enumerate(rows):
        start, at = real(at / whole * total), at + part
        end = duration_ms if i == len(rows) - 1 else max(start + 1, real(at / whole * total))
        row = {"word": word, "start_ms": start, "end_ms": end, "phonemes": list(phones), "confidence": sure}
        out.append(row | {"intervals": intervals(row["phonemes"], start, end)} if with_intervals else row)
    return out
