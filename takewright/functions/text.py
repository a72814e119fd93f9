"""Normalisation, tokens, slugs, hashes, labels and paths, as column expressions that stay in the JVM."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import _col, clamp, js_round, js_round_int


def _latin() -> tuple[str, str]:
    """Letters with marks whose canonical decomposition starts with an ASCII letter, and those letters: by rule, for Latin blocks."""
    plain = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and parts[0].isascii():
            plain[chr(code)] = parts[0]
    return "".join(plain), "".join(plain.values())


MARKED, PLAIN = _latin()


def strip_marks(x: Column | str) -> Column:
    return F.regexp_replace(F.translate(_col(x), MARKED, PLAIN), "[\\u0300-\\u036f]", "")


def fold(x: Column | str) -> Column:
    """Without accents, in lower case."""
    return F.lower(strip_marks(x))


def collapse(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(x), r"\s+", " "))


def normalize_text(x: Column | str) -> Column:
    """Trimmed, white space collapsed, lower case."""
    return F.lower(collapse(x))


def _collapse_lines(x: Column) -> Column:
    """Each line collapsed and trimmed, where lines end in line feeds: of the whole text at once."""
    for space in "\t\v\f":
        x = F.replace(x, F.lit(space), F.lit(" "))
    x = F.regexp_replace(x, " {2,}", " ")
    return F.btrim(F.replace(F.replace(x, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n")), F.lit(" "))


def normalize_corpus_text(x: Column | str) -> Column:
    """Line feeds alone, tabs as spaces, each line collapsed and trimmed, at most one empty line together, trimmed."""
    feeds = F.replace(F.replace(_col(x), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    x = F.regexp_replace(_collapse_lines(feeds), "\\n{3,}", "\n\n")
    # a pattern's end is also before a last line separator of another kind
    return F.when(F.right(x, F.lit(1)).isin("\u0085", "\u2028", "\u2029"), F.regexp_replace(x, r"^\s+|\s+$", "")).otherwise(F.btrim(x, F.lit(" \n")))


def clean_lines(x: Column | str) -> Column:
    """``clean_segment`` of each line of a normalised text, without those that are empty then."""
    bare = F.regexp_replace(_col(x), "(^|\n)[-*•] ", "$1")
    bare = F.when(bare.contains("﻿"), _collapse_lines(F.replace(bare, F.lit("﻿"), F.lit("")))).otherwise(bare)
    return F.array_remove(F.split(bare, "\n"), "")


def clean_segment(x: Column | str) -> Column:
    bare = F.regexp_replace(F.regexp_replace(_col(x), r"^\s*[-*•]\s+", ""), "﻿", "")
    return collapse(bare)


def tokens_by_space(x: Column | str) -> Column:
    return F.filter(F.split(_col(x), r"\s+"), lambda w: w != "")


def count_words(x: Column | str) -> Column:
    return F.size(tokens_by_space(x)).cast("long")


def decode_entities(x: Column | str) -> Column:
    """The ampersand first, so that a doubly escaped entity is decoded twice."""
    for entity, mark in (("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'")):
        x = F.regexp_replace(_col(x), f"(?i)&{entity};", mark)
    return x


def clean_subtitle(x: Column | str) -> Column:
    return collapse(decode_entities(F.regexp_replace(_col(x), "<[^>]+>", "")))


TIMESTAMP = r"(?:(\d{1,2}):)?(\d{2}):(\d{2})[,.](\d{3})"


def timestamp_ms(x: Column | str) -> Column:
    """[h]h:mm:ss,mmm with optional hours as milliseconds; null if it is none."""
    x = F.trim(_col(x))
    part = [F.regexp_extract(x, f"^{TIMESTAMP}$", i) for i in range(1, 5)]
    hours = F.when(part[0] == "", 0).otherwise(F.expr("0") + F.try_to_number(F.nullif(part[0], F.lit("")), F.lit("99")).cast("long"))
    rest = [p.try_cast("long") for p in part[1:]]
    return F.when(x.rlike(f"^{TIMESTAMP}$"), F.coalesce(hours, F.lit(0)) * 3600000 + rest[0] * 60000 + rest[1] * 1000 + rest[2])


def is_timing_line(x: Column | str) -> Column:
    return _col(x).rlike(rf"^\s*{TIMESTAMP}\s+-->\s+{TIMESTAMP}(?:\s|$)")


def timing(x: Column | str) -> Column:
    """start_ms and end_ms of a cue's timing line; null unless the end is later."""
    x = F.trim(_col(x))
    start = timestamp_ms(F.regexp_extract(x, rf"^({TIMESTAMP})\s+-->", 1))
    end = timestamp_ms(F.regexp_extract(x, rf"-->\s+({TIMESTAMP})", 1))
    return F.when(end > start, F.struct(start.alias("start_ms"), end.alias("end_ms")))


def is_subtitle(text: Column, name: Column) -> Column:
    return F.lower(name).rlike("[.](srt|vtt)$") | text.rlike(r"^WEBVTT(?:\s|$)") | (text.contains("-->") & F.exists(F.split(text, "\n"), is_timing_line))


def fnv1a(x: Column | str) -> Column:
    """32-bit FNV-1a over code points, as a number; base 36 by ``conv``.  Texts of a batch are hashed together, a place at a time."""

    @F.pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series(fnv1a_all(texts.tolist()), dtype="Int64")

    return hashed(_col(x))


def fnv1a_all(texts: list[str | None], most: int = 1 << 24) -> list[int | None]:
    """FNV-1a of each text: code points of texts of like lengths lie in tables of about ``most`` cells, longest first, so that those that have ended are the last."""
    out: list[int | None] = [None] * len(texts)
    order = sorted((i for i, t in enumerate(texts) if t is not None), key=lambda i: -len(texts[i]))
    first = 0
    while first < len(order):
        width = max(1, len(texts[order[first]]))
        part = order[first : first + max(1, most // width)]
        first += len(part)
        codes = np.zeros((width, len(part)), np.uint32)
        lengths = np.array([len(texts[i]) for i in part])
        for j, i in enumerate(part):
            codes[: lengths[j], j] = np.frombuffer(texts[i].encode("utf-32-le", "surrogatepass"), np.uint32)
        h = np.full(len(part), 0x811C9DC5, np.uint32)
        going = np.searchsorted(-lengths, -np.arange(width))  # texts longer than each place
        for at in range(width):
            n = going[at]
            h[:n] ^= codes[at, :n]
            h[:n] *= np.uint32(16777619)
        for j, i in enumerate(part):
            out[i] = int(h[j])
    return out


def hash_corpus_text(x: Column | str) -> Column:
    return F.lower(F.conv(fnv1a(x).cast("string"), 10, 36))


def stable_token(x: Column | str) -> Column:
    """16 hex digits that name a text; the same text has the same token everywhere."""
    return F.lpad(F.lower(F.hex(F.xxhash64(_col(x)))), 16, "0")


def slug(x: Column | str, most: int = 48) -> Column:
    bare = F.regexp_replace(fold(x), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(bare, "^-+|-+$", ""), 1, most)


def sanitize(x: Column | str) -> Column:
    return F.regexp_replace(_col(x), "[^a-zA-Z0-9._-]+", "-")


def file_stem(x: Column | str) -> Column:
    return F.coalesce(F.nullif(slug(F.regexp_replace(_col(x), "[.][^.]+$", "")), F.lit("")), F.lit("media"))


def recording_file_name(session: Column, take: Column) -> Column:
    return F.concat(sanitize(session), F.lit("__"), sanitize(take), F.lit(".wav"))


def observed_tokens(x: Column | str) -> Column:
    """Letters and numbers, joined by apostrophes, points and hyphens inside."""
    return F.regexp_extract_all(_col(x), F.lit(r"[\p{L}\p{N}]+(?:['’.\-][\p{L}\p{N}]+)*"), F.lit(0))


def transcript_tokens(x: Column | str) -> Column:
    """As observed_tokens, but a typographic apostrophe separates."""
    return F.regexp_extract_all(_col(x), F.lit(r"[\p{L}\p{N}]+(?:['.\-][\p{L}\p{N}]+)*"), F.lit(0))


def normalize_token(x: Column | str) -> Column:
    kept = F.regexp_replace(fold(F.translate(_col(x), "’ʼ`", "'''")), "[^a-z0-9'.-]", "")
    return F.regexp_replace(kept, "^[^a-z0-9]+|[^a-z0-9]+$", "")


def speech_token(x: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(x), "['’]", ""), r"[^\p{L}\p{N}]", "")


def lexical_word(x: Column | str) -> Column:
    return F.regexp_replace(fold(x), r"[^\p{L}\p{N}]", "")


def local_word(x: Column | str) -> Column:
    return F.regexp_replace(fold(F.replace(_col(x), F.lit("’"), F.lit("'"))), "[^a-z0-9']", "")


def ascii_word(x: Column | str) -> Column:
    return F.regexp_replace(fold(x), "[^a-z0-9]", "")


def has_letters(x: Column | str) -> Column:
    return _col(x).rlike(r"[\p{L}\p{N}]")


def speech_tokens(x: Column | str) -> Column:
    return F.filter(F.transform(tokens_by_space(x), speech_token), lambda w: w != "")


def emphasis_hints(x: Column | str) -> Column:
    words = F.filter(F.split(F.regexp_replace(_col(x), r"[^\p{L}\p{N}\s'-]", " "), r"\s+"), lambda w: F.length(w) >= 5)
    return F.slice(F.array_distinct(words), 1, 3)


def phonetic_coverage(language: Column, x: Column | str) -> Column:
    folded = fold(x)
    kinds = [("vowels", "[aeiouy]"), ("sibilants", "[szcj]"), ("plosives", "[pbtdkg]"), ("nasals", "[mn]")]
    tags = [F.concat(language, F.lit("_custom_text"))] + [F.when(folded.rlike(p), F.concat(language, F.lit(f"_{k}"))) for k, p in kinds]
    return F.array_compact(F.array(*tags))


def letter_coverage(x: Column | str) -> Column:
    """Share of the alphabet's letters and vowels in whole per cent, and which rare letters occur."""
    letters = F.array_distinct(F.split(F.regexp_replace(fold(x), "[^a-z]", ""), ""))
    letters = F.filter(letters, lambda c: c != "")
    vowels = F.array_intersect(letters, F.array(*map(F.lit, "aeiouy")))
    rare = F.array_sort(F.array_intersect(letters, F.array(*map(F.lit, "qwxz"))))
    return F.struct(js_round_int(F.size(letters) / 26 * 100).alias("letters"), js_round_int(F.size(vowels) / 6 * 100).alias("vowels"), rare.alias("rare"))


def transcript_preview(x: Column | str) -> Column:
    words = tokens_by_space(x)
    return F.array_join(F.slice(words, F.greatest(F.lit(1), F.size(words) - 9), 10), " ")


def word_weight(x: Column | str) -> Column:
    return clamp(F.length(_col(x)) / 5, 0.72, 2.35)


def guide_duration_ms(words: Column, min_ms: Column, max_ms: Column) -> Column:
    least = F.greatest(F.lit(1400), 260 * words)
    middle = F.coalesce((min_ms + max_ms) / 2, 560 * words)
    return clamp(middle, least, F.greatest(least + 900, 980 * words))


def estimated_ms(x: Column | str) -> Column:
    return F.greatest(F.lit(1800).cast("long"), 520 * count_words(x))


def youtube_id(url: Column | str) -> Column:
    """The 11-character id in a watch, short, embed, shorts or live address of the site or its short host; null if there is none."""
    url = F.trim(_col(url))
    bare = url.rlike("^[A-Za-z0-9_-]{11}$")
    host = F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))), "^(www|m)[.]", "")
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    query = F.try_parse_url(url, F.lit("QUERY"), F.lit("v"))
    named = F.regexp_extract(path, "^/(?:embed|shorts|live)/([^/]+)", 1)
    found = F.when(host == "youtu.be", F.regexp_extract(path, "^/([^/]+)", 1)).when(host.isin("youtube.com", "music.youtube.com", "youtube-nocookie.com"), F.when(path == "/watch", query).otherwise(named))
    return F.when(bare, url).when(found.rlike("^[A-Za-z0-9_-]{11}$"), found)


def youtube_embed(video: Column, start_s: Column, end_s: Column, autoplay: bool = False, muted: bool = False) -> Column:
    """Ordered parameters; a start after 0 and an end after it alone are named."""
    start, end = F.greatest(F.lit(0), F.floor(start_s)).cast("long"), F.floor(end_s).cast("long")
    fixed = f"autoplay={int(autoplay)}&controls=1&mute={int(muted)}&playsinline=1&rel=0"
    parts = [F.lit(fixed), F.when(start > 0, F.concat(F.lit("start="), start)), F.when(end > start, F.concat(F.lit("end="), end))]
    return F.concat(F.lit("https://www.youtube-nocookie.com/embed/"), video, F.lit("?"), F.array_join(F.array_compact(F.array(*parts)), "&"))


def media_time(seconds: Column | str) -> Column:
    total = F.greatest(F.lit(0), F.floor(_col(seconds))).cast("long")
    hours, minutes, rest = F.floor(total / 3600).cast("long"), F.floor(total % 3600 / 60).cast("long"), total % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(hours > 0, F.concat_ws(":", hours.cast("string"), two(minutes), two(rest))).otherwise(F.concat_ws(":", minutes.cast("string"), two(rest)))


def capture_limit(ms: Column | str) -> Column:
    minutes, rest = F.floor(_col(ms) / 60000).cast("long"), F.floor(_col(ms) % 60000 / 1000).cast("long")
    return F.when(rest == 0, F.concat(minutes, F.lit(" min"))).otherwise(F.concat(minutes, F.lit(" min "), rest, F.lit(" s")))


def percent(x: Column | str) -> Column:
    return F.concat(js_round_int(clamp(x, 0.0, 100.0)), F.lit("%"))


def locale(language: Column) -> Column:
    return F.when(language == "fr", "fr-FR").otherwise("en-US")


def speaker_languages(languages: Column) -> Column:
    kept = F.array_distinct(F.array_intersect(F.coalesce(languages, F.array().cast("array<string>")), F.array(F.lit("fr"), F.lit("en"))))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit("fr")))


def schema_version(path: Column) -> Column:
    """The schema that a path's files have."""
    return F.when(path.endswith(".wav"), "audio.pcm_s24le.v1").when(path == "samples.jsonl", "voice.capture.samples.v1").when(path.startswith("rights/"), "voice.capture.rights.v1").when(path.startswith("reports/"), "voice.capture.report.v1").otherwise("voice.capture.package.v1")


PROVENANCE = ["rights", "sessions", "speakers", "corpora", "text", "alignment", "quality", "reviews"]


def artifact_type(path: Column) -> Column:
    """Ordered: what lies in a folder of provenance is provenance, whatever its ending; recordings are audio anywhere."""
    folder = F.substring_index(path, "/", 1)
    return (
        F.when(path.endswith(".wav"), "audio").when(path.startswith("reports/"), "report").when(path.contains("/") & folder.isin(PROVENANCE), "provenance")
        .when(path.endswith(".jsonl") | (path == "README.md"), "text").when(path == "checksums.sha256", "integrity").otherwise("metadata")
    )


def browser_runtime(agent: Column) -> Column:
    """First of Edge, Chrome, Firefox and Safari, with its version."""
    rules = [("Edge", r"Edg/([\d.]+)"), ("Chrome", r"Chrome/([\d.]+)"), ("Firefox", r"Firefox/([\d.]+)"), ("Safari", r"Version/([\d.]+).*Safari")]
    out = F.when(F.lit(False), F.struct(F.lit("").alias("name"), F.lit("").alias("version")))
    for name, pattern in rules:
        out = out.when(agent.rlike(pattern), F.struct(F.lit(name).alias("name"), F.regexp_extract(agent, pattern, 1).alias("version")))
    return out.otherwise(F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("version")))


def sha256(x: Column) -> Column:
    return F.sha2(x, 256)


def is_sha256(x: Column) -> Column:
    return F.coalesce(x.rlike("^[a-f0-9]{64}$"), F.lit(False))


def safe_relative_path(path: Column) -> Column:
    parts = F.split(path, "/")
    whole = (F.length(path) > 0) & (F.length(path) <= 240) & ~path.startswith("/") & ~path.rlike(r"[\\\x00-\x1f\x7f]")
    return F.coalesce(whole & F.forall(parts, lambda p: ~p.isin("", ".", "..") & (F.length(p) <= 100)), F.lit(False))


def safe_archive_path(path: Column) -> Column:
    whole = (F.length(path) > 0) & (F.length(path) <= 512) & ~path.rlike(r"^/|/$|[\\\x00-\x1f\x7f]|^[A-Za-z]:")
    return F.coalesce(whole & F.forall(F.split(path, "/"), lambda p: ~p.isin("", ".", "..")), F.lit(False))


def safe_recording_name(name: Column) -> Column:
    return F.coalesce((F.length(name) <= 255) & ~name.rlike(r"[/\\\x00-\x1f\x7f]") & F.lower(name).endswith(".wav"), F.lit(False))


def syllables(word: Column, language: Column) -> Column:
    """Groups of vowels; in French a final e after others is silent; 1 at least."""
    folded = F.regexp_replace(fold(word), "[^a-z]", "")
    groups = F.regexp_count(folded, F.lit("[aeiouy]+"))
    silent = F.when((language == "fr") & folded.endswith("e") & (groups > 1), 1).otherwise(0)
    return F.greatest(F.lit(1), groups - silent).cast("long")


def csv_cell(x: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))


def similarity(a: Column, b: Column, digits: int | None = None) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    out = F.when(longest == 0, F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / longest)
    return js_round(out, digits) if digits is not None else out
