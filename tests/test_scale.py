"""Plans and costs that grow no faster than the input, with results as plain loops make them."""

from __future__ import annotations

import re

import pytest

from takewright.operators import intervals
from takewright.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_warp_looks_at_no_rows_after(spark):
    """Before, each time looked through all rows after it, which took the square of a medium's words."""
    anchors = [(1, 0, 5), (1, 100, 205), (1, 200, 205), (2, 50, 70)]
    times = [(1, t) for t in (-5, 0, 30, 100, 150, 200, 999)] + [(2, 1), (2, 50), (2, 80), (3, 7)]
    found = intervals.warp(spark.createDataFrame(times, "media_id long, t long"), spark.createDataFrame(anchors, "media_id long, source_ms long, target_ms long"))
    assert {(r.media_id, r.t): r.warped_ms for r in found.collect()} == {(1, -5): 5, (1, 0): 5, (1, 30): 65, (1, 100): 205, (1, 150): 205, (1, 200): 205, (1, 999): 205, (2, 1): 70, (2, 50): 70, (2, 80): 70, (3, 7): None}
    assert "unboundedfollowing" not in plan(found)


@pytest.mark.parametrize("name", ["i16_i17_fused_words", "d15_speech_overlap", "d16_supported_rate", "k09_assess_words", "a22_timeline_csv", "f12_bias_phrases"])
def test_words_are_not_sent(spark, name):
    """Texts, or numbers of media, are dealt, and nothing that is made of their words."""
    sent = re.findall(r"Exchange hashpartitioning\((.*?)\)", plan(catalog.QUERIES[name](spark, SF)))
    assert sent
    assert all("idx" not in x and "phrase" not in x for x in sent)
    assert "ENSURE_REQUIREMENTS" not in "".join(x for x in plan(catalog.QUERIES[name](spark, SF)).splitlines() if "Exchange hash" in x)


def test_alignments_of_all_pairs_at_once(spark):
    """Before, each pair was aligned by itself, a diagonal at a time, and turns lay in as few tasks as they were small."""
    import random

    from takewright.functions import sequences as Q

    some = random.Random(3)
    word = lambda: some.choice(["a", "ab", "word", "words", "wordy", "café", "zzz", "x" * 70, "x" * 69 + "y", ""])
    pairs = [([word() for _ in range(some.randrange(25))], [word() for _ in range(some.randrange(25))]) for _ in range(60)]
    found = Q.align_all(pairs, cells=3000)
    assert found == [Q.align_spoken(a, b) for a, b in pairs]
    for (a, b), got in zip(pairs, found, strict=True):
        best = [[-0.34 * i - 0.58 * j for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                s = Q.token_similarity(a[i - 1], b[j - 1])
                best[i][j] = max(best[i - 1][j - 1] + (0.35 + s if s >= 0.5 else -0.82), best[i - 1][j] - 0.34, best[i][j - 1] - 0.58)
        if a and b:
            assert max(r[len(b)] for r in best) <= got["matched"] * 0.35 + got["score"] * len(b) + 1e-6
    for name in ("j11_align_spoken", "j13_q103_prompt_positions"):
        assert "REPARTITION_BY_NUM" in plan(catalog.QUERIES[name](spark, SF))


def test_edits_of_many_pairs(spark):
    import numpy as np

    from takewright.functions import sequences as Q

    words = ["", "a", "abc", "abd", "café", "cafe", "x" * 64, "x" * 65, "y" + "x" * 63, "\U0001f600b"]
    left, right = (x.ravel() for x in np.meshgrid(np.arange(len(words)), np.arange(len(words))))
    assert Q.edit_distances(words, left, right, pairs=7).tolist() == [Q.edit_distance(words[i], words[j]) for i, j in zip(left, right, strict=True)]


def test_consensus_counts_edits_at_once(spark, monkeypatch):
    """Before, each pair of words that might be alike was compared by itself, a letter at a time in Python."""
    from takewright.functions import sequences as Q

    words = ["segment", "segments", "segmant", "prompt", "promt", "prompts", "café", "cafés", "a", "ab", "x" * 70, "x" * 69]
    wanted = {w: sorted(v for v in words if Q.compatible(w, v)) for w in words}
    calls: list[int] = []
    slow = Q.edit_distance
    monkeypatch.setattr(Q, "edit_distance", lambda a, b: calls.append(1) or slow(a, b))
    assert {w: sorted(v) for w, v in Q.compatible_words(words, rows=5).items()} == wanted
    assert len(calls) <= 2  # words of more than 64 letters alone


def test_warnings_of_texts_without_their_tokens(spark):
    """Before, each token was normalised ten times to tell whether it has a digit."""
    from pyspark.sql import functions as F

    from takewright.functions import labels as L
    from takewright.functions import text as X
    from takewright.operators import rules

    assert not any(c.isdigit() for c in X.PLAIN)
    texts = [None, "", " \n", "…!", "!\u0301", "a b", "a-b.c d.", "x1", "9", "'7'", "\u0663 tout", "\u00b2", "É\u00a0è", "\u212a-1.5", "…4…", "\U0001d7d8 a"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    words = F.transform(X.transcript_tokens("text"), lambda w: F.struct(X.normalize_token(w).alias("normalized"), rules.token_confidence(X.normalize_token(w), F.lit(False)).alias("confidence")))
    found = rows.select("doc_id", L.estimate_warnings(F.col("text")).alias("a"), L.alignment_warnings(F.col("text"), X.transcript_tokens("text"), words).alias("b")).collect()
    assert [r.a for r in found] == [r.b for r in found]
    assert "regexp_extract_all" not in plan(catalog.QUERIES["m29_alignment_warnings"](spark, SF))


def test_timings_are_gathered_once(spark):
    """Before, texts were split and joined twice, and every word came to Python as a row of its own."""
    import random

    from takewright.functions import sequences as Q

    some = random.Random(5)
    for _ in range(300):  # the trace, step by step, counting at every place
        n, m = some.randrange(8), 7
        masks = [some.randrange(1 << m) for _ in range(n)]
        size = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n):
            for j in range(m):
                size[i + 1][j + 1] = size[i][j] + 1 if masks[i] >> j & 1 else max(size[i][j + 1], size[i + 1][j])
        pairs, i, j = [], n, m
        while i and j:
            if masks[i - 1] >> (j - 1) & 1:
                i, j = i - 1, j - 1
                pairs.append((i, j))
            elif size[i - 1][j] >= size[i][j - 1]:
                i -= 1
            else:
                j -= 1
        assert Q.common_pairs(masks, m) == pairs[::-1]
    told = plan(catalog.QUERIES["j05_compare_timings"](spark, SF))
    assert told.count("Exchange") == 1
    assert "Join" not in told


def test_transcripts_are_matched_whole(spark, monkeypatch):
    """Before, each word was folded twice by itself, and all of an alignment was checked to compare its words alone."""
    from pyspark.sql import functions as F

    from takewright.functions import text as X
    from takewright.operators import imports

    said = [["Été", "d'Or!"], ["ΟΔΟΣ", "a"], ["e", "́a", None], [], None, ["!"], ["a", "b"]]
    rows = spark.createDataFrame([(i, [(w, 0.0) for w in x] if x is not None else None, "Été d'or" if i == 0 else "ea" if i == 2 else "a") for i, x in enumerate(said)], "i int, words array<struct<word:string,startMs:double>>, text string")
    one = F.struct("words")
    old = F.array_join(imports.folded(one["words"]), "")
    found = rows.select("i", imports.matches_transcript(one, F.col("text")).alias("a"), F.coalesce((old == X.ascii_word("text")) & (old != ""), F.lit(False)).alias("b")).orderBy("i").collect()
    assert [r.a for r in found] == [r.b for r in found] == [True, True, True, False, False, False, False]
    monkeypatch.setattr(imports, "folded", None)  # words are not folded one by one
    assert "from_json" in plan(catalog.QUERIES["c24_alignment_matches"](spark, SF))


def test_segments_are_made_in_one_pass(spark):
    """Before, each text was normalised once for each kind of script, a line and a piece at a time, and words were split for every chunk."""
    import random
    import re as r

    from pyspark.sql import functions as F

    from takewright.functions import text as X
    from takewright.operators import corpus

    some = random.Random(8)
    bits = ["a", "b c", " ", "\n", "\n\n\n", "\r\n", "\r", "\t", "\v", "\f", "\u00a0", "\ufeff", "- ", "* ", "• ", ".", "...", "!", "; ", ": ", "w " * 9, "\u2028", "\u0085", "é", "one two. ", "- l\n", " - ."]
    texts = ["", "\ufeff", "-", "- ", ". - .", "x\n\u2028", *("".join(some.choices(bits, k=some.randrange(1, 30))) for _ in range(300))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    collapse = lambda x: r.sub(r"[ \t\n\v\f\r]+", " ", x).strip(" ")
    clean = lambda x: collapse(r.sub(r"\A[ \t\n\v\f\r]*[-*•][ \t\n\v\f\r]+", "", x).replace("\ufeff", ""))
    found = rows.select("doc_id", X.normalize_corpus_text("text").alias("n"), X.hash_corpus_text("text").alias("h")).withColumn("lines", X.clean_lines("n")).collect()
    for row, text in zip(sorted(found), texts, strict=True):
        whole = r.sub("\n{3,}", "\n\n", "\n".join(map(collapse, r.sub("\r\n?", "\n", text).replace("\t", " ").split("\n"))))
        whole = r.sub(r"\A[ \n]+|[ \n]+(?=[\n\u0085\u2028\u2029]?\Z)", "", whole)
        assert row.n == whole
        assert row.lines == [s for s in map(clean, whole.split("\n")) if s]
        h = 0x811C9DC5
        for c in text:
            h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
        assert int(row.h, 36) == h
    got: dict[int, list[str]] = {}
    for row in corpus.pack_sentences(rows, "doc_id", 5).orderBy("doc_id", "idx").collect():
        got.setdefault(row.doc_id, []).append(row.text)
    for i, text in enumerate(texts):
        out: list[str] = []
        for s in filter(None, map(clean, r.findall("[^.!?;:]+[.!?;:]?", text))):
            if out and len(f"{out[-1]} {s}".split(" ")) <= 5:
                out[-1] += f" {s}"
            else:
                out.append(s)
        assert got.get(i, []) == out
    told = catalog.QUERIES["f01_script_segments"](spark, SF)
    assert told._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 2  # subtitles, and all others


@pytest.mark.parametrize("name", ["i18_phrase_timings", "i19_review_words"])
def test_words_meet_their_texts_where_they_are(spark, name):
    """Before, words were sent to be joined by their numbers, or because texts were split before they were dealt."""
    told = plan(catalog.QUERIES[name](spark, SF))
    sent = re.findall(r"Exchange hashpartitioning\((.*?)\)", told)
    assert sent
    assert all("idx" not in x and "from" not in x and "ord" not in x for x in sent)
    lines = told.splitlines()
    for i, line in enumerate(lines):
        if "Exchange hash" in line and "ENSURE_REQUIREMENTS" in line:
            assert not any("Generate" in x or "Union" in x for x in lines[i + 1 : i + 4])
