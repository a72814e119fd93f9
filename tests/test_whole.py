"""Queries read the whole of long turns and documents: a fixture that is longer than any cut, against plain tables of costs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from takewright.plans import catalog

LONG = 700
VOCABULARY = "hello world words speech timing café segment prompt record session tokens align".split()


def words(n: int, step: int) -> list[str]:
    return [VOCABULARY[(i * step + i // 7) % len(VOCABULARY)] for i in range(n)]


@pytest.fixture(scope="module")
def long_tables(spark, tmp_path_factory):
    """Two turns of 150 words that differ in many behind the 60th alone, and a document of LONG words and a short one."""
    d = str(tmp_path_factory.mktemp("long"))
    first = words(150, 5)
    second = first[:70] + words(90, 7) + first[75:140]
    turns = [(1, 0, "user", " ".join(first)), (1, 1, "assistant", " ".join(second)), (1, 2, "user", "hello word")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{d}/conversations.parquet")
    text = " ".join(f"{w}{i}" for i, w in enumerate(words(LONG, 5)))
    docs = [(1, "en", "a", text, len(text)), (2, "fr", "b", "bonjour tout le monde", 21)]
    spark.createDataFrame(docs, "doc_id long, lang string, source string, text string, n_chars long").write.parquet(f"{d}/documents.parquet")
    return d


def edits(a, b) -> int:
    table = [[i + j for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    return table[-1][-1]


def common(a, b, same) -> int:
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = table[i][j] + 1 if same(a[i], b[j]) else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def rounded(x: float, digits: int) -> float:
    return int(x * 10**digits + 0.5) / 10**digits


def test_turns_are_compared_whole(spark, long_tables):
    from takewright.functions import sequences as Q

    turn = {r.turn: r.text.replace("é", "e").split() for r in spark.read.parquet(f"{long_tables}/conversations.parquet").collect()}
    a, b = turn[0], turn[1]
    get = lambda name: catalog.QUERIES[name](spark, long_tables).where("turn = 1").first()
    assert get("j01_transcript_match").score == rounded(1 - edits(a, b) / max(len(a), len(b)), 2)
    assert get("j01_transcript_match").extra - get("j01_transcript_match").missing == len(b) - len(a)
    assert get("j10_agreement").agreement == rounded(2 * common(a, b, Q.compatible) / (len(a) + len(b)), 3)
    assert get("j15_error_rates").wer == rounded(edits(a, b) / len(a), 3)
    assert get("j15_error_rates").cer == rounded(edits("".join(a), "".join(b)) / len("".join(a)), 3)
    found = get("j11_align_spoken")
    assert found.matched > 60
    assert found.coverage == found.matched / len(a)
    n, m = len(a), len(b)  # the best path of the alignment by a plain table
    best = [[-0.34 * i - 0.58 * j for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            s = Q.token_similarity(a[i - 1], b[j - 1])
            best[i][j] = max(best[i - 1][j - 1] + (0.35 + s if s >= 0.5 else -0.82), best[i - 1][j] - 0.34, best[i][j - 1] - 0.58)
    assert 0 < found.score <= 1
    assert max(r[m] for r in best) <= found.matched * 0.35 + found.score * m + 1e-6


def test_timings_are_compared_whole(spark, long_tables):
    found = catalog.QUERIES["j05_compare_timings"](spark, long_tables).where("media_id = 1").first()
    a, b = [i for i in range(LONG) if i % 1000 != 1], [i for i in range(LONG) if i % 7 != 1]  # every word is another one
    assert found.match_rate == rounded(len(set(a) & set(b)) / max(len(a), len(b)), 3)
    assert found.median_ms == 90.0


def test_consensus_is_of_all_words(spark, long_tables):
    found = catalog.QUERIES["k04_lexical_consensus"](spark, long_tables).where("media_id = 1")
    # a longest common subsequence has at least the words that both of two heard, and each word of it has two votes
    heard = [{i for i in range(LONG) if i % every != 1} for every in (9, 7, 5)]
    assert found.count() >= min(len(x & y) for x in heard for y in heard if x is not y)
    last = spark.read.parquet(f"{long_tables}/documents.parquet").where("doc_id = 1").first().text.split()[-1]
    assert found.where(F.col("word") == last).count() == 1


def test_phonemes_are_of_all_words(spark, long_tables):
    assert catalog.QUERIES["f08_f09_phonemes"](spark, long_tables).where("doc_id = 1").count() == LONG


def test_prompts_are_aligned_whole(spark, long_tables):
    doc = spark.read.parquet(f"{long_tables}/documents.parquet").where("doc_id = 1").first()
    found = catalog.QUERIES["f11_align_prompt"](spark, long_tables).where("doc_id = 1").orderBy("start_ms", "end_ms").collect()
    assert [r.word for r in found] == doc.text.split()
    assert found[-1].end_ms == doc.n_chars * 70


def test_overlaps_of_all_words_are_repaired(spark, long_tables):
    doc = spark.read.parquet(f"{long_tables}/documents.parquet").where("doc_id = 1").first()
    wanted, at = [], 0
    for w in doc.text.split():
        start, end, at = at * 90, at * 90 + len(w) * 80 + 60, at + len(w)
        if wanted and wanted[-1][1] > start:
            start = max(wanted[-1][0] + 1, min(end - 1, (wanted[-1][1] + start + 1) // 2))
            wanted[-1] = (wanted[-1][0], start)
        wanted.append((start, end))
    found = catalog.QUERIES["i13_resolve_overlaps"](spark, long_tables).where("media_id = 1").orderBy("idx").collect()
    assert [(r.start_ms, r.end_ms) for r in found] == wanted
