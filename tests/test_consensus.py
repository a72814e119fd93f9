"""The consensus by columns against that of words one by one."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from takewright.functions import consensus as C
from takewright.functions import sequences as Q
from takewright.operators import alignment as A
from takewright.plans import catalog
from takewright.plans.base import Tables

SF = "/root/testdata/sf0.001"
WORDS = ["x" * 70, "x" * 69, "y" + "x" * 69, "segmentation", "segmentations", "zegmentatiom", "", "-", "segment", "segments", "segmant", "prompt", "promt", "a", "ab", "Café", "cafe", "the", "zone", "zones", "zonee"]


def hypotheses(seed: int) -> list[dict]:
    some = random.Random(seed)
    base, out = [some.choice(WORDS) for _ in range(some.randint(0, 14))], []
    for k in range(some.choice([1, 2, 3, 3, 3, 4, 5])):
        at, words = some.randint(-300, 300), []
        for w in base:
            if some.random() < 0.85:
                size = some.randint(0, 700)
                words.append({"word": some.choice(WORDS) if some.random() < 0.2 else w, "start_ms": at, "end_ms": at + size, "support": some.choice([0, 0.1, 0.2, 0.3, 1 / 3, some.random()])})
                at += size + some.randint(-200, 300)
        out.append({"kind": f"k{k}", "model": some.choice(["base", "tiny"]), "signal": some.choice(["original", "spectral_vocal"]), "words": words})
    return out


def columns(given: list[dict]) -> tuple[list[C.Heard], list[str]]:
    number: dict[str, int] = {}
    told = [C.Heard(h["kind"], h["model"], h["signal"], np.array([number.setdefault(w["word"], len(number)) for w in h["words"]], np.int64), *(np.array([w[f] for w in h["words"]], t) for f, t in (("start_ms", np.int64), ("end_ms", np.int64), ("support", float)))) for h in given]
    return told, list(number)


def test_consensus_by_columns_is_that_of_words():
    media = [hypotheses(seed) for seed in range(600)]
    given = [columns(m) for m in media]
    recovered = 0
    for m, (_, texts), c in zip(media, given, C.consensus_all(given), strict=True):
        wanted = Q.consensus(m)
        found = [{"word": texts[w], "start_ms": s, "end_ms": e, "votes": v, "confidence": x} for w, s, e, v, x in zip(*(a.tolist() for a in (c.words, c.start_ms, c.end_ms, c.votes, c.confidence)), strict=True)]
        assert (c.anchor, found, c.rejected, c.recovered, c.fuzzy) == (wanted["anchor"], wanted["words"], wanted["rejected"], wanted["recovered"], wanted["fuzzy"])
        recovered += c.recovered
    assert recovered > 20


def test_pairs_of_several_media_are_those_of_each():
    media = [WORDS, [], ["abcd"], sorted({Q.word_key(w) for w in WORDS}), ["abcde", "abcdf", "abcd", "abce", "bcdea"]]
    for words, pairs in zip(media, C.compatible_pairs(media), strict=True):
        found = {frozenset((words[x], words[y])) for x, y in pairs.tolist()}
        assert found == {frozenset((a, b)) for a in words for b in words if a != b and Q.compatible(a, b)}


def test_words_are_neither_gathered_nor_dealt_again(spark):
    df = catalog.QUERIES["k04_lexical_consensus"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "collect_list" not in plan
    t = Tables(spark, SF)
    kinds = [("base_original", "base", "original", 9, 0), ("tiny_focus", "tiny", "vocal_focus", 7, 60), ("base_spectral", "base", "spectral_vocal", 5, -40)]
    parts = []
    for k, m, s, every, late in kinds:
        keep = t.word_timings.where(F.col("idx") % every != 1)
        word = F.struct("word", (F.col("start_ms") + late).alias("start_ms"), (F.col("end_ms") + late).alias("end_ms"), (F.col("idx") % 5 / 5).alias("support"))
        words = keep.groupBy("media_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", word.alias("w")))), lambda x: x["w"]).alias("words"))
        parts.append(words.select("media_id", F.lit(k).alias("kind"), F.lit(m).alias("model"), F.lit(s).alias("signal"), "words"))
    wanted = A.lexical_consensus(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, wanted.collect()))
