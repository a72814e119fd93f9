"""Connected groups and the splits that keep them whole, against plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from takewright.operators import splits

FIELDS = "id long, groups struct<" + ", ".join(f"{k}: string" for k in splits.KINDS) + ">"


def plain_components(edges):
    label = {n: n for e in edges for n in e}
    while True:
        before = dict(label)
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return label


def row(i, **known):
    return (i, tuple(known.get(k) for k in splits.KINDS))


def test_connected_equals_a_plain_loop(spark):
    dice = random.Random(3)
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]
    star = [("hub", f"s{i}") for i in range(200)]
    some = [(f"n{dice.randrange(120)}", f"n{dice.randrange(120)}") for _ in range(70)]
    edges = chain + star + some + some[:5] + [("alone", "alone")]
    dice.shuffle(edges)
    found = splits.connected(spark.createDataFrame([*edges, (None, "x"), ("y", None)], "a string, b string"))
    assert {(r.node, r.label) for r in found.collect()} == set(plain_components(edges).items())
    assert splits.connected(spark.createDataFrame([], "a string, b string")).count() == 0


def test_no_group_is_in_two_splits(spark):
    dice = random.Random(5)
    rows = [row(i, speaker=f"p{dice.randrange(90)}", session=f"s{i // 3}" if i % 7 else None, day="one" if i < 40 else None, device="d") for i in range(300)]
    rows += [row(300), row(301), row(301), row(302, device="d"), row(None, speaker="p1")]
    x = spark.createDataFrame(rows, FIELDS)
    kinds, shares = ("speaker", "session", "day"), {"train": 0.5, "validation": 0.2, "test": 0.3}
    done = splits.assigned(x, F.col("groups"), F.col("id"), kinds, shares, seed=1)
    got = done.collect()
    assert len(got) == len(rows)
    assert {r.assignment for r in got} == set(shares)

    # the same components as of a plain loop over rows
    edges = [(f"{k}:{g[splits.KINDS.index(k)]}", f"{m}:{g[splits.KINDS.index(m)]}") for _, g in rows for k in kinds for m in kinds if g[splits.KINDS.index(k)] and g[splits.KINDS.index(m)]]
    label = plain_components(edges)
    for r in got:
        known = [f"{k}:{r.groups[k]}" for k in kinds if r.groups[k]]
        assert r.split_group == (label[known[0]] if known else f"row:{r.id}")
    assert {r.kind: r.shared for r in splits.leaks(done, F.col("groups"), kinds).collect()} == dict.fromkeys(kinds, 0)
    device = splits.leaks(done, F.col("groups"), ("device",)).first()
    assert (device.groups, device.shared, device.rows, device.shared_rows) == (1, 1, 301, 301)

    # another table of the same components keeps their assignments, another seed does not
    again = splits.assigned(x.where("id >= 0").repartition(5), F.col("groups"), F.col("id"), kinds, shares, seed=1)
    was = {r.split_group: r.assignment for r in got}
    assert {(r.split_group, r.assignment) for r in again.collect()} <= set(was.items())
    other = splits.assigned(x, F.col("groups"), F.col("id"), kinds, shares, seed=2)
    assert {r.split_group: r.assignment for r in other.collect()} != was


def test_split_of_nothing_and_wrong_calls(spark):
    x = spark.createDataFrame([], FIELDS)
    g, i = F.col("groups"), F.col("id")
    assert splits.assigned(x, g, i, ("speaker",), {"train": 1.0}).count() == 0
    with pytest.raises(ValueError, match="unknown"):
        splits.assigned(x, g, i, ("colour",), {"train": 1.0})
    with pytest.raises(ValueError, match="no groups"):
        splits.assigned(x, g, i, (), {"train": 1.0})
    with pytest.raises(ValueError, match="add up"):
        splits.assigned(x, g, i, ("speaker",), {"train": 0.5})


def test_sample_rows_of_takes_that_lack_something(spark):
    takes = "session_id string, take_ord long, speaker_id string, prompt_id long, dataset_id string, project_id string, text string, observed string, rating string, verdict string, alignment string, duration_ms long, declared_ms long, audio_sha256 string, byte_size long, observed_settings string, room_tone string, device string, recorded_at string"
    full = ("s 1", 1, "a", 1, "d", "p", "  Bonjour  LE monde ", None, "keeper", "pass", "forced", 900, 901, "ab", 44, "gain", None, "mic", "2024-05-01T10:00:00Z")
    bare = ("s 2", 2, None, 9, None, None, " ", None, "maybe", "review", "estimated_g2p", None, None, None, None, None, None, None, None)
    prompts = spark.createDataFrame([(1, "Bonjour.", "fr", "c", "2", "l", "calm", "soft", "low", 0.1, 0.2, 0.3)], "prompt_id long, text string, language string, corpus_id string, corpus_version string, license_id string, intent string, tone string, energy string, valence double, arousal double, dominance double")
    rights = spark.createDataFrame([("a", "k", True)], "speaker_id string, consent_id string, granted boolean")
    one, two = splits.sample_rows(spark.createDataFrame([full, bare], takes), prompts, rights).orderBy("take_ord").collect()
    assert (one.audio.path, one.text.normalized, one.text.provenance_ref, one.alignment.path) == ("audio/audio_ab.wav", "bonjour le monde", "corpus:c@2#prompt:1", "alignment/s-1-1.json")
    assert (one.lifecycle.status, one.lifecycle.reasons, one.lifecycle.review_required, one.errors) == ("training_candidate", [], False, [])
    assert one.split.group_keys.day == "2024-05-01"
    assert one.split.group_ids.room_tone == "unknown" and len(one.split.group_ids.device) == 16
    assert (two.text.normalized, two.consent_refs, two.license_refs, two.errors) == ("", [], [], ["prompt", "recording", "consent"])
    assert (two.lifecycle.reasons, two.lifecycle.review_required) == (["legacy_maybe_rating"], True)
    assert {k: v for k, v in two.split.group_keys.asDict().items() if v is not None} == {"session": "s 2", "prompt": "9", "normalized_text": ""}
