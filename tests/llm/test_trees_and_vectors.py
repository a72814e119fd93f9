"""Byte-level BPE against the library, Merkle manifests and whitening against plain brute force, on small tables with nulls, ties and repeated rows."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from takewright.llm import bpe, merkle, queries, whitening

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- byte-level BPE


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(RANKS, PATTERN)


def ids(raw: bytes) -> list[int]:
    return np.frombuffer(raw, "<u4").tolist()


def test_matrices_equal_the_library(library, vocabulary):
    rng = random.Random(3)
    letters = "aabcdeéß漢字ñ ,.'12\n\tЖдﬁ🙂́\x1c\x85\0"
    parts = {"".join(rng.choice(letters) for _ in range(rng.choice((1, 2, 3, 7, 20, 60, 150)))) for _ in range(600)} | {"a" * n for n in (1, 2, 3, 255, 256, 257, 600)}
    found = vocabulary.encode(parts)
    for part in parts:
        assert ids(found[part]) == library._core_bpe.encode_single_piece(part.encode()), part


def test_heap_equals_matrices(vocabulary):
    rng = random.Random(4)
    rows = [bytes(rng.choice(b"abcdeert \xc3\xa9") for _ in range(rng.randint(2, 256))) for _ in range(80)] + [b"a" * 256, b"ab" * 128]
    assert [ids(x) for x in vocabulary.merged(rows, 256)] == [vocabulary.by_heap(r) for r in rows]


def test_pairs_in_a_crowded_table():
    rng = np.random.default_rng(5)
    key = rng.choice(2000 * 2000, 30_000, replace=False)
    table = bpe.Pairs(key // 2000, key % 2000, np.arange(len(key)), 2000)
    assert (table.of(key // 2000, key % 2000) == np.arange(len(key))).all()
    assert (table.of(np.full(5, 2000), np.arange(5)) == bpe.NEVER).all()


def test_bpe_round_trip(docs, empty, texts, library):
    extra = docs.withColumn("ids", F.lit("mine"))
    both = bpe.decode(bpe.encode(extra, RANKS, PATTERN), RANKS, PATTERN)
    want = sorted(((d, library.encode_ordinary(t or ""), (t or "").encode()) for d, t in texts), key=repr)
    assert sorted(((r["doc_id"], ids(r["ids"]), bytes(r["decoded"])) for r in both.collect()), key=repr) == want
    assert both.columns == ["doc_id", "ids", "decoded"]
    assert bpe.decode(bpe.encode(empty, RANKS, PATTERN), RANKS, PATTERN).count() == 0


def test_long_texts_and_small_caches_change_nothing(spark, library):
    rng = random.Random(6)
    long = " ".join(rng.choice(("über", "naïve", "x" * 700, "12345", "\n\n", "don't")) for _ in range(60_000)) + "z" * 30_000
    df = spark.createDataFrame([(1, long), (2, "one"), (3, "one two")], "doc_id long, text string")
    found = {r["doc_id"]: ids(r["ids"]) for r in bpe.encode(df, RANKS, PATTERN, cached=0, cached_bytes=0).collect()}
    assert found == {1: library.encode_ordinary(long), 2: library.encode_ordinary("one"), 3: library.encode_ordinary("one two")}


def test_unknown_ids_and_vocabularies_without_bytes(vocabulary, tmp_path):
    with pytest.raises(ValueError, match="50256"):
        vocabulary.decode(np.array([50256], "<u4").tobytes())
    path = tmp_path / "few.tiktoken"
    path.write_bytes(base64.b64encode(b"a") + b" 0\n")
    with pytest.raises(ValueError, match="single bytes"):
        bpe.Vocabulary(str(path), PATTERN)


def test_op11_digests(spark, docs, texts, library, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, queries.op11_byte_bpe(spark, str(tmp_path)).collect()), key=repr)
    want = [(d, library.encode_ordinary(t or ""), (t or "").encode()) for d, t in texts]
    assert got == sorted(((d, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(b).hexdigest()) for d, x, b in want), key=repr)


# --- Merkle manifests


def tree(leaves: list[str], fanout: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root and paths, level by level over all leaves."""
    paths: list[list[tuple[str, str]]] = [[] for _ in leaves]
    at, level = list(range(len(leaves))), leaves
    while len(level) > 1:
        for i, place in enumerate(at):
            run = place // fanout * fanout
            paths[i].append(("".join(level[run:place]), "".join(level[place + 1 : run + fanout])))
        level = [sha(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
        at = [place // fanout for place in at]
    return level[0], paths


def folded(leaf: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        leaf = sha(left, leaf, right)
    return leaf


def field(x) -> str:
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


@pytest.mark.parametrize(("fanout", "height"), [(2, 2), (2, 5), (3, 1), (3, 3), (5, 2)])
def test_peaks_and_merging_equal_whole_trees(fanout, height):
    rng = random.Random(fanout * 10 + height)
    block = fanout**height
    for n in [1, 2, 3, fanout, block - 1, block, rng.randint(1, block)]:
        leaves = [sha(str(i)) for i in range(n)]
        cuts = sorted({0, n, *(rng.randint(0, n) for _ in range(4))})
        nodes = [x for a, b in zip(cuts, cuts[1:], strict=False) for x in merkle.peaks(leaves[a:b], a, fanout, height)]
        covered = sorted(i for level, index, _ in nodes for i in range(index * fanout**level, (index + 1) * fanout**level))
        assert covered == list(range(n))
        root, paths = merkle.merged(nodes, n, merkle.levels(n, fanout), fanout)
        want, whole = tree(leaves, fanout)
        assert root == want
        for level, index, _ in nodes:
            assert paths[level, index] == whole[index * fanout**level][level:]


@pytest.mark.parametrize(("fanout", "height", "rows"), [(2, 2, 7), (2, 12, 10_000), (3, 1, 5)])
def test_manifest_equals_brute_force(spark, fanout, height, rows):
    rng = random.Random(9)
    data = [(i, rng.choice(["b", "b", "b", "a", None, "é", ""]), rng.choice([None, "", "text", "ünïcode " * 3]), rng.choice([None, 7])) for i in range(70)]
    data += [(None, "b", "x", 1), (None, "b", "x", 1), (5, "b", "again", 1), (5, "b", "again", 1), (99, "alone", None, None)]
    df = spark.createDataFrame(data, "doc_id long, lang string, text string, n_chars long").withColumn("k", F.lit(1)).withColumn("path", F.lit("mine"))
    changed = F.when(F.col("doc_id") == 5, merkle.leaf(F.col("doc_id"), F.lit("other")))
    got = merkle.manifest(df, ["doc_id", "lang", "text", "n_chars"], changed=changed, fanout=fanout, height=height, rows=rows)
    groups: dict = {}
    for row in data:
        groups.setdefault(row[1], []).append((row[0], sha(*map(field, row))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[g] = tree([leaf for _, leaf in groups[g]], fanout)
    root, tops = tree([trees[g][0] for g in names], fanout)
    want = []
    for g, top in zip(names, tops, strict=True):
        for (doc, leaf), path in zip(groups[g], trees[g][1], strict=True):
            shown = sha(field(doc), field("other")) if doc == 5 else leaf
            want.append((doc, leaf, trees[g][0], root, sha(*(x for pair in path + top for x in pair)), folded(shown, path + top)))
    told = got.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")), merkle.fold(F.coalesce("changed", "leaf"), F.col("path")))
    assert sorted(map(tuple, told.collect()), key=repr) == sorted(want, key=repr)
    assert sum(w[5] != root for w in want) == 3


def test_manifest_of_nothing_and_of_one(spark, empty):
    docs = empty.withColumn("lang", F.lit("a"))
    assert merkle.manifest(docs, ["doc_id", "text"]).count() == 0
    one = spark.createDataFrame([(1, "a", "x")], "doc_id long, lang string, text string")
    (row,) = merkle.manifest(one, ["doc_id", "text"]).collect()
    assert row["root"] == row["subroot"] == row["leaf"] == sha("1:1", "1:x") and row["path"] == []


def test_op12_tells_tampered_rows(spark, tmp_path):
    rows = [(i, "text " * (i % 5), ("en", "de", None)[i % 3], ("web", None)[i % 2], None if i % 10 == 0 else i) for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op12_merkle(spark, str(tmp_path)).collect()}
    for doc, _, _, _, n in rows:
        assert got[doc]["verified"] == (zlib.crc32(str(doc).encode()) % 7 != 0 or n is None)
    assert {r["root"] for r in got.values()} == {got[0]["root"]}


# --- whitening


def test_scatter_by_remainders_is_exact():
    rng = np.random.default_rng(2)
    for most in (5, 1 << 20, 1 << 62):
        x = rng.integers(-most, most, (40, 3))
        moduli = whitening.primes(40 * most * most)
        assert all(all(p % d for d in range(2, math.isqrt(p) + 1)) for p in moduli) and math.prod(moduli) > 80 * most * most
        found = whitening.remaindered([whitening.scatter(x, p) for p in moduli], moduli)
        wide = np.hstack([x, np.ones((40, 1), np.int64)]).astype(object)
        assert (found == wide.T @ wide).all()


def rows_of(vectors) -> dict:
    return {d: [math.floor(256 * float(c)) for c in v] for d, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)}


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    mixed = rng.normal(size=(6, 6))
    data = [(i, [float(np.float32(c)) for c in rng.normal(size=6) @ mixed]) for i in range(200)]
    data += [(1000 + i, data[0][1]) for i in range(50)] + [(2000, None), (2001, []), (2002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2003, [math.nan] * 6), (2004, [math.inf] * 6), (None, data[1][1]), (3, data[3][1])]
    data += [(3000, [1.0, 2.0]), (3001, [2.0, 5.0]), (3002, [-4.0, 1.0]), (3003, [7.0])]
    df = spark.createDataFrame([(d, v, 1, 0.5) for d, v in data], "vec_id long, embedding array<float>, n long, x double").repartition(5)
    got = whitening.whiten(df).collect()
    kept = rows_of(data)
    for dim, most in ((6, 4), (2, 2)):
        rows = {d: x for d, x in kept.items() if len(x) == dim}
        fit = sorted(set(map(tuple, rows.values())))
        n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
        apart = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums, strict=True)] for v in fit])
        values, vectors = np.linalg.eigh(apart.T @ apart / n)
        values, vectors = values[::-1], vectors[:, ::-1]
        mine = [r for r in got if r["vec_id"] in rows and r["vec_id"] is not None]
        assert len(mine) == most * sum(d in rows for d, _ in data if d is not None)
        signs: dict = {}
        for r in mine:
            x, c = rows[r["vec_id"]], r["component"] - 1
            deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
            assert (r["n"], r["deviation"], r["deviation_digits"]) == (n, deviation, str(deviation))
            want = float((np.array(x) - np.array(sums) / n) @ vectors[:, c] / math.sqrt(values[c]))
            signs.setdefault(c, set()).add(bool(r["whitened"] * want >= 0) if abs(want) > 1e-6 else True if not signs.get(c) else next(iter(signs[c])))
            assert abs(r["whitened"]) == pytest.approx(abs(want), abs=1e-9)
            assert r["explained"] == pytest.approx(values[c] / values.sum(), rel=1e-9) and r["identity_error"] < 1e-9
        assert all(len(s) == 1 for s in signs.values())
    assert not [r for r in got if r["vec_id"] == 3003], "one vector alone varies in no direction"
    assert len([r for r in got if r["vec_id"] is None]) == 4 and len([r for r in got if r["vec_id"] == 3]) == 8


def test_whitening_of_nothing_constants_and_huge_entries(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    huge = whitening.whiten(spark.createDataFrame([(1, [1e15, 0.0]), (2, [-1e15, 0.0]), (3, [3.0, 0.0]), (4, [1e300, 0.0])], schema)).collect()
    assert len(huge) == 4 and all(r["component"] == 1 and r["deviation"] is None for r in huge)
    top = (1 << 63) - 1
    xs = {1: 256 * 10**15, 2: -256 * 10**15, 3: 768, 4: top}
    assert {r["vec_id"]: int(r["deviation_digits"]) for r in huge} == {k: (4 * x - sum(xs.values())) ** 2 for k, x in xs.items()}
