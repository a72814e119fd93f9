"""The pipeline's stages on a small folder, each against what it must do to its own input."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from takewright.llm import mixing, registry, sampling, secrets, toxicity
from tests.llm.conftest import prose
from tests.llm.test_operators import brute_links


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    sf_dir = str(tmp_path_factory.mktemp("sf"))
    rows = []
    for i in range(150):
        words = prose(i, 60).split(" ")
        if i % 5 == 0:
            words[3::9] = ["vileword"] * len(words[3::9])
        rows.append((i, " ".join(words)))
    base = prose(999, 150).split(" ")
    rows += [(200, " ".join(base)), (201, " ".join(base)), (202, " ".join([*base[:70], "other", *base[70:]]))]
    rows += [(210, 'token = "0123456789abcdef01234567" ' + prose(7, 20)), (211, None), (212, ""), (200, " ".join(base))]
    docs = spark.createDataFrame([(d, t, "en", f"src{d % 3}", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    return sf_dir


@pytest.fixture(scope="module")
def stages(spark, folder):
    """The input and the output of each stage, written and read again."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        result = stage(spark, docs, folder)
        result.write.parquet(f"{folder}/stage{i}")
        after = spark.read.parquet(f"{folder}/stage{i}")
        out.append((name, docs, after))
        docs = after
    return out


def test_order_and_columns(stages):
    assert [name for name, _, _ in stages] == ["toxicity", "n-gram Jaccard join", "secret scans", "mixing sources to target weights", "best-fit packing"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_toxic_documents_go(spark, folder, stages):
    _, before, after = stages[0]
    net = sampling.fitted(*sampling.labelled(before, spark.read.parquet(f"{folder}/labels.parquet"), "toxic", F.lit(True), 1500), toxicity.fit)
    rows = before.collect()
    scores = toxicity.Scorer(net).score([r.text for r in rows])
    assert Counter(after.collect()) == Counter(r for r, s in zip(rows, scores, strict=True) if s < 0.7)
    kept = {r.doc_id for r in after.collect()}
    assert not kept & set(range(0, 150, 5))
    assert len(kept & {i for i in range(150) if i % 5}) >= 118


def test_one_of_each_group_stays(stages):
    _, before, after = stages[1]
    texts = sorted({(r.doc_id, r.text) for r in before.collect()}, key=str)
    links = brute_links(texts)
    root = list(range(len(texts)))
    for _ in texts:
        for i, others in enumerate(links):
            for j in others:
                root[i] = root[j] = min(root[i], root[j])
    least = defaultdict(list)
    for i, (d, _) in enumerate(texts):
        least[root[i]].append(d)
    assert sorted(r.doc_id for r in after.collect()) == sorted(min(v) for v in least.values())


def test_secrets_are_replaced(stages):
    _, before, after = stages[2]
    assert before.count() == after.count()
    found = {r.doc_id: r for r in after.collect()}
    assert found[210].text.startswith("[assign]")
    assert found[210].n_chars == len(found[210].text)
    assert {r.spans for r in secrets.report(after).collect()} == {""}
    same = {r.doc_id: r.text for r in before.collect() if r.doc_id != 210}
    assert all(found[d].text == t for d, t in same.items())


def test_mix_repeats_and_drops(stages):
    _, before, after = stages[3]
    wanted = Counter({r.doc_id: r.repeats for r in mixing.mix(before).collect() if r.repeats})
    assert Counter(r.doc_id for r in after.collect()) == wanted


def test_all_is_packed(stages):
    _, before, after = stages[4]
    rows = after.collect()
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(r.doc_id for r in before.collect())
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for some in places.values():
        some.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(some, some[1:], strict=False))
        assert sum(n for _, n in some) <= 2048


@pytest.mark.parametrize("i", range(4))
def test_clashing_columns_and_empty_tables(spark, folder, i):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id >= 190 or doc_id < 20")
    for k in ("a.b", "_found_id", "toxicity", "secrets_spans", "first_doc", "mix_source", "score", "key", "label"):
        docs = docs.withColumn(k, F.lit("own"))
    docs = docs.unionByName(docs.limit(1).select(*(F.lit(None).cast(t).alias(c) for c, t in docs.dtypes)))
    _, stage = corpus_pipeline.STAGES[i]
    out = stage(spark, docs, folder)
    assert out.columns == docs.columns
    assert {r["a.b"] for r in out.collect()} <= {"own", None}
    assert stage(spark, docs.limit(0), folder).count() == 0


def test_queries_are_registered():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(registry.ORACLE_SQL) <= set(entry.oracle_sql())
    assert corpus_pipeline.ORACLE_SQL is None
