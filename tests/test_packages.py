"""The package sink and the archive source: commits, failures, retries, filters, hostile archives."""

from __future__ import annotations

import hashlib
import io
import json
import os
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from takewright.functions import signal
from takewright.operators import dataset
from takewright.sources import archives, packages


@pytest.fixture
def files(spark):
    rows = [(f"raw/{i % 3}/take-{i}.bin", bytes([i]) * (100 + i)) for i in range(40)] + [("README.md", b"about"), ("raw/lost.bin", None), ("été/naïve.txt", b"")]
    return spark.createDataFrame(rows, "path string, content binary").repartition(5)


@pytest.mark.parametrize("layout", ["files", "archives"])
def test_package_is_read_as_it_was_written(spark, files, tmp_path, layout):
    root = str(tmp_path / "p")
    packages.save(files, root, layout, archive_bytes=1000)
    place, whole = packages.current(spark, root)
    assert (whole["layout"], whole["files"], whole["missing"]) == (layout, 42, 1)
    assert os.path.exists(f"{place}/EXPORT_COMPLETE") and not os.path.exists(f"{place}/EXPORT_INCOMPLETE")
    wanted = {r["path"]: r["content"] and bytes(r["content"]) for r in files.collect()}
    wanted["été/naïve.txt"] = b""
    told = {r["path"]: r for r in packages.manifest(spark, root).collect()}
    assert {p: None if r["missing"] else r["sha256"] for p, r in told.items()} == {p: None if c is None else hashlib.sha256(c).hexdigest() for p, c in wanted.items()}
    assert {r["path"]: bytes(r["content"]) for r in packages.held(spark, root).collect()} == {p: c for p, c in wanted.items() if c is not None}
    assert packages.validated(spark, root, ["README.md"]).count() == 0
    assert [tuple(r) for r in packages.validated(spark, root, ["LICENSE"]).collect()] == [("LICENSE", "required file missing")]


def test_changed_and_additional_files_are_told(spark, files, tmp_path):
    root = str(tmp_path / "p")
    packages.save(files, root)
    place, _ = packages.current(spark, root)
    with open(f"{place}/raw/0/take-0.bin", "ab") as f:
        f.write(b"more")
    with open(f"{place}/README.md", "wb") as f:
        f.write(b"ABOUT")
    with open(f"{place}/extra.txt", "w") as f:
        f.write("x")
    os.remove(f"{place}/raw/1/take-1.bin")
    assert sorted(tuple(r) for r in packages.validated(spark, root, []).collect()) == [("README.md", "sha256 differs"), ("extra.txt", "unmanifested file"), ("raw/0/take-0.bin", "size differs"), ("raw/1/take-1.bin", "missing file")]


@pytest.mark.parametrize("layout", ["files", "archives"])
def test_a_failed_write_leaves_the_version_before(spark, files, tmp_path, layout):
    root = str(tmp_path / "p")
    packages.save(files, root, layout)
    before = packages.current(spark, root)
    broken = files.withColumn("content", F.when(F.col("path") == "raw/1/take-7.bin", F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        packages.save(broken, root, layout)
    assert packages.current(spark, root) == before
    # a task that ended after the abort may have left files, but no version
    complete = [v for v in os.listdir(f"{root}/versions") if os.path.exists(f"{root}/versions/{v}/EXPORT_COMPLETE")]
    assert complete == [before[0].rsplit("/", 1)[1]]
    first = str(tmp_path / "never")
    with pytest.raises(Exception, match="lost"):
        packages.save(broken, first, layout)
    assert not os.path.exists(f"{first}/CURRENT")


@pytest.mark.parametrize("path", ["../x", "/x", "a//b", "a\\b", "", "manifest.json", "_manifest/x", "archives/x"])
def test_unsafe_paths_fail(spark, tmp_path, path):
    with pytest.raises(Exception, match="unsafe path"):
        packages.save(spark.createDataFrame([(path, b"x")], "path string, content binary"), str(tmp_path / "p"))
    assert not os.path.exists(tmp_path / "p" / "CURRENT")


def test_duplicate_paths_fail(spark, tmp_path):
    with pytest.raises(Exception, match="duplicate path: a"):
        packages.save(spark.createDataFrame([("a", b"x"), ("a", b"x")], "path string, content binary"), str(tmp_path / "p"))
    assert not os.path.exists(tmp_path / "p" / "CURRENT") and os.listdir(tmp_path / "p" / "versions") == []


def test_an_empty_package_is_complete(spark, tmp_path):
    for layout in ("files", "archives"):
        root = str(tmp_path / layout)
        packages.save(spark.createDataFrame([], "path string, content binary"), root, layout)
        assert packages.manifest(spark, root).count() == packages.held(spark, root).count() == packages.validated(spark, root, []).count() == 0


def test_attempts_that_do_not_count_are_deleted(tmp_path):
    from pyspark.sql.types import StructType

    writer = packages.PackageWriter(str(tmp_path), "archives", 1 << 20, StructType.fromDDL("path string, content binary"))
    kept, lost = packages.Shards(writer.place, "000000-1", 1 << 20), packages.Shards(writer.place, "000000-2", 1 << 20)
    for sink in (kept, lost):
        sink.add("a", b"a")
        sink.close()
    for attempt in ("000000-1", "000000-2"):
        packages.put(f"{writer.place}/_manifest/part-{attempt}.jsonl", b"{}\n")
    packages.put(f"{writer.place}/_attempt-000000-3/x", b"x")
    writer.commit([packages.Written("_manifest/part-000000-1.jsonl", "", 1, 0, 1), None])
    assert os.listdir(f"{writer.place}/archives") == ["part-000000-1-00000.zip"]
    assert sorted(os.listdir(writer.place)) == ["EXPORT_COMPLETE", "_manifest", "archives", "manifest.json"]
    assert [p["part"] for p in json.load(open(f"{writer.place}/manifest.json"))["parts"]] == ["_manifest/part-000000-1.jsonl"] == ["_manifest/" + n for n in os.listdir(f"{writer.place}/_manifest")]


# --- archives as a source


@pytest.fixture
def folder(tmp_path):
    for n in range(3):
        (tmp_path / f"a{n}.zip").write_bytes(archives.pack([(f"t/{n}-{i}.bin", bytes([n, i]) * 500) for i in range(20)]))
    return tmp_path


def test_ranges_hold_all_entries(spark, folder):
    df = archives.scan(spark, str(folder), range_bytes=4000)
    assert df.rdd.getNumPartitions() == 15
    rows = df.collect()
    assert {(r["path"], bytes(r["content"])) for r in rows} == {(f"t/{n}-{i}.bin", bytes([n, i]) * 500) for n in range(3) for i in range(20)}
    assert all(r["error"] is None and r["byte_size"] == 1000 for r in rows)
    assert all(r["content"] is None and r["byte_size"] == 1000 for r in archives.scan(spark, str(folder), content="false").collect())


def test_filters_read_the_named_entries_alone(spark, folder):
    raw = bytearray((folder / "a1.zip").read_bytes())
    at = raw.index(bytes([1, 3]) * 500)
    raw[at] ^= 0xFF
    (folder / "a1.zip").write_bytes(bytes(raw))
    broken = archives.scan(spark, str(folder)).where("error is not null").collect()
    assert [(r["path"], r["content"]) for r in broken] == [("t/1-3.bin", None)] and "CRC" in broken[0]["error"]
    for condition, wanted in (("path = 't/1-4.bin'", 1), ("path in ('t/1-4.bin', 't/2-0.bin')", 2), ("path like 't/2-%'", 20), (f"archive = '{folder}/a0.zip'", 20)):
        df = archives.scan(spark, str(folder)).where(condition)
        assert df.count() == wanted
        assert df.rdd.getNumPartitions() <= 2
    assert archives.scan(spark, str(folder / "a1.zip")).where("path = 't/1-3.bin' and error is not null").count() == 1


def test_recordings_are_named_and_not_matched(spark, tmp_path):
    for name in ("a1.wav", "a[1].wav", "a*.wav"):
        (tmp_path / name).write_bytes(name.encode())
    for name in ("a[1].wav", "a*.wav"):
        assert [bytes(r["content"]) for r in archives.recording(spark, str(tmp_path), name).collect()] == [name.encode()]


def hostile() -> dict[str, bytes]:
    def made(*files: tuple[str, bytes], compress: int = zipfile.ZIP_STORED) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", compress) as z:
            for path, content in files:
                z.writestr(path, content)
        return out.getvalue()

    two = made(("a", b"x" * 50), ("b", b"y" * 50))
    entry = two.rindex(b"PK\x01\x02")
    overlapping = bytearray(two)
    overlapping[entry + 42 : entry + 46] = (10).to_bytes(4, "little")
    sizes = bytearray(two)
    sizes[entry + 24 : entry + 28] = (49).to_bytes(4, "little")
    return {"overlapping": bytes(overlapping), "sizes differ": bytes(sizes), "unsafe path": made(("../a", b"x")), "unsupported": made(("a", b"x" * 99), compress=zipfile.ZIP_DEFLATED), "not a zip": b"nothing", "too many": made(*((str(i), b"") for i in range(5001)))}


@pytest.mark.parametrize("kind", list(hostile()))
def test_hostile_archives_fail_by_name(spark, tmp_path, kind):
    (tmp_path / "x.zip").write_bytes(hostile()[kind])
    (row,) = archives.scan(spark, str(tmp_path), strict="true").collect()
    assert kind in row["error"].lower() and row["path"] is None
    assert archives.entries(hostile()[kind])[0]["error"] == row["error"]
    if kind == "too many":
        assert archives.scan(spark, str(tmp_path)).where("error is null").count() == 5001


def test_archives_beyond_two_gigabytes(spark, tmp_path):
    """A sparse archive of 2.2 GB: a range of it is read, not the whole."""
    path, large = tmp_path / "large.zip", 2_200_000_000
    with open(path, "wb") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_STORED) as z:
        z.writestr("first.txt", "one")
        info = zipfile.ZipInfo("hole.bin")
        with z.open(info, "w", force_zip64=False) as hole:
            for _ in range(22):
                hole.write(bytes(1 << 20))
        z.writestr("last.txt", "two")
    with open(path, "rb") as f, zipfile.ZipFile(f) as z:
        start, infos = z.start_dir, z.infolist()
    raw = path.read_bytes()
    tail = bytearray(raw[start:])
    gap = large - len(raw)
    # the hole grows to the size wanted; its own checksum is not looked at
    at = tail.index(b"hole.bin") - 46
    for field in (20, 24):
        tail[at + field : at + field + 4] = (infos[1].file_size + gap).to_bytes(4, "little")
    at = tail.index(b"last.txt") - 46
    tail[at + 42 : at + 46] = (infos[2].header_offset + gap).to_bytes(4, "little")
    end = tail.rindex(b"PK\x05\x06")
    tail[end + 16 : end + 20] = (start + gap).to_bytes(4, "little")
    with open(path, "wb") as f:
        f.write(raw[: infos[2].header_offset])
        f.seek(infos[2].header_offset + gap)
        f.write(raw[infos[2].header_offset : start])
        f.write(bytes(tail))
    assert os.path.getsize(path) > 1 << 31
    found = archives.scan(spark, str(path))
    assert [(r["path"], bytes(r["content"])) for r in found.where("path in ('last.txt', 'first.txt')").orderBy("path").collect()] == [("first.txt", b"one"), ("last.txt", b"two")]
    assert archives.scan(spark, str(path), content="false").agg(F.sum("byte_size")).first()[0] > 1 << 31


# --- recordings as they are analysed


def pcm(channels: np.ndarray, depth: int, rate: int) -> bytes:
    whole = np.round(channels.T.reshape(-1) * (2 ** (depth - 1) - 1)).astype(np.int64)
    data = (whole + 128).astype("u1").tobytes() if depth == 8 else b"".join(int(v).to_bytes(depth // 8, "little", signed=True) for v in whole)
    n = len(channels)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data) + len(data) % 2, b"WAVE", b"fmt ", 16, 1, n, rate, rate * n * depth // 8, n * depth // 8, depth, b"data", len(data))
    return head + data + b"\0" * (len(data) % 2)


@pytest.mark.parametrize("depth", [8, 16, 24, 32])
@pytest.mark.parametrize("channels", [1, 2])
def test_decoding_gives_back_samples(depth, channels):
    x = np.stack([0.7 * np.sin(np.arange(1001) / (9 + c)) for c in range(channels)])
    got, rate = signal.decode_wav(pcm(x, depth, 22_050))
    assert got.shape == x.shape and rate == 22_050
    assert np.abs(got - x).max() <= 2.0 ** (2 - depth)


def test_voices_of_stereo_long_and_broken_recordings(monkeypatch):
    rng = np.random.default_rng(0)
    voice, noise = 0.4 * np.sin(np.arange(32_000) * 2 * np.pi * 220 / 32_000), 0.3 * rng.normal(size=32_000)
    raw = pcm(np.clip(np.stack([voice + noise, voice - noise]), -1, 1), 16, 32_000)
    x = signal.analysis_signals(raw)
    assert len(x["mono"]) == 16_000 and np.allclose(x["mono"], (x["left"] + x["right"]) / 2)
    found = signal.processed_voice(raw)
    parted, rate = signal.decode_wav(found["content"])
    assert (found["method"], rate, parted.shape) == ("spectral_mid_side_residual_vocal_band", 16_000, (1, 16_000))
    assert np.corrcoef(parted[0], np.sin(np.arange(16_000) * 2 * np.pi * 220 / 16_000))[0, 1] > 0.9
    monkeypatch.setattr(signal, "MOST_SPECTRAL_S", 0.5)
    assert signal.processed_voice(raw)["method"] == "vocal_band_transient_reduction"
    for broken in (None, b"", raw[:-2], b"x" * 99):
        found = signal.processed_voice(broken)
        assert found["content"] is None and found["error"]


def test_plan_without_keepers_recordings_or_prompts(spark):
    takes = "session_id long, take_ord long, speaker_id long, prompt_id long, rating string, text string, words long, duration_ms long"
    prompts = spark.createDataFrame([(1, "en", "slow", "low", "calm")], "prompt_id long, language string, pace string, energy string, intent string")
    store = spark.createDataFrame([], "file_name string, content binary")
    names = lambda rows: sorted(r["path"] for r in dataset.plan(spark.createDataFrame(rows, takes), prompts, store).collect())
    whole = ["README.md", *sorted(f"reports/report.{r}.json" for r in dataset.REPORTS)]
    assert names([]) == whole
    assert names([(7, 0, 1, 1, "reject", "x", 1, 400)]) == [*whole, "sessions/sessions-00000000.jsonl"]
    rows = {r["path"]: r["content"] and bytes(r["content"]) for r in dataset.plan(spark.createDataFrame([(7, 0, 1, 99, "keeper", None, 0, 0), (1007, 3, 1, 1, "keeper", 'say "é"', 2, 800)], takes), prompts, store).collect()}
    assert rows["raw/7-0.wav"] is rows["processed/7-0.wav"] is None and rows["transcripts/7-0.txt"] == b""
    assert json.loads(rows["metadata/7-0.json"])["pace"] is None
    assert [json.loads(x)["transcript"] for p in ("manifests/training_manifest-00000000.jsonl", "manifests/training_manifest-00000001.jsonl") for x in rows[p].decode().splitlines()] == ["", 'say "é"']
    assert json.loads(rows["phonemes/1007-3.json"])["wordPhonemeMap"][1] == {"word": '"é"', "normalized": '"é"', "startMs": 400, "endMs": 800}


def test_a_key_with_more_than_an_archive_holds_has_several(spark):
    rows = [("a", f"{i:05d}.txt", b"x" * 100) for i in range(6000)] + [("b", "y.txt", None), (None, "z.txt", b"z" * 9000)]
    files = spark.createDataFrame(rows, "key string, path string, content binary")
    made = archives.zip_groups(files, "key")
    assert {r["key"] for r in made.collect()} == {"a", "b", None} and made.where("key = 'a'").count() > 1
    small = archives.zip_groups(files, "key", most_bytes=5000)
    assert max(r["n"] for r in small.where("key = 'a'").selectExpr("length(content) n").collect()) < 5000 + 50 * 200
    for some in (made, small):
        found = archives.unzip(some, most_bytes=1000)
        assert found.columns == ["key", "path", "content", "crc", "error"]
        assert sorted(((r["key"] or "", r["path"], bytes(r["content"])) for r in found.collect()), key=str) == sorted(((k or "", p, c or b"") for k, p, c in rows), key=str)
        assert found.where("error is not null or crc <> crc32(content)").count() == 0


def test_files_other_than_manifested_keep_their_size(spark, tmp_path):
    from takewright.plans import catalog

    texts = {4: "", 14: "\x01", 24: "café", 34: "\U0001f600", 44: None, 3: None, 5: None, 13: "", 12: "x", 1: "y"}
    spark.createDataFrame([(i, t, "s", "en") for i, t in texts.items()], "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["path"]: r["error"] for r in catalog.QUERIES["a25_o02_package_archives"](spark, str(tmp_path)).collect()}
    kinds = {1: "missing file", 2: "unmanifested file", 3: "size differs", 4: "sha256 differs"}
    assert found == {f"text/{i}.txt": kinds[i % 10] for i in texts if i % 10 in kinds} | {"manifest.json": "required file missing"}
