"""Packages as nested files: listed, read and told in tasks, and whole."""

from __future__ import annotations

import hashlib

from takewright.plans import catalog
from takewright.sources import packages


def test_folders_are_listed_and_read_in_tasks(spark, tmp_path):
    files = [("a", b"1"), ("b/c/d/e", b""), ("b/c/f", b"22"), ("b/g é", b"x" * 3000)]
    packages.save(spark.createDataFrame(files, "path string, content binary"), str(tmp_path))
    place, _ = packages.current(spark, str(tmp_path))
    packages.put(f"{place}/new/deep/stray", b"")
    wanted = {p: (len(c), hashlib.sha256(c).hexdigest()) for p, c in [*files, ("new/deep/stray", b"")]}
    for found in (packages.held(spark, str(tmp_path)), packages.digests(spark, str(tmp_path))):
        assert {r.path: (r.byte_size, r.sha256) for r in found.collect()} == wanted
        # a scan of files would tell the driver each of them
        assert "binaryFile" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert not any(f.endswith("stray") for f in found.inputFiles())
    assert [tuple(r) for r in packages.validated(spark, str(tmp_path), []).collect()] == [("new/deep/stray", "unmanifested file")]


def test_a_dataset_folder_has_voices_and_tells_what_is_missing(spark):
    rows = catalog.QUERIES["a28_dataset_folder"](spark, "/root/testdata/sf0.001").collect()
    kinds = {(r.path.split("/")[0], r.missing) for r in rows}
    assert {("processed", False), ("processed", True), ("raw", True)} <= kinds
    assert sum(r.path.startswith("processed/") for r in rows) == sum(r.path.startswith("transcripts/") for r in rows)
