"""Packages of files as a transactional sink: ``df.write.format("package")`` of rows (path, content).

Every task writes its own files and a part of the manifest; what is committed is what the one commit on the driver names, last of all.  A package is a folder:

    CURRENT                      the id of the version that is complete
    versions/<id>/<path>         files, or archives of them
    versions/<id>/_manifest/     a part for each task: a line for each file
    versions/<id>/manifest.json  the parts with their digests, and the counts
    versions/<id>/EXPORT_COMPLETE

A task that is lost or run twice leaves files that no committed part names, and they go with the commit; a failed job leaves no complete version, and
the version before it stays current.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .archives import MOST_ENTRIES, directory, unsafe
from .shared import shared_folder

COMPLETE, INCOMPLETE = "EXPORT_COMPLETE", "EXPORT_INCOMPLETE"
PART = "path string, byte_size long, sha256 string, archive string, missing boolean"


def file_system(path: str):
    """pyarrow's file system for a path or URI, with the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.removeprefix("file:"))


def put(path: str, content: bytes) -> None:
    system, at = file_system(path)
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(at) as out:
        out.write(content)


@dataclass
class Written(WriterCommitMessage):
    part: str
    sha256: str
    files: int
    missing: int
    byte_size: int


class Files:
    """A task's files, one by one: first beside the package, then moved into it when the task is done."""

    def __init__(self, root: str, attempt: str):
        self.root, self.aside = root, f"{root}/_attempt-{attempt}"
        self.system, _ = file_system(root)
        self.paths: list[str] = []

    def add(self, path: str, content: bytes) -> str | None:
        put(f"{self.aside}/{path}", content)
        self.paths.append(path)
        return None

    def close(self) -> None:
        for path in self.paths:
            _, to = file_system(f"{self.root}/{path}")
            self.system.create_dir(to.rsplit("/", 1)[0], recursive=True)
            self.system.move(file_system(f"{self.aside}/{path}")[1], to)
        if self.paths:
            self.system.delete_dir(file_system(self.aside)[1])


class Entrywise(io.RawIOBase):
    """A stream that goes forward alone, behind a file in which the entry that is being written can still be gone back to."""

    def __init__(self, out):
        self.out, self.base, self.entry = out, 0, io.BytesIO()

    def write(self, data: bytes) -> int:
        return self.entry.write(data)

    def tell(self) -> int:
        return self.base + self.entry.tell()

    def seek(self, to: int, whence: int = 0) -> int:
        return self.base + self.entry.seek(to - self.base if whence == 0 else to, whence)

    def seekable(self) -> bool:
        return True

    def settle(self) -> None:
        self.out.write(self.entry.getvalue())
        self.base, self.entry = self.base + len(self.entry.getvalue()), io.BytesIO()


class Shards:
    """A task's files in archives without compression, of at most ``most`` bytes of files and as many entries as a reader takes."""

    def __init__(self, root: str, attempt: str, most: int):
        self.root, self.attempt, self.most = root, attempt, most
        self.count, self.name, self.zip, self.out = 0, "", None, None

    def add(self, path: str, content: bytes) -> str:
        if self.zip is None or (self.held and self.held + len(content) > self.most) or self.entries == MOST_ENTRIES:
            self.close()
            self.name = f"archives/part-{self.attempt}-{self.count:05d}.zip"
            system, at = file_system(f"{self.root}/{self.name}")
            system.create_dir(at.rsplit("/", 1)[0], recursive=True)
            self.out = system.open_output_stream(at)
            self.file = Entrywise(self.out)
            self.zip = zipfile.ZipFile(self.file, "w", zipfile.ZIP_STORED)
            self.count, self.held, self.entries = self.count + 1, 0, 0
        self.zip.writestr(zipfile.ZipInfo(path, (1980, 1, 1, 0, 0, 0)), content)
        self.file.settle()
        self.held, self.entries = self.held + len(content), self.entries + 1
        return self.name

    def close(self) -> None:
        if self.zip is not None:
            self.zip.close()
            self.file.settle()
            self.out.close()
            self.zip = None


def publish(root: str, version: str) -> None:
    """Turn the pointer to a version, in one move."""
    put(f"{root}/CURRENT-{version}", version.encode())
    system, at = file_system(f"{root}/CURRENT-{version}")
    system.move(at, file_system(f"{root}/CURRENT")[1])


def discard(place: str) -> None:
    from pyarrow import fs

    system, at = file_system(place)
    if system.get_file_info(at).type == fs.FileType.Directory:
        system.delete_dir(at)


class PackageWriter(DataSourceWriter):
    def __init__(self, root: str, layout: str, archive_bytes: int, schema: StructType, version: str | None = None):
        if layout not in ("files", "archives"):
            raise ValueError(f"layout is files or archives, not {layout}")
        names = schema.fieldNames()
        if not {"path", "content"} <= set(names):
            raise ValueError(f"a package needs the columns path and content, not {names}")
        self.root, self.layout, self.archive_bytes = root.rstrip("/"), layout, archive_bytes
        self.version, self.published = version or uuid.uuid4().hex, version is None
        self.place = f"{self.root}/versions/{self.version}"

    def write(self, iterator: Iterator[Row]) -> Written:
        context = TaskContext.get()
        attempt = f"{context.partitionId():06d}-{context.taskAttemptId()}"
        put(f"{self.place}/{INCOMPLETE}", b"A package without EXPORT_COMPLETE is not complete.")
        sink = Files(self.place, attempt) if self.layout == "files" else Shards(self.place, attempt, self.archive_bytes)
        lines, files, missing, held = [], 0, 0, 0
        for row in iterator:
            if row["path"] is None or unsafe(row["path"]) or row["path"].startswith(("_", "archives/", COMPLETE, INCOMPLETE)) or row["path"] == "manifest.json":
                raise ValueError(f"unsafe path: {row['path']}")
            line = {"path": row["path"], "byte_size": None, "sha256": None, "archive": None, "missing": row["content"] is None}
            if row["content"] is None:
                missing += 1
            else:
                content = bytes(row["content"])
                line |= {"byte_size": len(content), "sha256": hashlib.sha256(content).hexdigest(), "archive": sink.add(row["path"], content)}
                files, held = files + 1, held + len(content)
            lines.append(json.dumps(line, ensure_ascii=False))
        sink.close()
        text = "".join(f"{x}\n" for x in lines).encode()
        part = f"_manifest/part-{attempt}.jsonl"
        put(f"{self.place}/{part}", text)
        return Written(part, hashlib.sha256(text).hexdigest(), files, missing, held)

    def commit(self, messages: list[Written | None]) -> None:
        """The manifest, the marker and, last, the pointer to this version; what tasks left that count for nothing is deleted before."""
        from pyarrow import fs

        system, at = file_system(self.place)
        kept = {m.part for m in messages if m is not None}
        system.create_dir(at, recursive=True)
        for info in system.get_file_info(fs.FileSelector(at, allow_not_found=True)):
            if info.base_name.startswith("_attempt-"):
                system.delete_dir(info.path)
        for info in system.get_file_info(fs.FileSelector(f"{at}/_manifest", allow_not_found=True)):
            if f"_manifest/{info.base_name}" not in kept:
                system.delete_file(info.path)
        attempts = {p.removeprefix("_manifest/part-").removesuffix(".jsonl") for p in kept}
        for info in system.get_file_info(fs.FileSelector(f"{at}/archives", allow_not_found=True)):
            if info.base_name.removeprefix("part-").rsplit("-", 1)[0] not in attempts:
                system.delete_file(info.path)
        done = [m for m in messages if m is not None]
        counts = {"format": "package.v1", "layout": self.layout, "files": sum(m.files for m in done), "missing": sum(m.missing for m in done), "bytes": sum(m.byte_size for m in done)}
        parts = [{"part": m.part, "sha256": m.sha256} for m in sorted(done, key=lambda m: m.part) if m.files or m.missing]
        put(f"{self.place}/manifest.json", json.dumps(counts | {"parts": parts}).encode())
        put(f"{self.place}/{COMPLETE}", b"complete")
        if system.get_file_info(f"{at}/{INCOMPLETE}").type == fs.FileType.File:
            system.delete_file(f"{at}/{INCOMPLETE}")
        if self.published:
            publish(self.root, self.version)

    def abort(self, messages: list[Written | None]) -> None:
        discard(self.place)


class Package(DataSource):
    """The sink; options ``path``, ``layout`` (files or archives), ``archive_bytes`` and ``version``: a version that is named is complete after the write, and current when it is published."""

    @classmethod
    def name(cls) -> str:
        return "package"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> PackageWriter:
        return PackageWriter(self.options["path"], self.options.get("layout", "files"), int(self.options.get("archive_bytes", 256 << 20)), schema, self.options.get("version"))


def save(files: DataFrame, root: str, layout: str = "files", archive_bytes: int = 256 << 20) -> None:
    """Write ``files`` (path, content; null content: missing, told in the manifest and never fatal) as the new version of the package at ``root``.

    ``files`` is made once.  The version is read again before it counts: one in which a path is given twice, like one with an unsafe path, is deleted, and the
    one before stays current.
    """
    spark, version, root = files.sparkSession, uuid.uuid4().hex, root.rstrip("/")
    spark.dataSource.register(Package)
    files.select("path", "content").write.format("package").option("layout", layout).option("archive_bytes", archive_bytes).option("version", version).mode("append").save(root)
    twice = told(spark, f"{root}/versions/{version}").groupBy("path").count().where("count > 1").select("path").limit(1).collect()
    if twice:
        discard(f"{root}/versions/{version}")
        raise ValueError(f"duplicate path: {twice[0]['path']}")
    publish(root, version)


def whole(spark: SparkSession, place: str) -> dict:
    return json.loads("".join(r[0] for r in spark.read.text(f"{place}/manifest.json").collect()))


def told(spark: SparkSession, place: str) -> DataFrame:
    """The lines of a version's manifest."""
    parts = [f"{place}/{p['part']}" for p in whole(spark, place)["parts"]]
    return spark.read.schema(PART).json(parts) if parts else spark.createDataFrame([], PART)


def current(spark: SparkSession, root: str) -> tuple[str, dict]:
    """The folder of the version that is complete, and its manifest.json."""
    version = spark.read.text(f"{root}/CURRENT").first()[0]
    place = f"{root}/versions/{version}"
    return place, whole(spark, place)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """path, byte_size, sha256, archive and missing of the package's files, from the parts that the commit names."""
    return told(spark, current(spark, root)[0])


def listed(spark: SparkSession, place: str) -> DataFrame:
    """``path`` of the files of a version's folder, empty ones too: folders are listed in tasks, one level after another, and no file is told to the driver."""
    shared, levels = shared_folder(spark, "listing"), []

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, at = file_system(place)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = system.get_file_info(fs.FileSelector(f"{at}/{folder}".rstrip("/"), allow_not_found=True))
                for k in range(0, len(found), 10_000):
                    some = found[k : k + 10_000]
                    paths = [f"{folder}/{x.base_name}".lstrip("/") for x in some]
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([x.type == fs.FileType.Directory for x in some], pa.bool_())], names=["path", "folder"])

    folders = spark.createDataFrame([("",)], "path string")
    while folders.limit(1).count():
        levels.append(f"{shared}/{len(levels)}")
        dealt(folders).mapInArrow(look, "path string, folder boolean").write.parquet(levels[-1])
        folders = spark.read.schema("path string, folder boolean").parquet(levels[-1]).where("folder and path <> '_manifest'").select("path")
    files = spark.read.schema("path string, folder boolean").parquet(*levels).where("not folder").select("path")
    return files.where(~F.col("path").isin("manifest.json", COMPLETE))


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` of names in four tasks a core at least: what is named is more than the names."""
    return rows.repartition(max(64, 4 * rows.sparkSession.sparkContext.defaultParallelism))


def contents(paths: DataFrame, place: str, whole: bool = True) -> DataFrame:
    """path, byte_size, sha256 and, if they are asked for as a ``whole``, content of files, each read once and hashed where it is read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = file_system(place)

        def told(some: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array([x[i] for x in some], t) for i, t in enumerate(types)]
            return pa.RecordBatch.from_arrays(columns, names=names)

        types, names = [pa.string(), pa.int64(), pa.string(), pa.binary()][: 3 + whole], ["path", "byte_size", "sha256", "content"][: 3 + whole]
        for batch in batches:
            some: list[tuple] = []
            size = 0
            for path in batch.column(0).to_pylist():
                with system.open_input_stream(f"{at}/{path}") as f:
                    content = f.read()
                some.append((path, len(content), hashlib.sha256(content).hexdigest(), *([content] if whole else [])))
                size += len(content) * whole
                if size > 1 << 22 or len(some) == 1000:
                    yield told(some)
                    some, size = [], 0
            if some:
                yield told(some)

    return dealt(paths).mapInArrow(read, "path string, byte_size long, sha256 string" + ", content binary" * whole)


def archived(spark: SparkSession, folder: str) -> DataFrame:
    """path and content of all entries of a folder's archives, an archive a task; an archive that is not whole ends the query.

    For all entries of many archives; ``archives.scan`` is for some, or for archives of any size.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, at = file_system(name)
                with system.open_input_file(at) as f, zipfile.ZipFile(f) as z:
                    some: list[tuple[str, bytes]] = []
                    for info in directory(z, f.size()):
                        some.append((info.filename, z.read(info)))
                        if sum(len(c) for _, c in some[-1:]) > 1 << 20 or len(some) == 500:
                            yield table(some)
                            some = []
                    yield table(some)

    def table(some: list[tuple[str, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in some], pa.string()), pa.array([c for _, c in some], pa.binary())], names=["path", "content"])

    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder).select("path")
    return names.repartition("path").mapInArrow(unpack, "path string, content binary")


def held(spark: SparkSession, root: str) -> DataFrame:
    """path, byte_size, sha256 and content of the files that are there, whatever the manifest says."""
    place, about = current(spark, root)
    if about["layout"] != "archives":
        return contents(listed(spark, place), place)
    found = archived(spark, f"{place}/archives") if about["files"] else spark.createDataFrame([], "path string, content binary")
    return found.select("path", F.octet_length("content").cast("long").alias("byte_size"), F.sha2("content", 256).alias("sha256"), "content")


def digests(spark: SparkSession, root: str) -> DataFrame:
    """``held`` without contents, read once and written into the shared folder, for all that is asked of it."""
    place, about = current(spark, root)
    found = held(spark, root).drop("content") if about["layout"] == "archives" else contents(listed(spark, place), place, whole=False)
    found.write.parquet(kept := shared_folder(spark, "digests"))
    return spark.read.schema("path string, byte_size long, sha256 string").parquet(kept)


def validated(spark: SparkSession, root: str, required: list[str], found: DataFrame | None = None) -> DataFrame:
    """(path, error): what is wrong with the package when it is read again; a whole one has no rows.  ``found``: its digests, if they are known."""
    from ..operators import package

    return package.validate(manifest(spark, root).where("not missing"), digests(spark, root) if found is None else found, required)
