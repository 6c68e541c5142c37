"""Sets of files with stated names that change as a whole: all new files are there, or all old ones."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from gristmill.sources.storage import open_fs, small_batches

#: Renames at a time, and texts that a task is handed at a time.
THREADS, FILES = 16, 32
JOURNAL, MANIFESTS, STAGING = "_COMMIT.json", "_MANIFESTS", "_staging"


@dataclass
class Staged(WriterCommitMessage):
    """Where a task has listed what it staged, and how many files it was."""

    listing: str
    files: int


def put_text(fs: pafs.FileSystem, path: str, body: str) -> None:
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    temp = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temp, compression=None) as out:
        out.write(body.encode())
    fs.move(temp, path)


def get_text(fs: pafs.FileSystem, path: str) -> str | None:
    if fs.get_file_info(path).type != pafs.FileType.File:
        return None
    with fs.open_input_stream(path, compression=None) as f:
        return f.read().decode()


def listed(fs: pafs.FileSystem, path: str) -> Iterator[tuple[str, str | None]]:
    """name and staged path of each file of a task; without a path the name is to go."""
    for line in (get_text(fs, path) or "").splitlines():
        yield tuple(json.loads(line))


def manifest(root: str, name: str) -> list[str]:
    """The names of the files that a committed set has, in order."""
    fs, base = open_fs(root)
    return json.loads(get_text(fs, f"{base}/{MANIFESTS}/{name}") or "[]")


def recover(root: str) -> bool:
    """Bring a commit to its end that was begun and broken off; whether there was one.

    A journal is written when every file is staged, and names them. What follows can be done again at any
    point: a file that is no longer staged is in its place.
    """
    fs, base = open_fs(root)
    journal = get_text(fs, f"{base}/{JOURNAL}")
    if journal is None:
        return False
    plan = json.loads(journal)
    folders: set[str] = set()

    def settle(entry: tuple[str, str | None]) -> None:
        name, staged = entry
        target = f"{base}/{name}"
        if staged is None:
            if fs.get_file_info(target).type == pafs.FileType.File:
                fs.delete_file(target)
        elif fs.get_file_info(staged).type == pafs.FileType.File:
            fs.move(staged, target)

    old, new = set(manifest(root, plan["set"])), set()
    with ThreadPoolExecutor(THREADS) as pool:
        for path in plan["listings"]:
            entries = list(listed(fs, path))
            for folder in {f"{base}/{n}".rpartition("/")[0] for n, s in entries if s} - folders:
                fs.create_dir(folder, recursive=True)
                folders.add(folder)
            list(pool.map(settle, entries))
            new |= {n for n, s in entries if s}
            old -= {n for n, s in entries if s is None}
        if plan["replace"]:
            list(pool.map(settle, ((n, None) for n in old - new)))
            old = set()
    put_text(fs, f"{base}/{MANIFESTS}/{plan['set']}", json.dumps(sorted(old | new), ensure_ascii=False))
    fs.delete_file(f"{base}/{JOURNAL}")
    if fs.get_file_info(f"{base}/{STAGING}").type == pafs.FileType.Directory:
        fs.delete_dir(f"{base}/{STAGING}")  # with what tasks of an aborted job have staged after it
    return True


class FileSetWriter(DataSourceArrowWriter):
    """Stages a file for each row (name, body) and commits them together."""

    def __init__(self, options: dict[str, str], replace: bool):
        if not options.get("path"):
            raise ValueError("no path to write to")
        self.root, self.set, self.replace = options["path"], options.get("set", "files"), replace
        self.staging = f"{STAGING}/{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        fs, base = open_fs(self.root)
        own, entries = f"{base}/{self.staging}/{uuid.uuid4().hex}", []  # an attempt that is repeated has a folder of its own
        fs.create_dir(own, recursive=True)
        for batch in iterator:
            at = {f.name: i for i, f in enumerate(batch.schema)}
            for name, body in zip(batch.column(at["name"]).to_pylist(), (b.as_py() for b in batch.column(at["body"])), strict=True):
                if not name or name.startswith(("/", "_")) or ".." in name.split("/"):
                    raise ValueError(f"not a name in the set: {name!r}")
                staged = None if body is None else f"{own}/{len(entries)}"
                if staged:
                    with fs.open_output_stream(staged, compression=None) as out:
                        out.write(body.encode())
                entries.append((name, staged))
        put_text(fs, f"{own}/listing", "".join(json.dumps(e, ensure_ascii=False) + "\n" for e in entries))
        return Staged(f"{own}/listing", len(entries))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = open_fs(self.root)
        recover(self.root)  # of an earlier writer
        listings, seen = [m.listing for m in messages if m is not None and m.files], set()
        for path in listings:
            for name, _ in listed(fs, path):
                if name in seen:
                    raise ValueError(f"two rows are named {name}")
                seen.add(name)
        put_text(fs, f"{base}/{JOURNAL}", json.dumps({"set": self.set, "replace": self.replace, "listings": listings}))
        recover(self.root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = open_fs(self.root)
        if fs.get_file_info(f"{base}/{self.staging}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{base}/{self.staging}")


class FileSet(DataSource):
    """Text files by name under `path`. Mode overwrite replaces the set named by `set`, append adds to it."""

    @classmethod
    def name(cls) -> str:
        return "file_set"

    def schema(self) -> str:
        return "name string, body string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return FileSetWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileSet)


def write_file_set(rows: DataFrame, root: str, name: str = "files", replace: bool = True, name_col: str = "name", body_col: str = "body") -> int:
    """Put each row's text under its name in `root`, all or none; how many files the set has then.

    Tasks stage their files; only when all have ended well are these renamed, after a journal that says what
    to do, so a task that fails leaves the old set whole and a driver that dies leaves a commit that the next writer, or
    `recover`, ends. With `replace`, files of the set's last commit that are not written now go; without, they stay. A
    null text removes its name. Two rows of one name are an error. The driver holds the names, not the texts; one
    writer at a time to a root.
    """
    spark = rows.sparkSession
    register(spark)
    shaped = rows.select(F.col(name_col).cast("string").alias("name"), F.col(body_col).cast("string").alias("body"))
    with small_batches(spark, FILES):
        shaped.write.format("file_set").mode("overwrite" if replace else "append").option("set", name).save(root)
    return len(manifest(root, name))
