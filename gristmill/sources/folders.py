"""Data sources over folders of files that list and read only what a query's filters ask for.

    register(spark)
    spark.read.format("topic_batches").load(root).where("topic_id in (3, -1)")
    spark.sql("select * from article_files where article_id = 'article_7'")   # over a view of format "article_files"
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from gristmill.sources.storage import open_fs

BATCH_FIELDS = ("sample_id", "topic_name", "topic_text")
BATCH_SCHEMA = "sample_id string, topic_name string, topic_text string, topic_id int, batch_id int, file_path string"
ARTICLE_SCHEMA = "article_id string, source string, file_path string"
ARTICLE_SUFFIXES = (".grobid.tei.xml", ".tei.xml", ".xml")
#: Bytes of files that one task reads.
BUNDLE = 32 << 20
_FOLDER = re.compile(r"topic_(-?\d+)")
_BATCH = re.compile(r"topic_.*_batch_(\d+)\.csv")


@dataclass
class Files(InputPartition):
    """Files that one task reads: path and what the path says of each."""

    paths: list[tuple[str, tuple]]

    def __init__(self, paths: list[tuple[str, tuple]]):
        super().__init__(None)
        self.paths = paths


class Wanted:
    """What filters leave of a column: a set of values, or all within bounds."""

    def __init__(self, tests: Iterable = ()):
        self.values: set | None = None
        self.tests = list(tests)

    def take(self, f: Filter) -> bool:
        """Note a filter, if it is of a kind that files can be chosen by."""
        if isinstance(f, EqualTo | EqualNullSafe):
            self.only({f.value})
        elif isinstance(f, In):
            self.only(set(f.value))
        elif isinstance(f, GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
            self.tests.append((type(f).__name__, f.value))
        else:
            return isinstance(f, IsNotNull)
        return True

    def only(self, values: set) -> None:
        self.values = values if self.values is None else self.values & values

    def within(self, value: Any) -> bool:
        compare = {"GreaterThan": lambda b: value > b, "GreaterThanOrEqual": lambda b: value >= b, "LessThan": lambda b: value < b, "LessThanOrEqual": lambda b: value <= b}
        return all(compare[name](bound) for name, bound in self.tests)

    def holds(self, value: Any) -> bool:
        return (self.values is None or value in self.values) and self.within(value)


def bundles(files: list[tuple[str, int, tuple]]) -> list[Files]:
    """Files in order, as many to a task as BUNDLE bytes hold, one at least."""
    out, held = [], 0
    for path, size, facts in files:
        if not out or held + size > BUNDLE:
            out.append(Files([]))
            held = 0
        out[-1].paths.append((path, facts))
        held += size
    return out


def read_bytes(fs: pafs.FileSystem, path: str) -> bytes:
    with fs.open_input_stream(path, compression=None) as f:
        return f.read()


class FolderReader(DataSourceReader):
    """A reader whose partitions are files; filters on `keys`, which paths tell, choose them and go no further."""

    keys: tuple[str, ...] = ()

    def __init__(self, options: dict[str, str]):
        if not options.get("path"):
            raise ValueError("no path to read from")
        self.path, self.strict = options["path"], options.get("missing", "error") == "error"
        self.wanted = {k: Wanted() for k in self.keys}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name not in self.wanted or not self.wanted[name].take(f):
                yield f

    def refuse_missing(self, key: str, there: set) -> None:
        wanted = self.wanted[key]
        missing = sorted(v for v in wanted.values or () if v is not None and v not in there and wanted.within(v))
        if missing and self.strict:
            raise FileNotFoundError(f"no such {key} in {self.path}: {', '.join(map(str, missing))}")


class BatchReader(FolderReader):
    keys = ("topic_id", "batch_id")

    def partitions(self) -> list[Files]:
        fs, base = open_fs(self.path)
        folders = {}
        for f in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
            if not f.is_file and (m := _FOLDER.fullmatch(f.base_name)):
                folders[int(m[1])] = f.path
        self.refuse_missing("topic_id", set(folders))
        found, any_file = [], False
        for topic in sorted(folders):
            if not self.wanted["topic_id"].holds(topic):
                continue
            for f in sorted(fs.get_file_info(pafs.FileSelector(folders[topic])), key=lambda f: f.path):
                if f.is_file and (m := _BATCH.fullmatch(f.base_name)):
                    any_file = True
                    if self.wanted["batch_id"].holds(int(m[1])):
                        found.append((f.path, f.size, (topic, int(m[1]))))
        if not any_file and self.strict:
            raise FileNotFoundError(f"no batch files topic_*/topic_*_batch_*.csv in {self.path}")
        return bundles(found) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(self.path)
        for path, (topic, batch) in partition.paths:
            rows = list(csv.DictReader(io.StringIO(read_bytes(fs, path).decode("utf-8-sig"), newline="")))
            if lacking := [c for c in BATCH_FIELDS if rows and c not in rows[0]]:
                raise ValueError(f"{path} lacks the columns {', '.join(lacking)}")
            n = len(rows)
            texts = [pa.array([r[c] or None for r in rows], pa.string()) for c in BATCH_FIELDS]
            yield pa.RecordBatch.from_arrays([*texts, pa.array([topic] * n, pa.int32()), pa.array([batch] * n, pa.int32()), pa.array([path] * n, pa.string())], names=[x.split()[0] for x in BATCH_SCHEMA.split(", ")])


class ArticleReader(FolderReader):
    keys = ("article_id",)

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.suffixes = tuple(options.get("suffixes", ",".join(ARTICLE_SUFFIXES)).split(","))

    def partitions(self) -> list[Files]:
        fs, base = open_fs(self.path)
        found = []
        for f in sorted(fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)), key=lambda f: f.path):
            suffix = next((s for s in self.suffixes if f.base_name.endswith(s)), None)
            if f.is_file and suffix:
                found.append((f.path, f.size, (f.base_name.removesuffix(suffix),)))
        if not found and self.strict:
            raise FileNotFoundError(f"no {' or '.join(self.suffixes)} files in {self.path}")
        self.refuse_missing("article_id", {facts[0] for _, _, facts in found})
        return bundles([x for x in found if self.wanted["article_id"].holds(x[2][0])]) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(self.path)
        for path, (article,) in partition.paths:
            text = read_bytes(fs, path).decode("utf-8-sig", errors="replace")
            yield pa.RecordBatch.from_arrays([pa.array([article]), pa.array([text], pa.large_string()).cast(pa.string()), pa.array([path])], names=["article_id", "source", "file_path"])


class TopicBatches(DataSource):
    """topic_<id>/topic_<id>_batch_<n>.csv under `path`; topic_id and batch_id choose folders and files.

    A wanted topic that has no folder, and a folder of no files at all, are errors unless `missing` is `empty`.
    """

    @classmethod
    def name(cls) -> str:
        return "topic_batches"

    def schema(self) -> str:
        return BATCH_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return BatchReader(dict(self.options))


class ArticleFiles(DataSource):
    """Whole TEI files of the folder `path`, named by `suffixes`; article_id chooses files.

    A wanted article without a file, and a folder of no such files, are errors unless `missing` is `empty`.
    """

    @classmethod
    def name(cls) -> str:
        return "article_files"

    def schema(self) -> str:
        return ARTICLE_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArticleReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the formats known to a session, and let filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (TopicBatches, ArticleFiles):
        spark.dataSource.register(source)


def read_topics(spark: SparkSession, root: str, wanted: set[int] | None = None) -> DataFrame:
    """The batches of the topics asked for (see `tables.parse_selection`), all for None; one that is missing is an error."""
    register(spark)
    rows = spark.read.format("topic_batches").load(root)
    return rows if wanted is None else rows.where(F.col("topic_id").isin(*sorted(wanted)))
