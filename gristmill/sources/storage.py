"""Text files of given names on any file system that Arrow knows, written by executors."""

from __future__ import annotations

import contextlib
import csv
import io
import json
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OUTCOME = "name string, written boolean, error string"


_local: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors see: spark.checkpoint.dir, or a local one where Spark is local."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _local.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="gristmill-")
        _local[app] = base
    return f"{base.rstrip('/')}/gristmill/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written in the shared folder and read again: it is made once, and its lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 512):
    """While jobs run inside, Python is handed at most `rows` rows at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
    return fs, path.rstrip("/")


def put(fs: pafs.FileSystem, path: str, body: str | None) -> bool:
    """Write a text whole or not at all; without a text an older file goes. Whether a file is there now."""
    if body is None:
        if fs.get_file_info(path).type == pafs.FileType.File:
            fs.delete_file(path)
        return False
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    temp = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temp, compression=None) as out:
        out.write(body.encode())
    fs.move(temp, path)
    return True


def write_texts(rows: DataFrame, root: str, name: str = "name", body: str = "body") -> DataFrame:
    """Put each row's text under its name in `root`; a null text removes the file of that name.

    One small file a row, by the executors, each under a temporary name first, so a task that is run
    again does no harm. A file that cannot be written is a row with its error, not a failed job.
    Names should be distinct. Returns OUTCOME; the files are there once it has been read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(root)
        for batch in batches:
            done = []
            for n, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    done.append((n, put(fs, f"{base}/{n}", text), None))
                except OSError as problem:
                    done.append((n, False, str(problem)))
            kinds = (pa.string(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], names=["name", "written", "error"])

    return rows.select(F.col(name).cast("string"), F.col(body).cast("string")).mapInArrow(run, OUTCOME)


def finish(outcome: DataFrame) -> int:
    """Have the files written, and how many there are; an error names the first that failed."""
    got = outcome.groupBy().agg(F.count_if("written").alias("n"), F.min(F.when(F.col("error").isNotNull(), F.concat_ws(": ", "name", "error"))).alias("problem")).first()
    if got["problem"]:
        raise OSError(got["problem"])
    return got["n"]


def pretty_json(document: Column) -> Column:
    """A JSON text with an indent of two, characters beyond ASCII kept."""

    def run(values):
        return values.map(lambda v: None if v is None else json.dumps(json.loads(v), ensure_ascii=False, indent=2))

    run.__annotations__ = {}
    return F.pandas_udf(run, "string")(document)


def csv_text(rows: Column, columns: list[str], sep: str = ",") -> Column:
    """A CSV text with a header from a column of arrays of structs; fields are quoted where needed."""
    header = io.StringIO()
    csv.writer(header, delimiter=sep, lineterminator="\n").writerow(columns)
    special = f"[\"\\r\\n{re.escape(sep)}]"

    def field(value: Column) -> Column:
        text = F.coalesce(value.cast("string"), F.lit(""))
        asked = text.rlike(special) | (text == "") if len(columns) == 1 else text.rlike(special)  # a line is not empty
        return F.when(asked, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    lines = F.transform(rows, lambda r: F.concat(*(x for c in columns for x in (F.lit(sep), field(r[c])))).substr(F.lit(len(sep) + 1), F.lit(2**31 - 1)))
    return F.when(rows.isNotNull(), F.concat(F.lit(header.getvalue()), F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")))


# ---------------------------------------------------------------------------- sinks


def write_delimited(rows: DataFrame, path: str, sep: str = ";", bom: bool = False, encoding: str = "UTF-8") -> None:
    """A folder of CSV files with a header each and no index; null is an empty field.

    With `bom` each file begins with the UTF-8 byte order mark.
    """
    first = rows.columns[0]
    shown = rows.withColumnRenamed(first, f"﻿{first}") if bom else rows
    shown.write.mode("overwrite").option("header", True).option("sep", sep).option("escape", '"').option("quote", '"').option("emptyValue", "").option("encoding", encoding).csv(path)


def write_batch_files(batched: DataFrame, root: str, columns: list[str], order: str = "sample_id") -> int:
    """topic_<id>/topic_<id>_batch_<nnn>.csv for each batch of (topic_id, batch_id), with the named columns; how many.

    A batch is bounded by how it was made, so its rows fit one file and one task's memory. The files replace those of
    the last call, all or none (see `filesets.write_file_set`).
    """
    from gristmill.sources.filesets import write_file_set

    grouped = batched.groupBy("topic_id", "batch_id").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_order"), F.struct(*columns).alias("r")))).alias("rows"))
    body = csv_text(F.transform("rows", lambda x: x["r"]), columns)
    return write_file_set(grouped.select(batch_name("csv").alias("name"), body.alias("body")), root, "batches")


def batch_name(suffix: str) -> Column:
    """The path of a batch's file."""
    folder = F.format_string("topic_%d", F.col("topic_id").cast("int"))
    return F.concat(folder, F.lit("/"), folder, F.format_string(f"_batch_%03d.{suffix}", F.col("batch_id").cast("int")))


def write_json_documents(rows: DataFrame, root: str, name: Column, document: Column, into: str = "documents") -> int:
    """A pretty JSON file for each row, all or none, added to those of the set `into`; how many it has then."""
    from gristmill.sources.filesets import write_file_set

    return write_file_set(rows.select(name.alias("name"), pretty_json(document).alias("body")), root, into, replace=False)


def write_json_lines(rows: DataFrame, root: str, name: Column, every: DataFrame | None = None) -> int:
    """A JSON Lines file for each name: its rows in order of `ordinal`, nulls kept; how many there are then.

    `every` lists the names (in `name`) that may have no row now: their older files are removed. All or none is done.
    """
    from gristmill.sources.filesets import write_file_set

    fields = [c for c in rows.columns if c != "ordinal"]
    line = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    lines = rows.select(name.alias("name"), F.struct("ordinal", line.alias("line")).alias("at")).groupBy("name").agg(F.array_sort(F.collect_list("at")).alias("lines"))
    texts = lines.select("name", F.concat(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\n")).alias("body"))
    if every is not None:
        texts = every.select("name").distinct().join(texts, "name", "left")
    return write_file_set(texts, root, "lines", replace=False)


def write_articles(articles: DataFrame, blocks: DataFrame, id_col: str, root: str, sources: DataFrame | None = None) -> DataFrame:
    """The files of cleaned articles under `root`: Markdown, supplementary Markdown, report, discarded and
    review blocks; what an article no longer has is removed. Returns id, files, error.

    `articles` is the outcome of `operators.articles.articles`, `blocks` that of `discard_repeats`; `sources` may
    name the file (id, file_path) that each was read from, for the reports. A
    document with an error has no files written and keeps its error.
    """
    from gristmill.operators.articles import report_json

    name = F.col(id_col).cast("string")
    good = articles.where("error is null")
    if sources is None:
        good = good.withColumn("_source", F.lit(None).cast("string"))
    else:
        good = good.join(sources.select(id_col, F.col("file_path").alias("_source")), id_col, "left")
    text = lambda folder, suffix, body: good.select(F.concat(F.lit(f"{folder}/"), name, F.lit(suffix)).alias("name"), body.alias("body"))
    path = lambda folder: F.concat(F.lit(f"{root}/{folder}/"), name, F.lit(".md"))
    end = F.lit("\n")
    texts = text("cleaned_markdown", ".md", F.concat("markdown", end))
    texts = texts.unionByName(text("supplementary_markdown", ".md", F.concat("supplementary_markdown", end)))
    texts = texts.unionByName(text("cleaning_reports", ".json", F.concat(pretty_json(report_json(good, F.col("_source"), path("cleaned_markdown"), path("supplementary_markdown"))), end)))
    fields = ("kind", "text", "category", "reason", "level", "section_path", "source_tag", "source_type", "coords", "warnings")
    line = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    kept = F.col("category") != "discard"
    picked = {"discarded_blocks": ~kept, "review_blocks": kept & (F.size("warnings") > 0)}
    ids = good.select(name.alias("_id"))
    for folder, test in picked.items():
        own = blocks.where(test).select(name.alias("_id"), F.struct("ordinal", line.alias("line")).alias("at")).groupBy("_id").agg(F.array_sort(F.collect_list("at")).alias("lines"))
        joined = ids.join(own, "_id", "left")
        texts = texts.unionByName(joined.select(F.concat(F.lit(f"{folder}/"), "_id", F.lit(".jsonl")).alias("name"), F.concat(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), end).alias("body")))
    outcome = write_texts(texts, root)
    stem = F.regexp_replace(F.element_at(F.split("name", "/"), -1), r"\.(md|jsonl?)\z", "")
    by_id = outcome.groupBy(stem.alias("_id")).agg(F.count_if("written").alias("files"), F.min("error").alias("write_error"))
    return articles.select(name.alias(id_col), name.alias("_id"), "error").join(by_id, "_id", "left").select(id_col, F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("error", "write_error").alias("error"))


def write_text_reports(texts: DataFrame, id_col: str, text_col: str, root: str) -> int:
    """texts/<id>.txt and reports/<id>_report.json for each extracted text."""
    from gristmill.functions.text import pdf_quality

    name = F.col(id_col).cast("string")
    quality = F.to_json(F.struct(*(c.alias(n) for n, c in pdf_quality(F.col(text_col)).items())))
    plain = texts.select(F.concat(F.lit("texts/"), name, F.lit(".txt")).alias("name"), F.col(text_col).alias("body"))
    reports = texts.select(F.concat(F.lit("reports/"), name, F.lit("_report.json")).alias("name"), pretty_json(quality).alias("body"))
    return finish(write_texts(plain.unionByName(reports), root))


def reuse(spark: SparkSession, inputs: DataFrame, done: DataFrame, key: list[str], valid: Column) -> tuple[DataFrame, DataFrame]:
    """Stored results that are still valid, and the inputs that have none: what remains to be made."""
    good = done.where(F.coalesce(valid, F.lit(False)))
    return good, inputs.join(good.select(*key).distinct(), key, "left_anti")
