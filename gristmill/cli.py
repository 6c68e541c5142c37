"""Command line: clean articles, extract page texts, split topics into batches, label them, build the final rules.

A file that fails does not stop the others; a summary at the end names it, and the exit code is 1.
"""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.blocks import blocks_of
from gristmill.functions.text import normalize_article_id
from gristmill.operators import articles as ar
from gristmill.operators import labelling as lab
from gristmill.operators import tables as ops
from gristmill.sources import connectors, files, folders, storage
from gristmill.sources.ledger import Ledger

TEI = (".grobid.tei.xml", ".tei.xml", ".xml")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gristmill", description=__doc__)
    jobs = top.add_subparsers(dest="job", required=True)

    def job(name: str, help_: str, chosen: bool = True) -> argparse.ArgumentParser:
        p = jobs.add_parser(name, help=help_)
        p.add_argument("--source", required=True, help="folder or file to read")
        p.add_argument("--out", required=True, help="folder to write")
        if chosen:
            which = p.add_mutually_exclusive_group(required=True)
            which.add_argument("--article", help="number or name, for example 2 or article_2")
            which.add_argument("--all", action="store_true", help="every file of the folder")
        return p

    job("articles", "TEI documents to Markdown, blocks and reports")
    pages = job("pages", "page texts and their quality reports")
    pages.add_argument("--reader", required=True, help="module:function that turns a file's bytes into page texts")
    service = job("extract", "TEI documents by an extraction service")
    service.add_argument("--service", required=True, help="module:function that turns a file's bytes into TEI")
    service.add_argument("--workers", type=int, default=1, help="files in work at once")
    batches = job("batches", "clustered rules to one file per batch", chosen=False)
    batches.add_argument("--rows", type=int, default=100, help="rows of a batch at most")
    label = job("label", "contexts of topics and labels of their batches by a chat model", chosen=False)
    label.add_argument("--topics", nargs="+", required=True, help="numbers, ranges like 2-5, outlier, or all")
    label.add_argument("--context-prompt", required=True, help="file of the instructions for a topic's context")
    label.add_argument("--batch-prompt", required=True, help="file of the instructions for a batch")
    label.add_argument("--client", help="module:function(system, schema_name, schema) that gives a client; else the chat service")
    label.add_argument("--samples", type=int, default=10, help="samples that a context is inferred from")
    label.add_argument("--pause", type=float, default=connectors.SLEEP_BETWEEN_REQUESTS_SECONDS, help="seconds between calls of the service")
    job("rules", "label documents to the final rules", chosen=False)
    return top


def loaded(name: str):
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def chosen_path(spark: SparkSession, args: argparse.Namespace, suffixes: tuple[str, ...]) -> str:
    """The file asked for, or a pattern of all; an empty folder is an error."""
    if args.article:
        name = spark.range(1).select(normalize_article_id(F.lit(args.article))).first()[0]
        return files.resolve_file(spark, args.source, name, suffixes)
    if not files.list_files(spark, args.source, suffixes):
        raise FileNotFoundError(f"no {' or '.join(suffixes)} files in {args.source}")
    return f"{args.source}/*"


def summary(outcome: DataFrame, id_col: str) -> int:
    """Print how many files went well and which did not; 1 if any did not."""
    total, failed = 0, 0
    for row in outcome.select(id_col, "error").orderBy(id_col).toLocalIterator():
        total += 1
        if row["error"]:
            failed += 1
            print(f"- {row[id_col]}: {row['error']}")
    print(f"files done: {total - failed}/{total}")
    return int(failed > 0)


def clean_articles(spark: SparkSession, args: argparse.Namespace) -> int:
    docs = files.read_documents(spark, chosen_path(spark, args, TEI))
    blocks = blocks_of(docs, "article_id", "source")
    readable = blocks.where("error is null")
    repeats = ar.discard_repeats(readable, "article_id", ar.choose_abstract(readable, "article_id"))
    return summary(storage.write_articles(ar.articles(blocks, "article_id"), repeats, "article_id", args.out, docs), "article_id")


def page_texts(spark: SparkSession, args: argparse.Namespace) -> int:
    found = connectors.read_pages(spark, chosen_path(spark, args, (".pdf",)), loaded(args.reader))
    storage.write_text_reports(found.where("error is null"), "article_id", "text", args.out)
    return summary(found, "article_id")


def extract_files(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.workers < 1:
        raise ValueError("at least one worker")
    path = chosen_path(spark, args, (".pdf",))
    content = spark.read.format("binaryFile").load(path).select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*\z", "").alias("article_id"), "content")
    made = connectors.extract(content.repartition(args.workers), "article_id", "content", loaded(args.service))
    named = made.where("error is null").select(F.concat("article_id", F.lit(".grobid.tei.xml")).alias("name"), F.col("source").alias("body"))
    storage.finish(storage.write_texts(named, args.out))
    return summary(made, "article_id")


def split_batches(spark: SparkSession, args: argparse.Namespace) -> int:
    columns = ["topic_id", "topic_name", "topic_text"]
    found = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(args.source)
    rows = ops.require_columns(found, columns).withColumn("topic_id", F.col("topic_id").cast("int"))
    numbered = ops.number_in_group(rows.withColumn("_key", F.monotonically_increasing_id()), "topic_id", "_key").drop("_key")
    topic = F.when(F.col("topic_id") == -1, "T_OUTLIER").otherwise(F.format_string("T%03d", "topic_id"))
    made = numbered.withColumns({"numtopic_id": topic, "sample_id": F.concat(topic, F.format_string("_S%04d", "rn")), "batch_id": (F.floor((F.col("rn") - 1) / args.rows) + 1).cast("int")})
    n = storage.write_batch_files(made, args.out, ["sample_id", "topic_name", "topic_text"])
    counts = made.groupBy("topic_id", "numtopic_id", "batch_id").agg(F.min_by("topic_name", "rn").alias("topic_name"), F.count("*").alias("n_samples"))
    sizes = made.groupBy("topic_id").agg(F.max("batch_id").alias("n_batches_for_topic"))
    manifest = counts.join(sizes, "topic_id").withColumns({"folder_path": F.format_string(f"{args.out}/topic_%d", "topic_id"), "file_path": F.concat(F.lit(f"{args.out}/"), storage.batch_name("csv"))})
    order = ["topic_id", "numtopic_id", "topic_name", "batch_id", "n_batches_for_topic", "n_samples", "folder_path", "file_path"]
    storage.write_delimited(manifest.select(*order).orderBy("topic_id", "batch_id"), f"{args.out}/_manifest_topic_batches", sep=",")
    print(f"batch files: {n}")
    return 0


def label_topics(spark: SparkSession, args: argparse.Namespace) -> int:
    """Contexts and labels of the chosen topics, those that are there and valid used again; answers are kept in `_answers`."""
    make = loaded(args.client) if args.client else lambda system, name, schema: connectors.ChatClient(connectors.load_key(), system, name, schema)
    of_topic = make(connectors.load_prompt(args.context_prompt), "topic_context", connectors.CONTEXT_SCHEMA)
    of_batch = make(connectors.load_prompt(args.batch_prompt), "batch_labels", connectors.BATCH_SCHEMA)
    batches = folders.read_topics(spark, args.source, ops.parse_selection(args.topics)).drop("file_path")
    options = {"ledger": Ledger(spark, f"{args.out}/_answers"), "pause": args.pause}
    samples = ops.quota_sample(batches, "topic_id", "batch_id", "sample_id", args.samples)
    contexts = lab.get_contexts(batches, samples, files.read_contexts(spark, args.out), of_topic, **options)
    made = lab.label_batches(batches, contexts, files.read_labelled(spark, args.out), of_batch, **options)
    print(f"topics with a context: {lab.write_contexts(contexts, args.out)}")
    print(f"labelled batches: {lab.write_documents(made, args.out)}")
    return summary(made.select(F.concat_ws("/", "topic_id", "batch_id").alias("batch"), "error"), "batch")


def final_rules(spark: SparkSession, args: argparse.Namespace) -> int:
    rules = files.final_rules(files.label_rows(files.read_label_documents(spark, args.source)))
    rules.write.mode("overwrite").json(args.out)
    print(f"rules: {spark.read.schema(rules.schema).json(args.out).count()}")
    return 0


JOBS = {"articles": clean_articles, "pages": page_texts, "extract": extract_files, "batches": split_batches, "label": label_topics, "rules": final_rules}


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"gristmill-{args.job}").getOrCreate()
    try:
        return JOBS[args.job](spark, args)
    except (OSError, ValueError) as problem:
        print(problem)
        return 1
