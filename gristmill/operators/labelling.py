"""Model labelling: prompts, validation of contexts and labels, coverage, runs, merged results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.sources import connectors
from gristmill.sources.connectors import RELEVANCE
from gristmill.sources.ledger import ask_once
from gristmill.sources.storage import batch_name, write_json_documents

CONTEXT = "topic_id int, llm_topic_name string, topic_summary string, green_category string, global_green_relevance string"
ROW = "sample_id string, if_then_rule string, green_relevance string, keep_for_rag boolean"
#: The fields of a flat labelled row, in the order of the published files.
FLAT = ("sample_id", "llm_topic_name", "green_category", "global_green_relevance", "if_then_rule", "green_relevance", "keep_for_rag")
CONTEXT_FIELDS = ("llm_topic_name", "topic_summary", "green_category", "global_green_relevance")


def _samples() -> Column:
    """Numbered samples of a collected array `rows` of (pos, sample_id, topic_name, topic_text)."""
    one = lambda r, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]\nsample_id: "), r["sample_id"], F.lit("\ntopic_name: "), r["topic_name"], F.lit("\ntopic_text: "), r["topic_text"], F.lit("\n"))
    return F.array_join(F.transform("rows", one), "\n")


def _collected(samples: DataFrame, keys: list[str]) -> DataFrame:
    columns = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("sample_id", "topic_name", "topic_text")]
    return samples.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("rows"))


# ---- fixed values: the lines of the requests, as the model is to read them ----------------

TOPIC_LINES = ("Topic id: ", "Automatic BERTopic topic name: ", "Number of representative samples: ", "Representative samples:", "Infer the topic-level context for this BERTopic cluster.")
BATCH_LINES = ("Input file: ", "Topic id: ", "Fixed topic-level context:", "Number of samples in this batch: ", "Samples:", "Return one output row for each sample_id.", "Preserve every sample_id exactly.")


def topic_prompts(samples: DataFrame) -> DataFrame:
    """topic_id, prompt: the request for a topic's context, from its samples."""
    topic, name, n, title, ask = TOPIC_LINES
    lines = (F.concat(F.lit(topic), F.col("topic_id").cast("string")), F.concat(F.lit(name), F.element_at("rows", 1)["topic_name"]), F.concat(F.lit(n), F.size("rows").cast("string")), F.lit(""), F.lit(title), F.lit(""), _samples(), F.lit(ask))
    return _collected(samples, ["topic_id"]).select("topic_id", F.array_join(F.array(*lines), "\n").alias("prompt"))


def batch_prompts(samples: DataFrame, contexts: DataFrame) -> DataFrame:
    """topic_id, batch_id, prompt: the request to label a batch under its topic's context."""
    file, topic, fixed, n, title, *asks = BATCH_LINES
    rows = _collected(samples, ["topic_id", "batch_id"]).join(contexts.select("topic_id", *CONTEXT_FIELDS), "topic_id")
    facts = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c), F.lit(""))) for c in CONTEXT_FIELDS]
    lines = (F.concat(F.lit(file), batch_name("csv")), F.concat(F.lit(topic), F.col("topic_id").cast("string")), F.lit(""), F.lit(fixed), *facts, F.lit(""), F.concat(F.lit(n), F.size("rows").cast("string")), F.lit(""), F.lit(title), F.lit(""), _samples(), *map(F.lit, asks))
    return rows.select("topic_id", "batch_id", F.array_join(F.array(*lines), "\n").alias("prompt"))


def context_verdict(expected_topic: Column) -> Column:
    """Why a context cannot be used, else null."""
    verdict = F.lit(None).cast("string")
    rules = [(F.col("topic_id").isNull() | (F.col("topic_id") != expected_topic), "topic_id")]
    rules += [(F.coalesce(F.trim(c), F.lit("")) == "", f"missing_{c}") for c in CONTEXT_FIELDS]
    rules += [(~F.col("green_category").rlike(r"\A[a-z][a-z0-9_]*\z"), "not_snake_case"), (~F.col("global_green_relevance").isin(*RELEVANCE), "relevance")]
    for test, why in reversed(rules):
        verdict = F.when(test, why).otherwise(verdict)
    return verdict


def label_problems(inputs: DataFrame, labels: DataFrame, key: str = "sample_id") -> DataFrame:
    """key, problem: inputs without a label, labels without an input, repeated labels, bad values."""
    known, given = inputs.select(key).distinct(), labels.select(key).distinct()
    flag = F.lower("keep_for_rag").isin("true", "false") if dict(labels.dtypes)["keep_for_rag"] == "string" else F.col("keep_for_rag").isNotNull()
    parts = [
        known.join(given, key, "left_anti").select(key, F.lit("missing").alias("problem")),
        given.join(known, key, "left_anti").select(key, F.lit("extra").alias("problem")),
        labels.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key, F.lit("repeated").alias("problem")),
        labels.where(~F.coalesce(F.col("green_relevance").isin(*RELEVANCE), F.lit(False))).select(key, F.lit("relevance").alias("problem")),
        labels.where(~F.coalesce(flag, F.lit(False))).select(key, F.lit("keep_for_rag").alias("problem")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def attach_context(labels: DataFrame, contexts: DataFrame) -> DataFrame:
    """Labels with the name, category and relevance of their topic's context."""
    return labels.join(contexts.select("topic_id", "llm_topic_name", "green_category", "global_green_relevance"), "topic_id")


# --------------------------------------------------------------------------------- runs


def non_empty(groups: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The groups that have a row; none at all is an error."""
    found = groups.join(rows.select(key).distinct(), key, "left_semi")
    if found.isEmpty():
        raise ValueError(f"no {key} has any row")
    return found


def get_contexts(topics: DataFrame, samples: DataFrame, stored: DataFrame, client: Callable[[str], str], **options) -> DataFrame:
    """CONTEXT, error: for every topic its stored context, if that is valid, else one made now.

    `topics` has topic_id, `samples` the representative samples, `stored` contexts by topic_id. A topic
    whose context cannot be made or is not valid has its error. Answers are kept in the `ledger` among the
    options, and taken from it.
    """
    names = [x.split()[0] for x in CONTEXT.split(", ")]
    kept = stored.withColumn("_why", context_verdict(F.col("topic_id"))).where("_why is null").select(*names)
    missing = topics.select("topic_id").distinct().join(kept.select("topic_id"), "topic_id", "left_anti")
    prompts = topic_prompts(samples.join(missing, "topic_id", "left_semi"))
    made = ask_once(prompts, "topic_id", "prompt", client, connectors.CONTEXT_SCHEMA, **options).withColumn("c", F.from_json("response", CONTEXT))
    flat = made.select(F.col("topic_id").alias("_topic"), "error", "c.*").withColumn("_why", context_verdict(F.col("_topic")))
    judged = flat.withColumn("error", F.coalesce("error", "_why")).withColumn("topic_id", F.col("_topic").cast("int"))
    return kept.withColumn("error", F.lit(None).cast("string")).unionByName(judged.select(*names, "error"))


def document_verdict(batches: DataFrame, documents: DataFrame) -> DataFrame:
    """topic_id, batch_id, verdict: why a batch's labels cannot be used, null where they can.

    Every sample of the batch must be labelled once, none else, with known values; the context
    must be there.
    """
    keys = ["topic_id", "batch_id"]
    wanted = batches.groupBy(*keys).agg(F.collect_set("sample_id").alias("wanted"))  # a batch's rows
    both = documents.join(wanted, keys, "left")
    ids = F.transform("rows", lambda r: r["sample_id"])
    good = lambda r: F.coalesce(r["green_relevance"].isin(*RELEVANCE) & r["keep_for_rag"].isNotNull() & r["if_then_rule"].isNotNull(), F.lit(False))
    rules = (
        (F.col("topic_context").isNull() | F.col("topic_context.llm_topic_name").isNull(), F.lit("no topic_context")),
        (F.col("rows").isNull(), F.lit("no rows")),
        (F.size(F.array_except("wanted", ids)) > 0, F.concat(F.lit("missing: "), F.array_join(F.slice(F.array_sort(F.array_except("wanted", ids)), 1, 10), ","))),
        (F.size(F.array_except(ids, F.col("wanted"))) > 0, F.concat(F.lit("unknown: "), F.array_join(F.slice(F.array_sort(F.array_except(ids, F.col("wanted"))), 1, 10), ","))),
        (F.size(F.array_distinct(ids)) < F.size(ids), F.lit("repeated sample_id")),
        (F.exists("rows", lambda r: ~good(r)), F.lit("bad label")),
    )
    why = F.lit(None).cast("string")
    for test, text in reversed(rules):
        why = F.when(test, text).otherwise(why)
    return both.select(*keys, why.alias("verdict"))


def label_batches(batches: DataFrame, contexts: DataFrame, stored: DataFrame, client: Callable[[str], str], **options) -> DataFrame:
    """topic_id, batch_id, topic_context, rows, error, reused: every batch's labels.

    A batch's samples must have distinct ids, else the job fails and names some. Stored documents
    that are valid are used again; for the others the model is asked under the topic's context, and
    its answer is held against the schema and the batch. What fails is a row with its error. Answers are
    kept in the `ledger` among the options: a run that is killed and started again asks only what was not answered.
    """
    keys = ["topic_id", "batch_id"]
    repeated = batches.groupBy(*keys, "sample_id").count().where("count > 1").select("sample_id").limit(10).collect()  # ten at most
    if repeated:
        raise ValueError(f"repeated sample_id: {', '.join(sorted(str(r[0]) for r in repeated))}")
    old = stored.select(*keys, "topic_context", "rows")
    fine = old.join(document_verdict(batches, old).where("verdict is null").select(*keys), keys, "left_semi").join(batches.select(*keys).distinct(), keys, "left_semi")
    todo = batches.join(fine.select(*keys), keys, "left_anti")
    usable = contexts.where("error is null") if "error" in contexts.columns else contexts
    prompts = batch_prompts(todo, usable).withColumn("_key", F.concat_ws("/", *keys))
    asked = ask_once(prompts, "_key", "prompt", client, connectors.BATCH_SCHEMA, **options).drop("reused")
    parsed = asked.withColumn("rows", F.from_json("response", f"rows array<struct<{ROW.replace(' string', ': string').replace(' boolean', ': boolean')}>>")["rows"])
    context = F.struct("topic_id", *CONTEXT_FIELDS).cast("struct<topic_id: int, llm_topic_name: string, topic_summary: string, green_category: string, global_green_relevance: string>")
    known = usable.select(F.col("topic_id").alias("_t"), context.alias("topic_context"))
    every = todo.select(*keys).distinct().withColumn("_key", F.concat_ws("/", *keys)).join(parsed, "_key", "left").join(known, F.col("topic_id") == F.col("_t"), "left").drop("_t")
    made = every.select(*keys, "topic_context", "rows", F.when(F.col("topic_context").isNull(), "no context").otherwise(F.col("error")).alias("error"))
    judged = made.join(document_verdict(batches, made), keys).withColumn("error", F.coalesce("error", "verdict")).drop("verdict")
    fresh = judged.withColumns({"rows": F.when(F.col("error").isNull(), F.col("rows")), "reused": F.lit(False)})
    return fine.withColumns({"error": F.lit(None).cast("string"), "reused": F.lit(True)}).unionByName(fresh)


def flat_labels(documents: DataFrame) -> DataFrame:
    """The labelled rows with their topic's context, one per sample, the first document first."""
    rows = documents.where("rows is not null").select("topic_id", "batch_id", "topic_context", F.posexplode("rows").alias("pos", "r"))
    shaped = rows.select("topic_id", "batch_id", "pos", "r.*", "topic_context.llm_topic_name", "topic_context.green_category", "topic_context.global_green_relevance")
    order = F.struct(F.col("topic_id").cast("string"), F.col("batch_id"), "pos")
    return shaped.groupBy("sample_id").agg(F.min_by(F.struct(*FLAT[1:]), order).alias("v")).select("sample_id", "v.*").select(*FLAT)


def write_documents(documents: DataFrame, root: str) -> int:
    """topic_<id>/topic_<id>_batch_<nnn>.json for every batch without an error."""
    good = documents.where("error is null")
    return write_json_documents(good, root, batch_name("json"), F.to_json(F.struct("topic_context", "rows"), {"ignoreNullFields": "false"}), "labels")


def write_contexts(contexts: DataFrame, root: str) -> int:
    """topic_<id>/topic_<id>_context.json for every topic without an error."""
    folder = F.format_string("topic_%d", F.col("topic_id"))
    return write_json_documents(contexts.where("error is null"), root, F.concat(folder, F.lit("/"), folder, F.lit("_context.json")), F.to_json(F.struct("topic_id", *CONTEXT_FIELDS)), "contexts")
