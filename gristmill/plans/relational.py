"""Queries of lookups, scopes, counts, batches, samples and validation, with their DuckDB SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import schemas
from gristmill.functions import text as tx
from gristmill.functions.blocks import element_counts
from gristmill.operators import labelling as lab
from gristmill.operators import tables as ops
from gristmill.sources import files, folders, ledger, storage
from gristmill.sources.connectors import BATCH_SCHEMA, strict_object

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """A scan of fewer splits than there are cores is dealt to all cores; one of more is left where it is.

    Only a table that is small for the cluster has so few splits, so what moves is small too.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows._jdf.queryExecution().toRdd().getNumPartitions() < cores else rows


CLASS_OF_REGION = {"ASIA": "smart_home", "EUROPE": "context", "AFRICA": "unknown"}
CLASS_SQL = "CASE r_name WHEN 'ASIA' THEN 'smart_home' WHEN 'EUROPE' THEN 'context' WHEN 'AFRICA' THEN 'unknown' ELSE 'general_digital' END"
DIM_SQL = f"dim AS (SELECT n_nationkey, n_name, {CLASS_SQL} AS class FROM nation JOIN region ON n_regionkey = r_regionkey)"
EDGES_SQL = f"""WITH {DIM_SQL}, edges AS (
  SELECT a.class AS trigger_class, b.class AS action_class
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  LEFT JOIN dim a ON c_nationkey = a.n_nationkey LEFT JOIN dim b ON s_nationkey = b.n_nationkey),
scoped AS (SELECT *, CASE WHEN trigger_class = 'smart_home' AND action_class = 'smart_home' THEN 'core_smart_home'
  WHEN (trigger_class = 'smart_home' AND action_class = 'context') OR (trigger_class = 'context' AND action_class = 'smart_home') THEN 'context_aware_smart_home'
  WHEN trigger_class = 'smart_home' OR action_class = 'smart_home' THEN 'smart_home_related'
  WHEN trigger_class = 'unknown' OR action_class = 'unknown' THEN 'review' ELSE 'out_of_scope' END AS scope FROM edges)"""


def dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return named.select("n_nationkey", "n_name", ops.lookup(CLASS_OF_REGION, F.col("r_name"), F.lit("general_digital")).alias("class"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    joined = items.join(orders, items.l_orderkey == orders.o_orderkey).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    counted = joined.groupBy("c_nationkey", "s_nationkey").agg(F.count("*").alias("n"))  # at most nations x nations
    dim = dimension(spark, sf_dir)
    return ops.two_sided(counted, dim, "n_nationkey", "class", "c_nationkey", "s_nationkey", "trigger_class", "action_class")


def scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).withColumn("scope", ops.rule_scope(F.col("trigger_class"), F.col("action_class")))


@query("SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND n_chars >= 200")
def scan_filter_documents(spark, d):
    return table(spark, d, "documents").where("lang = 'en' and n_chars >= 200").select("doc_id", "source", "n_chars")


@query(f"{EDGES_SQL} SELECT trigger_class, action_class, count(*) AS n FROM edges GROUP BY ALL")
def two_sided_class_join(spark, d):
    return edges(spark, d).groupBy("trigger_class", "action_class").agg(F.sum("n").alias("n"))


@query(f"{EDGES_SQL} SELECT scope, count(*) AS n FROM scoped GROUP BY ALL")
def rule_scope(spark, d):
    return scoped(spark, d).groupBy("scope").agg(F.sum("n").alias("n"))


@query(f"""{EDGES_SQL} SELECT CASE WHEN scope = 'review' THEN 'review' ELSE 'candidate' END AS part, scope, count(*) AS n
FROM scoped WHERE scope IN ('core_smart_home', 'context_aware_smart_home', 'smart_home_related', 'review') GROUP BY ALL""")
def scope_filter(spark, d):
    kept = scoped(spark, d).where(F.col("scope").isin("core_smart_home", "context_aware_smart_home", "smart_home_related", "review"))
    part = F.when(F.col("scope") == "review", "review").otherwise("candidate")
    return kept.groupBy(part.alias("part"), "scope").agg(F.sum("n").alias("n"))


NAMES_SQL = "names AS (SELECT n_name AS channel_name FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def channel_counts(spark, d) -> DataFrame:
    keys = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).unionByName(table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))
    nation = table(spark, d, "nation")
    return keys.groupBy("k").agg(F.count("*").alias("n")).join(nation, F.col("k") == F.col("n_nationkey")).where("n_name <> ''").groupBy(F.col("n_name").alias("channel_name")).agg(F.sum("n").alias("frequency"))


@query(f"WITH {NAMES_SQL} SELECT channel_name, count(*) AS frequency FROM names GROUP BY ALL")
def channel_frequency(spark, d):
    return channel_counts(spark, d)


@query(f"""WITH {NAMES_SQL} SELECT CASE WHEN channel_name LIKE 'UNITED%' THEN 'UNITED' ELSE channel_name END AS channel_name, CAST(count(*) AS BIGINT) AS frequency
FROM names GROUP BY 1""")
def merge_sum_desc(spark, d):
    name = F.when(F.col("channel_name").startswith("UNITED"), "UNITED").otherwise(F.col("channel_name"))
    return channel_counts(spark, d).groupBy(name.alias("channel_name")).agg(F.sum("frequency").alias("frequency")).orderBy(F.desc("frequency"), "channel_name")


@query(f"WITH {NAMES_SQL} SELECT channel_name, count(*) AS frequency FROM names GROUP BY ALL ORDER BY frequency DESC, channel_name LIMIT 10")
def top_channels(spark, d):
    return channel_counts(spark, d).orderBy(F.desc("frequency"), "channel_name").limit(10)


@query("SELECT DISTINCT event_type FROM events ORDER BY event_type")
def distinct_sorted(spark, d):
    return table(spark, d, "events").select("event_type").distinct().orderBy("event_type")


SOURCE_CLASSES = (("src0", "smart_home"), ("src0", "context"), ("src1", "context"), ("src2", "unknown"), ("src2", "smart_home"), ("src3", "general_digital"))


@query("""WITH m AS (SELECT * FROM (VALUES ('src0', 'smart_home'), ('src1', 'context'), ('src2', 'unknown'), ('src3', 'general_digital')) t(source, class))
SELECT class, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents LEFT JOIN m USING (source) GROUP BY ALL""")
def lookup_dedup_join(spark, d):
    given = spark.createDataFrame([(i, *r) for i, r in enumerate(SOURCE_CLASSES)], "ordinal int, source string, class string")
    dim = ops.keep_first(given, ["source"], ["ordinal"]).select("source", "class")
    return table(spark, d, "documents").join(dim, "source", "left").groupBy("class").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("""SELECT doc_id, CASE source WHEN 'src1' THEN 'context' WHEN 'src4' THEN 'smart_home' ELSE CASE WHEN lang = 'en' THEN 'general_digital' ELSE 'unknown' END END AS class FROM documents""")
def class_override(spark, d):
    given = F.when(F.col("lang") == "en", "general_digital").otherwise("unknown")
    return table(spark, d, "documents").select("doc_id", ops.lookup({"src1": "context", "src4": "smart_home"}, F.col("source"), given).alias("class"))


PRIORITY = {"1-URGENT": "0", "2-HIGH": "1", "3-MEDIUM": "2"}


@query("SELECT o_orderkey, o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 99 END AS priority FROM orders")
def priority_sort(spark, d):
    rank = ops.lookup(PRIORITY, F.col("o_orderpriority"), F.lit("99")).cast("int")
    return table(spark, d, "orders").select("o_orderkey", "o_orderpriority", rank.alias("priority")).orderBy("priority", "o_orderpriority", "o_orderkey")


def labelled(spark, d) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")


@query("SELECT quality, toxic, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def value_distribution(spark, d):
    return labelled(spark, d).groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query("""WITH j AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id))
SELECT 'lang' AS column_name, count(*) FILTER (lang IS NULL) AS missing FROM j UNION ALL SELECT 'quality', count(*) FILTER (quality IS NULL) FROM j
UNION ALL SELECT 'toxic', count(*) FILTER (toxic IS NULL) FROM j""")
def missing_counts(spark, d):
    names = ("lang", "quality", "toxic")
    counts = labelled(spark, d).agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in names))
    return counts.select(F.expr(f"stack({len(names)}, {', '.join(f"'{c}', {c}" for c in names)}) as (column_name, missing)"))


@query("SELECT event_id, event_type FROM events WHERE NOT coalesce(regexp_matches(event_type, '(?i)CLICK'), false)")
def not_contains_filter(spark, d):
    return table(spark, d, "events").where(~F.coalesce(F.col("event_type").rlike("(?i)CLICK"), F.lit(False))).select("event_id", "event_type")


@query(f"""SELECT conv_id, turn, regexp_replace(coalesce(role, ''), '\\A{tx.WS}+|{tx.WS}+\\z', '', 'g') AS role, md5(regexp_replace(coalesce(text, ''), '\\A{tx.WS}+|{tx.WS}+\\z', '', 'g')) AS text_md5 FROM conversations""")
def clean_text_columns(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", tx.clean(F.col("role")).alias("role"), F.md5(tx.clean(F.col("text"))).alias("text_md5"))


@query("""SELECT doc_id, source, printf('%s_S%04d', source, row_number() OVER (PARTITION BY source ORDER BY doc_id)) AS sample_id,
CASE WHEN lang = 'en' THEN 'T_OUTLIER' ELSE printf('T%03d', length(lang)) END AS topic_code FROM documents""")
def sample_ids(spark, d):
    rows = ops.number_in_group(table(spark, d, "documents").select("doc_id", "source", "lang"), "source", "doc_id")
    topic = F.when(F.col("lang") == "en", -1).otherwise(F.length("lang"))
    return rows.select("doc_id", "source", F.format_string("%s_S%04d", "source", "rn").alias("sample_id"), ops.topic_code(topic).alias("topic_code"))


@query("""SELECT o_orderkey, o_orderpriority, row_number() OVER w AS rn, (row_number() OVER w - 1) // 100 + 1 AS batch_id FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey)""")
def batch_assign(spark, d):
    return ops.assign_batches(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey")


@query("""WITH b AS (SELECT o_orderpriority, o_orderkey, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) // 100 + 1 AS batch_id FROM orders)
SELECT o_orderpriority, batch_id, count(*) AS n_samples, min(o_orderkey) AS first_key, max(batch_id) OVER (PARTITION BY o_orderpriority) AS n_batches FROM b GROUP BY o_orderpriority, batch_id""")
def batch_manifest(spark, d):
    return ops.manifest(batch_assign(spark, d), "o_orderpriority", "o_orderkey")


STRIPPED = f"regexp_replace(text, '\\A{tx.WS}+|{tx.WS}+\\z', '', 'g')"


@query(f"SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY md5({STRIPPED})")
def dedupe_keep_first(spark, d):
    key = F.md5(tx.strip(F.col("text")))
    return table(spark, d, "documents").groupBy(key.alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("k")


@query(f"SELECT md5({STRIPPED}) AS text_key, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return table(spark, d, "documents").groupBy(F.md5(tx.strip(F.col("text"))).alias("text_key")).agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT doc_id, source FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 20")
def hash_sample(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").orderBy(ops.hash_rank(42, F.col("doc_id")), "doc_id").limit(20)


@query("""WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5('42:' || doc_id), doc_id) AS rk FROM documents),
p AS (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY source) AS pos, count(*) OVER (PARTITION BY lang) AS parts FROM (SELECT DISTINCT lang, source FROM documents)),
f AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang ORDER BY rk > 30 // parts + CASE WHEN pos <= 30 % parts THEN 1 ELSE 0 END, rk, source) AS fill FROM r JOIN p USING (lang, source) WHERE rk <= 30)
SELECT doc_id, lang, source FROM f WHERE fill <= 30""")
def quota_sample(spark, d):
    return ops.quota_sample(table(spark, d, "documents").select("doc_id", "lang", "source"), "lang", "source", "doc_id", n=30)


@query("SELECT r_name, string_agg(n_name, ',' ORDER BY n_nationkey) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def ordered_collect(spark, d):
    joined = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    listed = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    return joined.groupBy("r_name").agg(F.array_join(F.transform(listed, lambda x: x["n_name"]), ",").alias("nations"))


@query("SELECT doc_id, left(text, 300) AS preview, length(text) AS chars FROM documents")
def doc_preview(spark, d):
    return table(spark, d, "documents").select("doc_id", F.left("text", F.lit(300)).alias("preview"), F.length("text").cast("long").alias("chars"))


@query("SELECT doc_id, source, quality, toxic, quality IS NULL AS unmatched FROM documents LEFT JOIN labels USING (doc_id)")
def one_to_one_left_join(spark, d):
    joined = ops.one_to_one_left(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id")
    return joined.select("doc_id", "source", "quality", "toxic", F.col("quality").isNull().alias("unmatched"))


@query("""SELECT 'missing' AS side, doc_id FROM documents ANTI JOIN labels USING (doc_id) UNION ALL SELECT 'extra', doc_id FROM labels ANTI JOIN (SELECT doc_id FROM documents WHERE lang = 'en') USING (doc_id)""")
def label_coverage_anti(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").select("doc_id")
    missing = docs.select("doc_id").join(labels, "doc_id", "left_anti").select(F.lit("missing").alias("side"), "doc_id")
    extra = labels.join(docs.where("lang = 'en'").select("doc_id"), "doc_id", "left_anti").select(F.lit("extra").alias("side"), "doc_id")
    return missing.unionByName(extra)


@query("""SELECT conv_id, turn, array_to_string(list_sort(list_concat(CASE WHEN role = 'user' THEN ['$.rows[1].green_relevance: "user" is not allowed'] ELSE [] END, CASE WHEN turn % 3 = 0 THEN ['$.rows[1].keep_for_rag: missing'] ELSE [] END,
CASE WHEN turn % 3 = 1 THEN ['$.rows[1].keep_for_rag: not boolean'] ELSE [] END, CASE WHEN text IS NULL THEN ['$.rows[1].if_then_rule: not string'] ELSE [] END, CASE WHEN conv_id % 4 = 0 THEN ['$.rows[0].note: unknown'] ELSE [] END)), '; ') AS problems FROM conversations""")
def validate_rows(spark, d):
    """Turns as answers of a model, in JSON with various faults, against the strict schema of a batch."""
    first = F.struct(F.lit("s").alias("sample_id"), F.lit("r").alias("if_then_rule"), F.lit("low").alias("green_relevance"), F.lit(True).alias("keep_for_rag"), F.when(F.col("conv_id") % 4 == 0, "n").alias("note"))
    level = F.when(F.col("role") == "user", "user").otherwise("high")
    keep = F.when(F.col("turn") % 3 == 1, ',"keep_for_rag":1').when(F.col("turn") % 3 == 2, ',"keep_for_rag":true').otherwise("")
    listed = F.to_json(F.array("text"))
    rule = F.substr(listed, F.lit(2), F.length(listed) - 2)
    second = F.concat(F.lit('{"sample_id":"t","green_relevance":"'), level, F.lit('","if_then_rule":'), rule, keep, F.lit("}"))
    answer = F.concat(F.lit('{"rows":['), F.to_json(first), F.lit(","), second, F.lit("]}"))
    found = schemas.violations(answer, BATCH_SCHEMA)
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(found), "; ").alias("problems"))


@query("""WITH i AS (SELECT doc_id FROM documents WHERE lang = 'en'), l AS (SELECT doc_id, CASE quality WHEN 1 THEN 'high' ELSE 'None' END AS rel, CASE WHEN toxic = 0 THEN true END AS keep FROM labels)
SELECT doc_id, 'missing' AS problem FROM i ANTI JOIN l USING (doc_id) UNION ALL SELECT doc_id, 'extra' FROM l ANTI JOIN i USING (doc_id) UNION ALL SELECT doc_id, 'relevance' FROM l WHERE rel NOT IN ('high', 'medium', 'low', 'none')
UNION ALL SELECT doc_id, 'keep_for_rag' FROM l WHERE keep IS NULL UNION ALL SELECT doc_id, 'repeated' FROM l GROUP BY doc_id HAVING count(*) > 1""")
def label_problems(spark, d):
    labels = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "high").otherwise("None").alias("green_relevance"), F.when(F.col("toxic") == 0, True).alias("keep_for_rag"))
    return lab.label_problems(table(spark, d, "documents").where("lang = 'en'").select("doc_id"), labels, "doc_id")


@query("SELECT n_nationkey FROM nation SEMI JOIN supplier ON s_nationkey = n_nationkey")
def non_empty_groups(spark, d):
    rows = table(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"))
    return lab.non_empty(table(spark, d, "nation").select("n_nationkey"), rows, "n_nationkey")


@query("SELECT doc_id::VARCHAR AS doc_id, lang, md5(text) AS text_md5 FROM documents")
def csv_round_trip(spark, d):
    """The documents as a semicolon-separated latin-1 file of a BOM-less kind, read again."""
    path = storage.scratch(spark, "csv")
    storage.write_delimited(table(spark, d, "documents").select("doc_id", "lang", "text"), path, encoding="ISO-8859-1")
    back = files.read_delimited(spark, path, ["doc_id", "lang", "text"], encoding="ISO-8859-1")
    return back.select("doc_id", "lang", F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_md5"))


BATCHED_SQL = "b AS (SELECT *, ((rn - 1) // 100 + 1)::INT AS batch_id FROM (SELECT conv_id % 5 - 1 AS topic_id, conv_id || '/' || turn AS sample_id, role, text, row_number() OVER (PARTITION BY conv_id % 5 ORDER BY conv_id * 1000 + turn) AS rn FROM conversations))"


def batched_turns(spark, d):
    rows = table(spark, d, "conversations").select((F.col("conv_id") % 5 - 1).cast("int").alias("topic_id"), F.concat_ws("/", "conv_id", "turn").alias("sample_id"), F.col("role").alias("topic_name"), F.col("text").alias("topic_text"), (F.col("conv_id") * 1000 + F.col("turn")).alias("k"))
    return ops.assign_batches(rows, "topic_id", "k", 100)


@query(f"WITH {BATCHED_SQL} SELECT topic_id::INT AS topic_id, batch_id, sample_id, role AS topic_name, md5(text) AS text_md5 FROM b")
def batch_files_round_trip(spark, d):
    """One comma-separated file per batch in a folder per topic, read again by their names."""
    path = storage.scratch(spark, "batches")
    storage.write_batch_files(batched_turns(spark, d), path, ["sample_id", "topic_name", "topic_text"])
    return files.read_batches(spark, path).select("topic_id", "batch_id", "sample_id", "topic_name", F.md5(F.coalesce("topic_text", F.lit(""))).alias("text_md5"))


@query(f"WITH {BATCHED_SQL} SELECT topic_id::INT AS topic_id, batch_id, sample_id, md5(text) AS text_md5 FROM b WHERE topic_id IN (-1, 2, 3)")
def topic_files_selected(spark, d):
    """Batch files again, but only the folders of the topics asked for are listed and read."""
    path = storage.scratch(spark, "batches")
    storage.write_batch_files(batched_turns(spark, d), path, ["sample_id", "topic_name", "topic_text"])
    return folders.read_topics(spark, path, ops.parse_selection(["outlier", "2-3"])).select("topic_id", "batch_id", "sample_id", F.md5(F.coalesce("topic_text", F.lit(""))).alias("text_md5"))


@query("SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations")
def json_lines_round_trip(spark, d):
    """A JSON Lines file for each conversation, its turns in order, read again."""
    path = storage.scratch(spark, "lines")
    rows = table(spark, d, "conversations").select("conv_id", "role", "text", F.col("turn").alias("ordinal"), "turn")
    storage.write_json_lines(rows, path, F.format_string("conv_%d.jsonl", "conv_id"))
    back = spark.read.schema("conv_id long, turn long, role string, text string").json(f"{path}/*.jsonl")
    return back.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query("""SELECT conv_id, count(*) AS n_p, count(*) AS n_s, count(*) FILTER (role = 'user') AS n_note, 1::BIGINT AS n_figure, count(*) FILTER (turn % 2 = 0) AS n_coords FROM conversations GROUP BY conv_id""")
def xml_element_counts(spark, d):
    """Conversations as TEI documents, and the counts of their elements."""
    body = F.coalesce(F.col("text"), F.lit(""))
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), (r"[\x00-\x08\x0B\x0C\x0E-\x1F]", " ")):
        body = F.regexp_replace(body, mark, entity)
    paragraph = F.concat(F.when(F.col("turn") % 2 == 0, '<p coords="1"><s>').otherwise("<p><s>"), body, F.lit("</s></p>"))
    one = F.when(F.col("role") == "user", F.concat(F.lit("<note>"), paragraph, F.lit("</note>"))).otherwise(paragraph)
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", one.alias("x")))).alias("turns"))
    source = F.concat(F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><figure/>'), F.array_join(F.transform("turns", lambda t: t["x"]), ""), F.lit("</body></text></TEI>"))
    return element_counts(turns.select("conv_id", source.alias("source")), "conv_id", "source").select("conv_id", "n_p", "n_s", "n_note", "n_figure", "n_coords")


class Echo:
    """A client that answers a prompt "conv <n>" by n."""

    model, system = "echo", ""

    def __call__(self, prompt: str) -> str:
        return json.dumps({"n": int(prompt.split()[1])})


@query("SELECT conv_id, '{\"n\": ' || conv_id || '}' AS response, conv_id % 2 = 0 AS reused FROM (SELECT DISTINCT conv_id FROM conversations)")
def answers_asked_once(spark, d):
    """Half of the conversations are asked about, then all: the ledger has the former's answers already."""
    prompts = table(spark, d, "conversations").select("conv_id", F.format_string("conv %d", "conv_id").alias("prompt")).distinct()
    book, schema = ledger.Ledger(spark, storage.scratch(spark, "ledger")), strict_object({"n": {"type": "integer"}})
    ledger.ask_once(prompts.where("conv_id % 2 = 0"), "conv_id", "prompt", Echo(), schema, book, pause=0)
    return ledger.ask_once(prompts, "conv_id", "prompt", Echo(), schema, book, pause=0).where("error is null").select("conv_id", "response", "reused")


@query(f"WITH {BATCHED_SQL} SELECT topic_id::INT AS topic_id, 'topic ' || topic_id AS llm_topic_name, sample_id, md5(text) AS rule_md5 FROM b")
def json_documents_round_trip(spark, d):
    """One pretty JSON document per batch, context and rows, read again and taken apart."""
    path = storage.scratch(spark, "documents")
    row = F.struct("sample_id", F.col("topic_text").alias("if_then_rule"), F.lit("low").alias("green_relevance"), F.lit(True).alias("keep_for_rag"))
    context = F.struct("topic_id", F.concat(F.lit("topic "), "topic_id").alias("llm_topic_name"))
    made = batched_turns(spark, d).groupBy("topic_id", "batch_id").agg(F.collect_list(row).alias("rows")).withColumn("topic_context", context)
    storage.write_json_documents(made, path, storage.batch_name("json"), F.to_json(F.struct("topic_context", "rows")))
    rows = files.label_rows(files.read_label_documents(spark, f"{path}/*/*.json"))
    return rows.select("topic_context.topic_id", "topic_context.llm_topic_name", "row.sample_id", F.md5("row.if_then_rule").alias("rule_md5"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 7 = 0 THEN 'topic_id' WHEN n_nationkey % 5 = 1 THEN 'missing_topic_summary' WHEN n_nationkey % 4 = 2 THEN 'not_snake_case' WHEN n_regionkey = 4 THEN 'relevance' END AS verdict FROM nation""")
def validate_context(spark, d):
    """Nations as contexts, with a fault of each kind in some."""
    key = F.col("n_nationkey")
    level = F.element_at(F.array(*map(F.lit, ("high", "medium", "low", "none", "huge"))), F.col("n_regionkey").cast("int") + 1)
    category = F.when(key % 4 == 2, F.col("n_name")).otherwise(F.lower("n_name"))
    made = table(spark, d, "nation").select("n_nationkey", F.when(key % 7 != 0, key).alias("topic_id"), F.col("n_name").alias("llm_topic_name"), F.when(key % 5 == 1, " ").otherwise(F.col("n_name")).alias("topic_summary"), category.alias("green_category"), level.alias("global_green_relevance"))
    return made.select("n_nationkey", lab.context_verdict(key).alias("verdict"))


RELEVANCE_SQL = "CASE quality WHEN 1 THEN ' High ' WHEN 0 THEN 'none' END"


@query(f"""SELECT doc_id, lower(trim({RELEVANCE_SQL})) AS green_relevance FROM documents LEFT JOIN labels USING (doc_id) WHERE lower(trim({RELEVANCE_SQL})) IN ('medium', 'high') AND text IS NOT NULL AND text <> ''""")
def relevance_filter(spark, d):
    given = F.when(F.col("quality") == 1, " High ").when(F.col("quality") == 0, "none")
    level = F.lower(tx.strip(given))
    return labelled(spark, d).where(level.isin("medium", "high") & F.col("text").isNotNull() & (F.col("text") != "")).select("doc_id", level.alias("green_relevance"))


@query("""SELECT doc_id, coalesce(nullif(CASE WHEN quality = 1 THEN 'own' WHEN quality = 0 THEN '' END, ''), source) AS category FROM documents LEFT JOIN labels USING (doc_id)""")
def coalesce_override(spark, d):
    own = F.when(F.col("quality") == 1, "own").when(F.col("quality") == 0, "")
    return labelled(spark, d).select("doc_id", F.coalesce(F.nullif(own, F.lit("")), F.col("source")).alias("category"))


@query("""WITH c AS (SELECT event_type, count(*) AS type_events, min(event_id) AS first_event FROM events GROUP BY event_type) SELECT event_id, event_type, type_events, first_event FROM events JOIN c USING (event_type)""")
def context_attach(spark, d):
    events = table(spark, d, "events").select("event_id", "event_type")
    context = events.groupBy("event_type").agg(F.count("*").alias("type_events"), F.min("event_id").alias("first_event"))
    return events.join(context, "event_type")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract_events(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


NESTED = "array<struct<turn: bigint, role: string, text: string>>"


def nested(spark, d) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(rows.alias("rows"))


@query("SELECT conv_id, count(*) AS n_rows, md5(string_agg(turn || ':' || role || ':' || text, chr(10) ORDER BY turn, role, text)) AS rows_md5 FROM conversations GROUP BY conv_id")
def nest_rows(spark, d):
    lines = F.transform("rows", lambda r: F.concat_ws(":", r["turn"].cast("string"), r["role"], r["text"]))
    return nested(spark, d).select("conv_id", F.size("rows").cast("long").alias("n_rows"), F.md5(F.array_join(lines, "\n")).alias("rows_md5"))


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos, turn, role, length(text) AS chars FROM conversations")
def explode_rows(spark, d):
    document = nested(spark, d).select("conv_id", F.to_json("rows").alias("doc"))
    rows = document.select("conv_id", F.posexplode(F.from_json("doc", NESTED)).alias("pos", "row"))
    return rows.select("conv_id", F.col("pos").cast("long").alias("pos"), "row.turn", "row.role", F.length("row.text").cast("long").alias("chars"))


CATEGORY_MAP = {"src0": "lighting", "src1": "lighting", "src2": "hvac", "src3": "hvac", "src4": "water", "src5": "standby"}


@query("""WITH m AS (SELECT source, CASE source WHEN 'src0' THEN 'lighting' WHEN 'src1' THEN 'lighting' WHEN 'src2' THEN 'hvac' WHEN 'src3' THEN 'hvac' WHEN 'src4' THEN 'water' WHEN 'src5' THEN 'standby' END AS category FROM documents)
SELECT coalesce(category, 'unknown') AS category, count(DISTINCT source) AS originals, count(*) AS n FROM m GROUP BY 1""")
def category_normalise(spark, d):
    counts = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return counts.groupBy(ops.lookup(CATEGORY_MAP, F.col("source"), F.lit("unknown")).alias("category")).agg(F.count("*").alias("originals"), F.sum("n").alias("n"))


@query("""SELECT doc_id, category FROM (SELECT doc_id, unnest([CASE WHEN lang = 'en' THEN 'english' END, CASE WHEN n_chars > 2000 THEN 'long' END, CASE WHEN quality = 1 THEN 'good' END]) AS category
FROM documents LEFT JOIN labels USING (doc_id)) WHERE category IS NOT NULL""")
def one_hot_unpivot(spark, d):
    flags = F.create_map(F.lit("english"), F.col("lang") == "en", F.lit("long"), F.col("n_chars") > 2000, F.lit("good"), F.col("quality") == 1)
    hot = F.map_keys(F.map_filter(flags, lambda _, v: F.coalesce(v, F.lit(False))))
    return labelled(spark, d).select("doc_id", F.explode(hot).alias("category"))


@query("SELECT page_id, CAST(regexp_extract(url, '/(\\d+)(?:[./?#]|$)', 1) AS BIGINT) AS topic FROM pages WHERE CAST(nullif(regexp_extract(url, '/(\\d+)(?:[./?#]|$)', 1), '') AS BIGINT) BETWEEN 1 AND 40")
def topic_select(spark, d):
    key = F.nullif(F.regexp_extract("url", r"/(\d+)(?:[./?#]|\z)", 1), F.lit("")).cast("long")
    pages = table(spark, d, "pages").select("page_id", key.alias("topic"))
    return pages.where(F.col("topic").isin(*sorted(ops.parse_selection(["1-40"]))))


@query("SELECT page_id, regexp_extract(url, '://[^/]+/([a-z]+)/', 1) AS lang_key, CAST(nullif(regexp_extract(url, '/(\\d+)', 1), '') AS BIGINT) AS page_key FROM pages")
def path_key_extract(spark, d):
    number = F.nullif(F.regexp_extract("url", r"/(\d+)", 1), F.lit("")).cast("long")
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "://[^/]+/([a-z]+)/", 1).alias("lang_key"), number.alias("page_key"))
