"""File sources of the curation stages: rules, batches, label documents, articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTEXT = T.StructType([T.StructField("topic_id", T.IntegerType()), *(T.StructField(n, T.StringType()) for n in ("llm_topic_name", "topic_summary", "green_category", "global_green_relevance"))])
LABEL = T.StructType([*(T.StructField(n, T.StringType()) for n in ("sample_id", "if_then_rule", "green_relevance")), T.StructField("keep_for_rag", T.BooleanType()), T.StructField("llm_topic_name", T.StringType()), T.StructField("green_category", T.StringType())])
BATCH_DOCUMENT = T.StructType([T.StructField("topic_context", CONTEXT), T.StructField("rows", T.ArrayType(LABEL)), T.StructField("_corrupt_record", T.StringType())])


def read_delimited(spark: SparkSession, path: str, columns: list[str], sep: str = ";", encoding: str = "UTF-8") -> DataFrame:
    """A CSV of strings with a header; quoted separators, quotes and line ends are data. With `file_path`."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    reader = spark.read.schema(schema).option("header", True).option("sep", sep).option("encoding", encoding).option("multiLine", True).option("escape", '"').option("enforceSchema", False)
    return reader.csv(path).select(*columns, F.col("_metadata.file_path").alias("file_path"))


def topic_of_path(path: Column) -> Column:
    """The number in the folder `topic_<n>` that a file lies in."""
    return F.nullif(F.regexp_extract(F.element_at(F.split(path, "/"), -2), r"\Atopic_(-?\d+)\z", 1), F.lit("")).cast("int")


def read_batches(spark: SparkSession, root: str) -> DataFrame:
    """All batch files topic_*/topic_*_batch_*.csv under root, with topic_id and batch_id; none at all is an error."""
    found = read_delimited(spark, f"{root}/topic_*/topic_*_batch_*.csv", ["sample_id", "topic_name", "topic_text"], sep=",")
    return found.withColumns({"topic_id": topic_of_path(F.col("file_path")), "batch_id": F.regexp_extract("file_path", r"_batch_(\d+)\.csv\z", 1).cast("int")})


def read_label_documents(spark: SparkSession, path: str) -> DataFrame:
    """Nested label documents, one per file, with `file_path`; what is not JSON is in `_corrupt_record`."""
    reader = spark.read.schema(BATCH_DOCUMENT).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record")
    return reader.json(path).select("*", F.col("_metadata.file_path").alias("file_path"))


def _found(spark: SparkSession, root: str, pattern: str) -> bool:
    """Whether any file under the root has a name of the pattern."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{pattern}")
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def read_contexts(spark: SparkSession, root: str) -> DataFrame:
    """The contexts topic_*/topic_*_context.json under root; none is an empty table."""
    pattern = "topic_*/topic_*_context.json"
    if not _found(spark, root, pattern):
        return spark.createDataFrame([], CONTEXT)
    return spark.read.schema(CONTEXT).option("multiLine", True).json(f"{root}/{pattern}").where("topic_id is not null")


def read_labelled(spark: SparkSession, root: str) -> DataFrame:
    """topic_id, batch_id, topic_context, rows of the label documents topic_*/topic_*_batch_*.json under root; none is an empty table."""
    pattern = "topic_*/topic_*_batch_*.json"
    found = read_label_documents(spark, f"{root}/{pattern}") if _found(spark, root, pattern) else spark.createDataFrame([], BATCH_DOCUMENT).withColumn("file_path", F.lit("topic_0/none"))
    own = F.transform("rows", lambda r: F.struct(*(r[c].alias(c) for c in ("sample_id", "if_then_rule", "green_relevance", "keep_for_rag"))))
    return found.select(topic_of_path(F.col("file_path")).alias("topic_id"), F.regexp_extract("file_path", r"_batch_(\d+)\.json\z", 1).try_cast("int").alias("batch_id"), "topic_context", own.alias("rows"))


def label_rows(documents: DataFrame) -> DataFrame:
    """A row per label with its order (file_path, pos); a document without context or rows is an error."""
    whole = F.col("topic_context").isNotNull() & F.col("rows").isNotNull()
    refused = F.raise_error(F.concat(F.lit("not a label document: "), F.col("file_path"))).cast(documents.schema["rows"].dataType)
    return documents.select("file_path", "topic_context", F.posexplode(F.when(whole, F.col("rows")).otherwise(refused)).alias("pos", "row"))


def final_rules(rows: DataFrame) -> DataFrame:
    """Relevant labels as rules: a row's own fields before its context's, one row per rule, first file first."""
    level = F.lower(F.trim(F.coalesce(F.col("row.green_relevance"), F.lit(""))))
    present = [F.coalesce(F.col(f"row.{c}"), F.lit("")) != "" for c in ("sample_id", "if_then_rule")]

    def field(name: str) -> Column:
        return F.coalesce(F.nullif(F.col(f"row.{name}"), F.lit("")), F.nullif(F.col(f"topic_context.{name}"), F.lit("")))

    names = ("llm_topic_name", "green_category")
    kept = rows.where(level.isin("medium", "high") & present[0] & present[1])
    complete = kept.where(F.when(field(names[0]).isNotNull() & field(names[1]).isNotNull(), True).otherwise(F.raise_error(F.concat(F.lit("no topic or category for "), F.col("row.sample_id")))))
    shaped = complete.select(F.trim("row.sample_id").alias("sample_id"), *(F.trim(field(n)).alias(n) for n in names), F.trim("row.if_then_rule").alias("if_then_rule"), "file_path", "pos")
    return shaped.groupBy("if_then_rule").agg(F.min_by(F.struct("sample_id", *names), F.struct("file_path", "pos")).alias("first")).select("first.*", "if_then_rule")


def read_documents(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".xml",)) -> DataFrame:
    """Whole text files as (article_id, source, file_path), one row each."""
    rows = spark.read.text(path, wholetext=True).select(F.col("value").alias("source"), F.col("_metadata.file_path").alias("file_path"))
    pattern = "|".join(s.replace(".", r"\.") for s in suffixes)
    name = F.regexp_replace(F.element_at(F.split("file_path", "/"), -1), rf"(\.grobid)?(\.tei)?({pattern})\z", "")
    return rows.where(F.col("file_path").rlike(rf"({pattern})\z")).select(name.alias("article_id"), "source", "file_path")


def list_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...]) -> list[str]:
    """The names in a folder that have one of the suffixes, sorted; on any file system that Spark reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(where) if s.isFile()] if fs.exists(where) else []
    return sorted(n for n in names if n.lower().endswith(suffixes))


def resolve_file(spark: SparkSession, folder: str, article: str, suffixes: tuple[str, ...]) -> str:
    """The file of an article: its exact name, the same in another case, or the only one that begins so.

    Otherwise an error lists what there is.
    """
    names = list_files(spark, folder, suffixes)
    for test in (lambda n: any(n == article + s for s in suffixes), lambda n: any(n.lower() == (article + s).lower() for s in suffixes), lambda n: n.lower().startswith(article.lower())):
        found = [n for n in names if test(n)]
        if len(found) == 1:
            return f"{folder}/{found[0]}"
        if found:
            raise FileNotFoundError(f"{article} is ambiguous: {', '.join(found)}")
    raise FileNotFoundError(f"no file for {article} among: {', '.join(names) or 'none'}")
