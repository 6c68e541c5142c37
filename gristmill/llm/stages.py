"""The stages of the corpus pipeline, each on top of one operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import decontam, language_id, ngram_jaccard, packing, pii
from gristmill.llm.common import small_batches, write_table

#: Rows up to which a set of ids is broadcast; beyond that it is joined by a shuffle.
BROADCAST_IDS = 500_000


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows whose id is not among `ids`, which are found once and written; rows without an id stay."""
    gone, _ = write_table(ids.select(id_col).distinct(), "gone")
    if gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, id_col, "left_anti").select(docs.columns)


#: Rows of an Arrow batch: workers carry the memory of all stages.
ROWS = 500
#: A document goes whose share of known n-grams is below this part of its language's median.
SHARE_OF_MEDIAN = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, and those that fit no language.

    Two filters are made, of the texts whose hash is even and odd, and each judges the other's, so
    no text and no copy of it vouches for itself. A document goes if the corrected share of its
    n-grams that its best language has is below SHARE_OF_MEDIAN of the median share of the labelled
    documents that are judged to be in that language. Texts in a language that the corpus does not
    have and random letters fall below, clean texts are near the median.

    Null and empty texts have no letter and go; rows without a label teach nothing and are judged
    like all others; repeated rows are judged each; an empty table stays empty. Columns stay as they are.
    """
    pred, score, share = (pii.free_name(n, docs.columns) for n in ("_lang_pred", "_lang_score", "_lang_share"))
    fold = F.xxhash64("text") % 2 == 0
    judged = None
    for side in (True, False):
        model = language_id.train(docs.where(fold != side))
        part = language_id.identify(docs.where(fold == side), model, lang_out=pred, score_out=score, share_out=share)
        judged = part if judged is None else judged.unionByName(part)
    with small_batches(spark, ROWS):
        judged, _ = write_table(judged, "language-judged")
    medians = judged.where(F.col("lang").isNotNull() & (F.col(share) > 0)).groupBy(pred).agg(F.percentile_approx(share, 0.5).alias("m")).collect()  # a row per language
    least = F.lit(0.0)
    for r in medians:
        least = F.when(F.col(pred) == r[pred], SHARE_OF_MEDIAN * r["m"]).otherwise(least)
    kept = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)) & (F.col(share) >= least)
    return judged.where(kept).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group of near copies the document with the smallest id.

    Every row is a document and is judged by its text alone: rows that share an id, or have none, go only if
    they are copies, and of these the first row with the smallest id stays, one without an id last. Null and empty
    texts are near nothing and stay; an empty table stays empty. Columns stay as they are.
    """
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        groups, _ = write_table(ngram_jaccard.jaccard_groups(docs, k=5, percent=80), "near-copies")
        return without(docs, groups.where("doc_id <> component_id"))
    row = pii.free_name("_row", docs.columns)
    keyed, _ = write_table(docs.withColumn(row, F.monotonically_increasing_id()), "keyed")
    found = ngram_jaccard.jaccard_groups(keyed, k=5, percent=80, id_col=row)
    groups, _ = write_table(found.where("n_shingles > 0").select(F.col("doc_id").alias(row), "component_id"), "near-copies")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", row)
    first = groups.join(keyed.select("doc_id", row), row).groupBy("component_id").agg(F.min(order)[row].alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    return without(keyed, groups.join(first, "component_id").where(F.col(row) != F.col("_first")), row).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item.

    Null and empty texts hold none; rows without an id stay; of repeated rows all go or all stay; either
    table may be empty. Columns stay as they are.
    """
    with small_batches(spark, ROWS):
        return without(docs, decontam.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def sanitise_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the sanitised text in place of the text and count its characters anew.

    A null text stays null, every row is kept, and input columns keep their values whatever their names.
    """
    outputs = {n for n, _ in pii.FIELDS}
    aside = {c: f"_own_{i}_{c}" for i, c in enumerate(docs.columns) if c.lower() in outputs}
    with small_batches(spark, ROWS):
        found, _ = write_table(pii.find_pii(docs.withColumnsRenamed(aside)).drop("spans", "base_sha256"), "sanitised")
    text = F.when(F.col("text").isNotNull(), F.col("sanitised"))
    changed = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return found.withColumns(changed).select(*(F.col(aside.get(c, c)).alias(c) for c in docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 ids; workers have the other stages' memory to carry.

    A null text is one end id; repeated rows are packed each; an empty table gives no rows.
    """
    with small_batches(spark, ROWS):
        packed = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), size=2048, end_id=1, block_tokens=1 << 20, batch_bytes=1 << 20, cached=30_000)
        return write_table(packed, "packed")[0]
