"""Topics: terms that set classes apart, clusters of vectors, exact nearest vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import dataset
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.operators.shared_runs import counted, listed, shared
from gristmill.operators.topic_model import TopicEstimator
from gristmill.sources.storage import open_fs, scratch, small_batches, written


def ngrams(words: Column, longest: int) -> Column:
    """All runs of 1 to `longest` words, joined by spaces."""

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(words) - (n - 1))
        joined = lambda i: F.concat(*(x for k in range(n) for x in (F.lit(" "), F.element_at(words, i + k))[k == 0 :]))
        return F.when(F.size(words) >= n, F.transform(starts, joined)).otherwise(F.array().cast("array<string>"))

    return F.concat(words, *(runs(n) for n in range(2, longest + 1)))


# ---- fixed values: words of the rules' own vocabulary, left out of topics ------------------

DOMAIN_STOP_WORDS = (
    "rule", "rules", "action", "actions", "trigger", "triggers", "original", "smart", "home", "automation", "automations",
    "system", "executes", "execute", "main", "important", "grouping", "similar", "title", "description", "descriptions",
    "text", "trigger_channel", "action_channel", "channel", "channels", "app", "ifttt", "send", "sent", "receive",
    "received", "specific", "using",
)
ENGLISH_STOP_WORDS = (
    "a", "about", "above", "after", "again", "against", "all", "also", "am", "among", "an", "and", "any", "are", "as", "at",
    "be", "because", "been", "before", "being", "below", "between", "both", "but", "by", "can", "could", "did", "do", "does",
    "doing", "down", "during", "each", "ever", "every", "few", "for", "from", "further", "had", "has", "have", "having", "he",
    "her", "here", "hers", "herself", "him", "himself", "his", "how", "if", "in", "into", "is", "it", "its", "itself", "just",
    "may", "me", "might", "more", "most", "must", "my", "myself", "no", "nor", "not", "now", "of", "off", "on", "once", "one",
    "only", "or", "other", "our", "ours", "ourselves", "out", "over", "own", "same", "shall", "she", "should", "since", "so",
    "some", "such", "than", "that", "the", "their", "theirs", "them", "themselves", "then", "there", "these", "they", "this",
    "those", "through", "to", "too", "under", "until", "up", "upon", "us", "very", "was", "we", "were", "what", "when",
    "where", "which", "while", "who", "whom", "whose", "why", "will", "with", "within", "without", "would", "you", "your",
    "yours", "yourself", "yourselves",
)
MIN_DF, MAX_DF, LONGEST, TOP_WORDS = 4, 0.6, 3, 15
REPRESENTATIVES, CANDIDATES = 5, 100
#: Weights of terms that are broadcast to the texts, some 60 bytes each.
BROADCAST_TERMS = 1_000_000
#: Scores that a task has at a time, 8 bytes each.
SCORES = 1 << 20


def stop_words(general: tuple[str, ...] = ENGLISH_STOP_WORDS) -> tuple[str, ...]:
    """The domain's words and a language's function words."""
    return tuple(sorted({*DOMAIN_STOP_WORDS, *general}))


def tokens(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """The words of a text in lower case that are two ASCII letters or more, between word boundaries; stop words go."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(?<![\p{L}\p{N}_])[a-z]{2,}+(?![\p{L}\p{N}_])"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(*stop)) if stop else found


def _runs(docs: DataFrame, class_col: str, text_col: str, stop: tuple[str, ...], longest: int, *keys: str) -> DataFrame:
    """class, the keys, term: every run of up to `longest` words of each text; a text with a word has the empty term besides."""
    found = docs.select(F.col(class_col).alias("class"), *keys, tokens(F.col(text_col), stop).alias("words"))  # once a text, not once an n-gram
    return found.where(F.size("words") > 0).select("class", *keys, F.explode(F.concat(ngrams(F.col("words"), longest), F.array(F.lit("")))).alias("term"))


def terms(docs: DataFrame, class_col: str, text_col: str, stop: tuple[str, ...] = (), longest: int = 1) -> DataFrame:
    """class, term, n: how often each class has each run of up to `longest` words; stop words are left out first."""
    return _runs(docs, class_col, text_col, stop, longest).where("term != ''").groupBy("class", "term").agg(F.count("*").alias("n"))


def term_table(docs: DataFrame, class_col: str, text_col: str, stop: tuple[str, ...] = (), longest: int = LONGEST, min_df: int = MIN_DF) -> DataFrame:
    """class, term, n, freq, classes: the counts of the terms that at least `min_df` classes have, written once.

    freq and classes are a term's totals. The empty term stands for each class that has a word at all, so
    all that follows is read from this table; the texts are not counted again. Runs that fewer classes have are found
    by their hashes and shorter parts, so hardly any of their texts are counted or moved.
    """
    if min_df > 1:
        words = written(docs.select(F.col(class_col).alias("class"), tokens(F.col(text_col), stop).alias("words")).where(F.size("words") > 0), "words")
        runs = counted(words, ["class"], longest, shared(words, longest, min_df)).repartition("term")  # the one that counts serves the window too
        counts = runs.groupBy("class", "term").agg(F.sum("n").alias("n"))
    else:
        counts = _runs(docs, class_col, text_col, stop, longest).groupBy("class", "term").agg(F.count("*").alias("n"))
    own = Window.partitionBy("term")
    totals = counts.withColumns({"freq": F.sum("n").over(own), "classes": F.count("*").over(own)})
    with small_batches(docs.sparkSession):
        return written(totals.where((F.col("classes") >= min_df) | (F.col("term") == "")), "terms")


def _kept(table: DataFrame, max_df: float) -> DataFrame:
    """The terms that at most the share `max_df` of the classes has."""
    k = table.where("term = ''").agg(F.count("*").alias("k"))
    return table.where("term != ''").join(F.broadcast(k), F.col("classes") <= max_df * F.col("k")).select("class", "term", "n", "freq")  # one row


def vocabulary(table: DataFrame, max_df: float = MAX_DF) -> DataFrame:
    """term, freq: the terms of a term table that at most the share `max_df` of its classes has, and their totals."""
    return _kept(table, max_df).groupBy("term").agg(F.any_value("freq").alias("freq"))


def class_weights(table: DataFrame, max_df: float = MAX_DF) -> DataFrame:
    """class, term, n, idf, weight: class-based TF-IDF, sqrt(share of the class) * idf.

    idf is ln(1 + (A - f + 0.5) / (f + 0.5)), over the terms of `vocabulary` alone; f is the term's total, A
    the mean number of terms of a class, a whole number. A term with f above A has a negative weight.
    """
    kept = _kept(table, max_df)
    totals = kept.groupBy("class").agg(F.sum("n").alias("total"))
    mean = totals.agg(F.floor(F.sum("total") / F.count("*")).alias("a"))
    idf = F.log(1 + (F.col("a") - F.col("freq") + 0.5) / (F.col("freq") + 0.5))
    joined = kept.join(totals, "class").join(F.broadcast(mean), F.lit(True)).withColumn("idf", idf)  # one row
    return joined.select("class", "term", "n", "idf", (F.sqrt(F.col("n").cast("double") / F.col("total")) * F.col("idf")).alias("weight"))


def document_terms(docs: DataFrame, weights: DataFrame, class_col: str, id_col: str, text_col: str, stop: tuple[str, ...] = (), longest: int = LONGEST) -> DataFrame:
    """class, id, term, n, idf, weight: the weighted terms of each document, written once: a sparse matrix by rows of (document, term)."""
    words = docs.select(F.col(class_col).alias("class"), F.col(id_col).alias("id"), tokens(F.col(text_col), stop).alias("words"))
    known = weights.select("class", "term", "idf", "weight")
    known = F.broadcast(known) if weights.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else known
    found = counted(words, ["class", "id"], longest, listed(weights, longest), each=True).join(known, ["class", "term"]).select("class", "id", "term", "n", "idf", "weight")
    again = docs.groupBy(F.col(class_col).alias("class"), F.col(id_col).alias("id")).agg(F.count("*").alias("k")).where("k > 1").select("class", "id")
    if not again.isEmpty():  # several texts of one document
        same = F.col("class").eqNullSafe(F.col("_class")) & F.col("id").eqNullSafe(F.col("_id"))
        again = written(again.select(F.col("class").alias("_class"), F.col("id").alias("_id")), "repeated")
        many = found.join(again, same, "left_semi").groupBy("class", "id", "term").agg(F.sum("n").alias("n"), F.any_value("idf").alias("idf"), F.any_value("weight").alias("weight"))
        found = found.join(again, same, "left_anti").unionByName(many)
    with small_batches(docs.sparkSession):
        return written(found, "document-terms")


def representatives(found: DataFrame, weights: DataFrame, per_class: int = REPRESENTATIVES) -> DataFrame:
    """class, rank, id, similarity: each class's documents whose TF-IDF is nearest to the class's, by cosine.

    A document's weights are sqrt(share) * idf over the vocabulary, like its class's. The products of the
    sparse document by term and class by term matrices are added up by document; ties go to the smaller id.
    """
    own = F.sqrt(F.col("n").cast("double")) * F.col("idf")  # the document's length cancels out
    products = found.groupBy("class", "id").agg(F.sum(own * F.col("weight")).alias("dot"), F.sum(own * own).alias("norm"))
    sizes = weights.groupBy("class").agg(F.sum(F.col("weight") * F.col("weight")).alias("size"))
    cosine = F.try_divide(F.col("dot"), F.sqrt(F.col("norm")) * F.sqrt(F.col("size")))
    scored = products.join(sizes, "class").select("class", "id", F.round(F.coalesce(cosine, F.lit(0.0)), 6).alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("similarity"), "id"))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= per_class).select("class", "rank", "id", "similarity")


def rerank(weights: DataFrame, found: DataFrame, vectors: DataFrame, per_class: int = REPRESENTATIVES, candidates: int = CANDIDATES, top: int = TOP_WORDS, term_vectors: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """class, rank, term, similarity: a class's `candidates` heaviest terms by the cosine of their vectors and the class's.

    `found` is the outcome of `document_terms`, `vectors` has id and v. A class's vector is the mean of
    its representative documents'. `term_vectors` makes (term, tv) of the candidates (term), in the space of `vectors`, as
    `WordVectors.of_terms` does; without it a term's vector is the mean over all documents that have it. Ties go
    to the term in order.
    """
    order = F.row_number().over(Window.partitionBy("class").orderBy(F.desc(F.round("weight", 6)), "term"))
    heavy = weights.withColumn("at", order).where(F.col("at") <= candidates).select("class", "term")
    known = vectors.where("v is not null").select("id", array_to_vector(F.col("v").cast("array<double>")).alias("v"))
    chosen = representatives(found, weights, per_class).select("class", "id")
    center = chosen.join(known, "id").groupBy("class").agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("cv"))
    if term_vectors:
        of_term = term_vectors(heavy.select("term").distinct())
    else:
        has = found.join(heavy.select("term").distinct(), "term").select("term", "id").distinct()
        of_term = has.join(known, "id").groupBy("term").agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("tv"))
    joined = heavy.join(of_term, "term").join(center, "class")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cosine = F.try_divide(dot("tv", "cv"), F.sqrt(dot("tv", "tv")) * F.sqrt(dot("cv", "cv")))
    scored = joined.select("class", "term", F.round(F.coalesce(cosine, F.lit(0.0)), 5).alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("similarity"), "term"))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("class", "rank", "term", "similarity")


def topic_names(ranked: DataFrame, k: int = 4) -> DataFrame:
    """class, name: the class and the k first terms of its ranking, joined by underscores."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"])
    return ranked.where(F.col("rank") <= k).groupBy("class").agg(F.concat_ws("_", F.col("class"), F.array_join(listed, "_")).alias("name"))


def components(vectors: DataFrame, id_col: str, vector_col: str, dims: int) -> DataFrame:
    """id, p: the first principal components of every vector."""
    rows = vectors.select(id_col, array_to_vector(F.col(vector_col).cast("array<double>")).alias("v"))
    return PCA(k=dims, inputCol="v", outputCol="pc").fit(rows).transform(rows).select(id_col, vector_to_array("pc").alias("p"))


def cluster(vectors: DataFrame, id_col: str, vector_col: str, k: int, dims: int, spread: float = 3.0, seed: int = 42) -> DataFrame:
    """id, topic_id, distance: the topics of a model that is fitted to the vectors themselves (see `topic_model`)."""
    model = TopicEstimator(k, dims, spread, seed).fit(vectors, vector_col)
    return model.transform(vectors.select(id_col, vector_col), vector_col).select(id_col, "topic_id", "distance")


def cosine_topk(vectors: DataFrame, id_col: str, vector_col: str, is_query: Column, k: int, block: int = 1024, chunk: int = 16_384) -> DataFrame:
    """query_id, id, score: the k nearest other vectors of every query, exactly; equal scores by id.

    The queries are written once; a task holds `chunk` of its vectors and reads the queries past them, `block` at a
    time and scored SCORES at a time, so neither the driver nor a task ever has them all. Each chunk leaves k candidates a query and its
    ties; they meet once. Rows without an id or a vector take no part.
    """
    shaped = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("_query")).where("id is not null and v is not null")
    rows, path = shaped.select("id", "v"), scratch(vectors.sparkSession, "queries")
    shaped.where("_query").select("id", "v").write.parquet(path)

    def unit(col: pa.Array) -> np.ndarray:
        x = col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    def nearest(ids: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        fs, base = open_fs(path)
        step = max(1, SCORES // len(ids))
        for batch in dataset.dataset(base, filesystem=fs, format="parquet").to_batches(batch_size=block, batch_readahead=1, fragment_readahead=1, use_threads=False):
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                wanted = part.column(0).to_numpy()
                score = unit(part.column(1)) @ x.T
                np.round(score, 6, out=score)
                place = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
                for q in np.flatnonzero(ids[place] == wanted):
                    score[q, place[q] : np.searchsorted(ids, wanted[q], side="right")] = -np.inf
                least = np.partition(score, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(wanted), -np.inf)
                row, col = np.nonzero((score >= least[:, None]) & np.isfinite(score))  # k per query, and ties with the last
                yield pa.RecordBatch.from_arrays([pa.array(wanted[row]), pa.array(ids[col]), pa.array(score[row, col])], names=["query_id", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), unit(batch.column(1))))
                size += batch.num_rows
            if size >= chunk:
                yield from nearest(*map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
        if held:
            yield from nearest(*map(np.concatenate, zip(*held, strict=True)))

    found = rows.mapInArrow(run, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rn", rank).where(F.col("rn") <= k).select("query_id", F.col("id").alias(id_col), "score")
