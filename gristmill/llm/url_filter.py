"""URL filter: path rules, and gradient-boosted trees on lexical features for the rest.

Everything here is a DataFrame or SQL expression that runs in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import write_table

SALTS = 16  # parts of a suffix in a shuffle join
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """`host/path` with a verdict; it fits the host and its subdomains where the path starts so."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


RULES = (
    Rule("allow", "com/"),
    Rule("block", "example.com/en/"),
    Rule("allow", "www.example.com/en/"),
    Rule("block", "net/es/"),
    Rule("block", "net/fr/"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without `://`."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    tail = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    host = F.translate(F.regexp_extract(tail, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(tail, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def match_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features of the URL string alone."""
    u = F.coalesce(url, F.lit(""))
    n = F.length(u).cast("double")
    chars = F.split(u, "")
    entropy = F.aggregate(
        F.array_distinct(chars),
        F.lit(0.0),
        lambda acc, c: acc - F.when(c == "", 0.0).otherwise((n - F.length(F.replace(u, c, F.lit("")))) / n * F.log2((n - F.length(F.replace(u, c, F.lit("")))) / n)),
    )
    query = F.when(F.instr(u, "?") > 0, F.regexp_count(F.regexp_extract(u, r"\?([^#]*)", 1), F.lit("[^&]+"))).otherwise(0)
    return {
        "f_length": n,
        "f_host_length": F.length(host).cast("double"),
        "f_path_length": F.length(path).cast("double"),
        "f_depth": F.regexp_count(path, F.lit("/[^/]")).cast("double"),
        "f_labels": F.regexp_count(host, F.lit("[^.]+")).cast("double"),
        "f_digit_ratio": F.when(n > 0, F.regexp_count(u, F.lit("[0-9]")) / n).otherwise(0.0),
        "f_hyphens": F.regexp_count(host, F.lit("-")).cast("double"),
        "f_params": query.cast("double"),
        "f_fragment": (F.instr(u, "#") > 0).cast("double"),
        "f_entropy": F.when(n > 0, entropy).otherwise(0.0),
    }


def judge_urls(
    pages: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    max_train: int = 10_000,
    broadcast_suffixes: int = 100_000,
    trees: int = 12,
    depth: int = 3,
    seed: int = 7,
) -> DataFrame:
    """Judge every URL: the longest fitting rule's verdict, else that of boosted trees.

    The labelled URLs that the trees learn from are those that a rule decides. At most
    `max_train` of each verdict are used, the ones with the smallest hash of the URL: that bounds
    the fit. Suffix statistics (share of the rows, mean length, mean digit ratio) are counted over
    all rows for every last label; one without a value takes the mean over all rows. The table is
    broadcast up to `broadcast_suffixes` labels, beyond that it is joined by a salted shuffle.

    Null URLs and those without `://` have empty host and path, fit no rule and are judged by the
    trees on zero features. With labelled URLs of one verdict only, or none, the trees cannot be
    fitted and undecided URLs take that verdict, or `allow`. Repeated rows are judged each. Only
    `id_col` and `url_col` are read; other columns, whatever their names, do not matter.

    Returns page_id, host, path, rule, verdict, block_score.
    """
    spark = pages.sparkSession
    host, path = split_url(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.withColumns({"host": host, "path": path})
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "given": verdict, "suffix": F.regexp_extract("host", r"([^.]*)$", 1)})

    slim = rows.select("suffix", F.length("url").alias("n"), F.try_divide(F.regexp_count("url", F.lit("[0-9]")), F.length("url")).alias("d"))
    stats = slim.groupBy("suffix").agg(F.count("*").alias("rows"), F.sum("n").alias("sum_n"), F.count("n").alias("n"), F.sum("d").alias("sum_d"), F.count("d").alias("nd"))
    stats, _ = write_table(stats, "url-suffixes")
    total = stats.agg(F.count("*").alias("suffixes"), F.sum("rows").alias("rows"), F.try_divide(F.sum("sum_n"), F.sum("n")).alias("n"), F.try_divide(F.sum("sum_d"), F.sum("nd")).alias("d")).first()
    stats = stats.select("suffix", "rows", F.try_divide("sum_n", "n").alias("s_length"), F.try_divide("sum_d", "nd").alias("s_digits"))
    everything = float(total["rows"] or 1)
    suffix_features = {
        "f_suffix_share": F.coalesce(F.col("rows") / everything, F.lit(0.0)),
        "f_suffix_length": F.coalesce("s_length", F.lit(float(total["n"] or 0.0))),
        "f_suffix_digits": F.coalesce("s_digits", F.lit(float(total["d"] or 0.0))),
    }
    features = lexical(F.col("url"), F.col("host"), F.col("path")) | suffix_features
    if total["suffixes"] <= broadcast_suffixes:
        full = rows.join(F.broadcast(stats), "suffix", "left")
    else:
        salted = stats.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        full = rows.withColumn("salt", F.pmod(F.xxhash64("url", "page_id"), F.lit(SALTS))).join(salted, ["suffix", "salt"], "left")
    full = full.withColumns(features)

    order = F.xxhash64("url", "page_id")
    labelled = [full.where(F.col("given") == v).orderBy(order, "url", "page_id").limit(max_train) for v in ("allow", "block")]
    train, _ = write_table(labelled[0].unionByName(labelled[1]).select(*features, (F.col("given") == "block").cast("double").alias("label")), "url-train")
    found = [r["label"] for r in train.select("label").distinct().collect()]  # two values at most
    if len(found) < 2:
        only = "block" if found == [1.0] else "allow"
        scored = full.withColumn("block_score", F.lit(1.0 if only == "block" else 0.0))
    else:
        assemble = VectorAssembler(inputCols=list(features), outputCol="features")
        model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed, maxBins=64).fit(assemble.transform(train).select("features", "label"))
        scored = model.transform(assemble.transform(full)).withColumn("block_score", vector_to_array("probability")[1])
    learned = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("given", learned).alias("verdict"), "block_score")
