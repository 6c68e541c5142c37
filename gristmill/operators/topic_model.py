"""Topics as a model: fitted once, written, read again, and applied to rows that come later, in streams too."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.sources.filesets import get_text, put_text
from gristmill.sources.storage import open_fs


@dataclass(frozen=True)
class Topic:
    """A topic's centre among the components, and the distance beyond which a row is none of it."""

    centre: tuple[float, ...]
    limit: float


@dataclass(frozen=True)
class TopicModel:
    """Principal components, then the nearest centre; a row farther from it than the topic's limit is an outlier, -1.

    Everything is in the model, so a row's topic does not depend on the rows it comes with. A row without a
    vector has no topic (null).
    """

    stages: PipelineModel
    topics: tuple[Topic, ...]

    def transform(self, rows: DataFrame, vector_col: str, topic_out: str = "topic_id", distance_out: str = "distance") -> DataFrame:
        """The rows with their topic and its distance; rows may be a stream."""
        known = F.col(vector_col).isNotNull()
        given = F.when(known, F.col(vector_col).cast("array<double>")).otherwise(F.array(*[F.lit(0.0)] * self.stages.stages[0].pc.numRows))
        placed = self.stages.transform(rows.withColumn("_v", array_to_vector(given)))
        centres = F.array(*(F.array(*map(F.lit, t.centre)) for t in self.topics))
        at = F.col("_topic") + 1
        distance = F.sqrt(F.aggregate(F.zip_with(vector_to_array("_p"), F.element_at(centres, at), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
        limit = F.element_at(F.array(*(F.lit(t.limit) for t in self.topics)), at)
        judged = placed.withColumn("_d", F.when(known, distance))
        topic = F.when(known, F.when(F.col("_d") > limit, -1).otherwise(F.col("_topic")))
        return judged.select(*(F.col(f"`{c}`") for c in rows.columns), topic.alias(topic_out), F.col("_d").alias(distance_out))

    def write(self, path: str) -> None:
        """Put the model in a folder; one that is there is replaced."""
        self.stages.write().overwrite().save(f"{path}/stages")
        fs, base = open_fs(path)
        put_text(fs, f"{base}/topics.json", json.dumps([[t.centre, t.limit] for t in self.topics]))

    @staticmethod
    def read(spark: SparkSession, path: str) -> TopicModel:
        fs, base = open_fs(path)
        topics = json.loads(get_text(fs, f"{base}/topics.json") or "null")
        if topics is None:
            raise FileNotFoundError(f"no topic model in {path}")
        return TopicModel(PipelineModel.load(f"{path}/stages"), tuple(Topic(tuple(c), limit) for c, limit in topics))


@dataclass(frozen=True)
class TopicEstimator:
    """Fits a TopicModel: `dims` principal components, k-means with `k` centres, limits of a topic's mean
    distance plus `spread` deviations."""

    k: int
    dims: int
    spread: float = 3.0
    seed: int = 42

    def fit(self, rows: DataFrame, vector_col: str) -> TopicModel:
        known = rows.where(F.col(vector_col).isNotNull())
        vectors = known.select(array_to_vector(F.col(vector_col).cast("array<double>")).alias("_v"))
        pca = PCA(k=self.dims, inputCol="_v", outputCol="_p").fit(vectors)
        reduced = pca.transform(vectors)
        means = KMeans(k=self.k, seed=self.seed, featuresCol="_p", predictionCol="_topic").fit(reduced)
        centres = [tuple(float(x) for x in c) for c in means.clusterCenters()]  # k of them
        model = TopicModel(PipelineModel([pca, means]), tuple(Topic(c, float("inf")) for c in centres))
        distances = model.transform(known.select(F.col(vector_col).alias("v")), "v")
        found = distances.groupBy("topic_id").agg(_limit(F.col("distance"), self.spread).alias("limit")).collect()  # a row a topic
        limits = {r["topic_id"]: r["limit"] for r in found}
        return TopicModel(model.stages, tuple(Topic(c, limits.get(i, 0.0)) for i, c in enumerate(centres)))


def _limit(distance: Column, spread: float) -> Column:
    return F.avg(distance) + spread * F.coalesce(F.stddev_samp(distance), F.lit(0.0))
