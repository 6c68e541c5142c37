"""Incremental collection: files that arrive are processed once, keyed results appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from gristmill.operators.tables import pending

#: Folders that results are dealt to by their key.
BUCKETS = 64
BUCKET = "key_bucket"


def collect_new(spark: SparkSession, in_dir: str, schema: T.StructType, out_dir: str, checkpoint: str, key: str, shape: Callable[[DataFrame], DataFrame] = lambda df: df, buckets: int = BUCKETS) -> StreamingQuery:
    """Read the JSON files of in_dir not read before, and append the rows whose key is not in out_dir.

    Results lie in folders by the hash of their key (`key_bucket`, a column of what is read there), and a
    batch looks for its keys in the folders of its own keys alone, reading nothing but keys; so what a
    small batch costs does not grow with all that was collected, but with its share. The run ends when all
    files there are have been read; the next one goes on from its checkpoint. A batch that is repeated after a
    failure adds nothing twice. Of rows that share a key in a batch any one is taken.
    """

    def add(batch: DataFrame, epoch: int) -> None:
        rows = shape(batch).dropDuplicates([key]).withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        rows.persist()
        try:
            wanted = [r[0] for r in rows.select(BUCKET).distinct().collect()]  # `buckets` at most
            known = batch.sparkSession.read.schema(T.StructType([rows.schema[key], T.StructField(BUCKET, T.IntegerType())])).option("ignoreMissingFiles", True)
            try:
                fresh = pending(rows, known.parquet(out_dir).where(F.col(BUCKET).isin(*wanted)), key)
            except Exception as error:  # noqa: BLE001
                if "PATH_NOT_FOUND" not in str(error):
                    raise
                fresh = rows
            if wanted:
                fresh.repartition(BUCKET).write.mode("append").partitionBy(BUCKET).parquet(out_dir)
        finally:
            rows.unpersist()

    stream = spark.readStream.schema(schema).json(in_dir)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
