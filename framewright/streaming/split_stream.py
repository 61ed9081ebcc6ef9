"""The line splitter as a stateless stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from framewright.functions.paths import IMAGE_SUFFIXES, has_suffix
from framewright.functions.rows import stable_key
from framewright.operators.sampling import hash_split
from framewright.sources.jsonl import tolerant_lines


def split_lines(lines: DataFrame, fraction: float, seed: int = 42, video_only: bool = True) -> DataFrame:
    """(value, split) of the lines that are JSON objects, still images left out. The same for batch and stream."""
    ok = tolerant_lines(lines).filter("status = 'ok'")
    ids = ok.withColumn("video_id", F.get_json_object("value", "$.video_id")).withColumn("question_id", F.get_json_object("value", "$.question_id"))
    kept = ids.filter(~has_suffix(F.col("video_id"), IMAGE_SUFFIXES)) if video_only else ids
    key = F.coalesce(stable_key(F.col("video_id"), F.col("question_id"), F.lit(None).cast("string")), F.col("value"))
    keyed = F.when(F.col("video_id").isNull() & F.col("question_id").isNull(), F.col("value")).otherwise(key)
    return hash_split(kept.withColumn("key", keyed), F.col("key"), fraction, seed).select("value", "split")


def stream_split(spark: SparkSession, source: str, target: str, checkpoint: str, fraction: float, seed: int = 42) -> StreamingQuery:
    """Split text files below ``source`` as they arrive into ``target``, one directory per split; ends when all is read."""
    lines = spark.readStream.text(source)
    split = split_lines(lines, fraction, seed)
    return split.writeStream.format("json").partitionBy("split").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
